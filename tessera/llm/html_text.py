"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks: text between the tags that begin or end a block. A linear classifier
gives each block the costs of the labels content and boilerplate, from the elements around it
(names, class and id words), its link density and its words. The costs are terminal
capacities; neighbours in page order, and blocks of one parent element, are joined by
smoothness edges. A maximum flow (Dinic's algorithm) gives the cheapest labelling: blocks on
the source's side of the cut are content. Where a block's own costs outweigh all its edges its
label is certain, and it enters the flow as a terminal, which leaves the cut unchanged.

Scripts, styles, comments and form controls are never text; character references are decoded;
white space inside a block becomes one space. Null and empty pages give the empty text; very long
pages and any number of unclosed or stray tags take time in proportion; a block whose two labels
cost the same is boilerplate; repeated rows are extracted each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# quotes count only behind an equals sign: elsewhere in a tag they are characters like any other
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# First words of class names that tell of something else inside or missing.
ABOUT = frozenset("has have with without no is not hide".split())
# HTML's void elements, those whose content is not text, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg select button head canvas audio video".split())
RAW_TEXT = frozenset("script style title textarea iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "option", "legend"}
# Weights of the classifier in favour of content (positive) or boilerplate.
ELEMENT = {"article": 4.0, "main": 2.5, "p": 1.0, "blockquote": 0.5, "pre": 1.0, "figcaption": 0.3, "nav": -10.0, "header": -9.0, "footer": -10.0, "aside": -10.0, "form": -10.0, "menu": -9.0, "dialog": -10.0, "fieldset": -9.0, "address": -2.0, "a": -2.0}
GOOD = frozenset("article content main post entry story body text".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation navi menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar side aside widget widgets related recommended recommendations share sharing social follow subscribe subscription newsletter signup login comment comments commentlist reply replies respond discussion disqus reviews cookie cookies consent gdpr notice notices notification alert popup modal overlay toolbar pagination pager search skip copyright legal disclaimer tags tagcloud meta outbrain taboola hidden".split()
)
# Words that say only where or what sort of box an element is, and words of readers' answers.
WHERE = frozenset("site page global top bottom left right main primary secondary wrapper wrap container box block area list item inner outer section div col row js the my id no".split())
ANSWERS = frozenset("comment comments commentlist reply replies respond discussion disqus reviews".split())
BAD_WEIGHT, WEAK_WEIGHT, GOOD_WEIGHT, PRIOR, BARE_PRIOR, LINKED, LINKED_IN_ARTICLE, LENGTH, LENGTH_CAP = -10.0, -3.0, 1.5, -1.0, 0.5, -4.0, -2.5, 0.05, 40
NEXT_TO, SIBLING = 1.0, 2.0


class Block:
    __slots__ = ("text", "score", "parent")

    def __init__(self, text: str, score: float, parent: int):
        self.text, self.score, self.parent = text, score, parent


def _weight(name: str, attributes: str) -> tuple[float, float]:
    """(weight, loose): what an element and its attributes say of the text in it. `loose` is the part that class
    words say which might as well name a subject ("comment-policy", "category-social"): an article is not
    judged by them."""
    w, loose = ELEMENT.get(name, 0.0), 0.0
    for m in NAMES.finditer(attributes) if attributes else ():
        key, given = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = given.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            w += BAD_WEIGHT
        elif key in ("class", "id", "role") and name not in ("html", "body"):
            names = [set(x) for x in (WORD.findall(HUMP.sub(" ", x).lower()) for x in given.split()) if x and (x[0] not in ABOUT or len(x) == 1)]
            words = set().union(*names)
            if words & {"complementary", "contentinfo"} or any(x & BAD and _plain(x) for x in names):
                w += BAD_WEIGHT
            elif words & BAD:
                loose += WEAK_WEIGHT if any(x <= GOOD | BAD | WHERE for x in names if x & BAD) or name in ("article", "main") else BAD_WEIGHT
            elif words & GOOD:
                w += GOOD_WEIGHT
    return w, loose


def _plain(words: set[str]) -> bool:
    """Whether the words of a name that tells of boilerplate tell of nothing else."""
    return words <= BAD | WHERE or bool(words & ANSWERS) and words <= BAD | WHERE | GOOD


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with the classifier's score."""
    out: list[Block] = []
    stack: list[tuple[str, float, int, float]] = []  # name, weight with that of all around it, number, loose weight
    serial, held, linked, in_link, skip = 0, [], 0, 0, None
    # where each name stands on the stack, and where blocks and blocks that hold blocks do
    places: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    holders: list[int] = []

    inside = 0  # articles that are open
    bare: list[Block] = []  # blocks of which nothing but their own words tells anything

    def last(*names: str) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    def flush() -> None:
        nonlocal linked
        if held:
            text = SPACE.sub(" ", "".join(held)).strip()
            if text:
                around = stack[-1][1] + stack[-1][3] if stack else 0.0
                n = len(text)
                score = PRIOR + around + (LINKED_IN_ARTICLE if inside else LINKED) * min(1.0, linked / n) + LENGTH * min(LENGTH_CAP, text.count(" ") + 1)
                out.append(Block(text, score, stack[holders[-1]][2] if holders else -1))
                if around == 0 and not linked:
                    bare.append(out[-1])
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal in_link, inside
        for name, *_ in stack[to:]:
            in_link -= name == "a"
            inside -= name == "article"
            places[name].pop()
        for where in (blocks, holders):
            while where and where[-1] >= to:
                where.pop()
        del stack[to:]

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            rest = page[at:]
        else:
            rest = page[at : m.start()]
        if rest and skip is None:
            text = html.unescape(rest) if "&" in rest else rest
            held.append(text)
            if in_link:
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1]:
            if skip is not None:
                if name == skip[0] and name not in RAW_TEXT:
                    skip[1] += 1
                continue
            if name in RAW:
                held.append(" ")
                if name in RAW_TEXT:  # nothing inside these is markup
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                elif not m[3].rstrip().endswith("/"):
                    skip = [name, 1]
                continue
            if name in ("br", "hr"):
                held.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in VOID:
                continue
            if name in BLOCK:
                flush()
                if name in CLOSES_P:
                    k = last("p")
                    if k > last("td", "th"):
                        pop(k)
                elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    k = last(name)
                    if k > last("ul", "ol", "dl", "table"):
                        pop(k)
            serial += 1
            own, loose = _weight(name, m[3])
            around = (stack[-1][1] if stack else 0.0) + own
            if name not in ("article", "main"):
                loose += stack[-1][3] if stack else 0.0
            else:
                loose = 0.0
            if not m[3].rstrip().endswith("/") or name in BLOCK:
                places[name].append(len(stack))
                if name in BLOCK:
                    blocks.append(len(stack))
                    if name not in LEAF:
                        holders.append(len(stack))
                stack.append((name, around, serial, loose))
                in_link += name == "a"
                inside += name == "article"
        else:
            if skip is not None:
                if name == skip[0]:
                    skip[1] -= 1
                    if skip[1] == 0:
                        skip = None
                continue
            if name in BLOCK:
                flush()
            k = last(name)
            if k >= 0 and (name in BLOCK or not blocks or blocks[-1] <= k):
                pop(k)
    flush()
    if len(bare) == len(out) or not any(b.score > 0 for b in out):  # nothing on the page is marked as text: plain blocks are
        for b in bare:
            b.score += BARE_PRIOR - PRIOR
    return out


class Flow:
    """Maximum flow by Dinic's algorithm."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.left: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.left.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.left.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.left[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Pushes a maximum flow; which vertices the source still reaches."""
        while (level := self.levels(source))[sink] >= 0:
            turn = [0] * len(self.out)
            while True:
                path: list[int] = []
                a = source
                while a != sink:
                    while turn[a] < len(self.out[a]):
                        e = self.out[a][turn[a]]
                        if self.left[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                            break
                        turn[a] += 1
                    else:
                        if not path:
                            break
                        a = self.to[path.pop() ^ 1]
                        turn[a] += 1
                        continue
                    path.append(e)
                    a = self.to[e]
                if a != sink:
                    break
                f = min(self.left[e] for e in path)
                for e in path:
                    self.left[e] -= f
                    self.left[e ^ 1] += f
        return [x >= 0 for x in level]


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges: neighbours in page order, and consecutive blocks of one parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            out[k - 1, k] = out.get((k - 1, k), 0.0) + NEXT_TO
        if b.parent in last:
            pair = last[b.parent], k
            out[pair] = out.get(pair, 0.0) + SIBLING
        last[b.parent] = k
    return out


def min_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The cheapest labelling: a block that is not content costs its score if that is positive, one
    that is costs minus its score if negative, and an edge costs its weight where labels differ."""
    n = len(scores)
    pull = [0.0] * n
    for (a, b), w in edges.items():
        pull[a] += w
        pull[b] += w
    label: list[bool | None] = [s > 0 if abs(s) > p else None for s, p in zip(scores, pull, strict=True)]
    free = [k for k in range(n) if label[k] is None]
    if free:
        at = {k: i for i, k in enumerate(free)}
        flow, source, sink = Flow(len(free) + 2), len(free), len(free) + 1
        own = {k: scores[k] for k in free}
        for (a, b), w in edges.items():
            if a in at and b in at:
                flow.edge(at[a], at[b], w, w)
            elif a in at:
                own[a] += w if label[b] else -w
            elif b in at:
                own[b] += w if label[a] else -w
        for k in free:
            if own[k] > 0:
                flow.edge(source, at[k], own[k])
            elif own[k] < 0:
                flow.edge(at[k], sink, -own[k])
        side = flow.source_side(source, sink)
        for k in free:
            label[k] = side[at[k]]
    return [bool(x) for x in label]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    keep = min_cut([b.score for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")
    return found.withColumnsRenamed({"id": id_col, "url": url_col}) if url_col != "url" else found.withColumnRenamed("id", id_col)
