import itertools
import random
import time

import pytest

from tessera.llm.html_text import edges_of, blocks_of, extract_text, main_text, min_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="home has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a><li><a href='/b'>Two</a></ul></nav>
<div id="cookie-notice">We use cookies to improve things for all of our readers.</div><!-- <p>hidden</p> -->
<div class="layout"><aside class="sidebar"><p>Popular: many other stories that you may like to read today.</p></aside>
<article><h1>Head &amp; line</h1><p>First <b>bold<br>text</b> of&nbsp;the   story, caf&eacute; &#8212; ok.<p>Second paragraph
goes on<script>x()</script> here.</p><ul><li>item one</li><li>item two</li></ul><p>Short.</p>
<div class="ad">Buy this thing now</div><form><label>Mail</label><input name=q><button>Send</button></form>
<p>Last words.</p><section class="comments"><h3>Comments</h3><p>Reader: I liked this article a lot, thank you for writing it!</p></section></article></div>
<footer>&copy; 2024 Site. All rights reserved.</footer></body>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line First bold text of the story, café — ok. Second paragraph goes on here. item one item two Short. Last words."


def test_odd_pages():
    assert main_text("") == "" and main_text("   ") == ""
    assert main_text("<article><p>a < b & c</article>") == "a < b & c"
    assert main_text("<article><p>open <b>never closed") == "open never closed"
    assert main_text("<script>") == main_text("<!-- x") == main_text("</p></div>") == ""


def test_cut_is_the_cheapest_labelling():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randrange(1, 9)
        scores = [rnd.choice([-3, -1, -0.4, 0.3, 0.7, 2]) * rnd.random() for _ in range(n)]
        edges = {(a, b): rnd.random() for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5}

        def cost(x):
            return sum((s if s > 0 else 0) if not k else (-s if s < 0 else 0) for s, k in zip(scores, x)) + sum(w for (a, b), w in edges.items() if x[a] != x[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(min_cut(scores, edges)) - best) < 1e-6


def test_many_blocks_take_moderate_time():
    page = "<body>" + "<div><p>some words here</p></div>" * 20_000
    began = time.time()
    blocks = blocks_of(page)
    min_cut([b.score for b in blocks], edges_of(blocks))
    main_text("<div " * 5000 + "<" * 5000 + "<p>" * 20_000)
    assert time.time() - began < 20


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted(map(tuple, extract_text(df).collect()), key=str)
    assert got == sorted([(k, u, main_text(h or ""), len(main_text(h or ""))) for k, u, h in rows], key=str)
    assert extract_text(df.limit(0)).collect() == []


def test_pages_keep_the_article_and_nothing_else(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        import html
        import re

        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert main_text(r.html) == want


def test_class_names_that_tell_of_something_else():
    assert main_text('<body><div class="has-sidebar"><article><p>Body text of it.</p></article></div></body>') == "Body text of it."
    more = "more things here " * 7
    assert main_text(f'<article><p>One two.</p></article><div class="cookieBanner">{more}</div><div id="sidebarLeft">{more}</div>') == "One two."


def test_quotes_inside_values_and_formulas():
    assert main_text("<article><p title=it's>Kept text</p><p>and isn't lost</p></article>") == "Kept text and isn't lost"
    assert main_text('<article><p title = "a > b">Kept</p><p data-x=\'"\'>too</p></article>') == "Kept too"
    assert main_text("<article><p>x <math><mi>y</mi></math> z</p></article>") == "x y z"


def test_the_cut_changes_labels():
    long = "many words of running text that make a paragraph " * 5
    page = f"<body><div><p>{long}</p><div>Short.</div><p>{long}</p></div><footer><p>a</p><div>{long}</div></footer></body>"
    blocks = blocks_of(page)
    alone, cut = [b.score > 0 for b in blocks], min_cut([b.score for b in blocks], edges_of(blocks))
    assert alone[1] is False and cut[1] is True  # between two paragraphs
    assert main_text(page) == f"{long.strip()} Short. {long.strip()}"
    between = [5.0, -0.5, 5.0, -8.0, 0.5, -8.0]
    edges = {(k, k + 1): 1.0 for k in range(5)}
    assert min_cut(between, edges) == [True, True, True, False, False, False]


def test_unclosed_tags_take_time_in_proportion():
    began = time.time()
    assert len(blocks_of("<article>" + "<b><p>text here" * 50_000)) == 50_000
    assert time.time() - began < 5


def test_most_blocks_of_pages_enter_the_flow():
    import pyarrow.parquet as pq

    entered = total = 0
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        blocks = blocks_of(page or "")
        pull = [0.0] * len(blocks)
        for (a, b), w in edges_of(blocks).items():
            pull[a] += w
            pull[b] += w
        entered += sum(abs(b.score) <= w for b, w in zip(blocks, pull))
        total += len(blocks)
    assert entered > 0.3 * total


LONG = "This is a paragraph of an article with quite a few words in it, enough to be taken for text by anyone."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article id="comment-policy"><h1>Our policy</h1><p>{LONG}</p></article>', f"Our policy {LONG}"),
        (f'<div class="category-social"><article><p>{LONG}</p></article></div>', LONG),
        (f'<div class="header-sticky"><article><p>{LONG}</p></article></div>', LONG),
        ("<body><div>Only a few plain words here.</div></body>", "Only a few plain words here."),
        (f"<article><p>{LONG} See:</p><ul><li><a href=x>First link</a></li><li><a href=y>Second one</a></li><li><a href=z>Third one</a></li></ul></article>", f"{LONG} See: First link Second one Third one"),
        (f'<article><p>{LONG}</p><section id="comments"><article class="comment"><p>{LONG} Not this.</p></article></section></article>', LONG),
        (f'<div class="sidebar"><article><p>{LONG} Not this.</p></article></div><article><p>{LONG}</p></article>', LONG),
        (f'<div class="comment-list"><div class="comment-body"><p>{LONG}</p></div></div>', ""),
        (f'<div class="related-posts"><p>{LONG} Not this.</p></div><article><p>{LONG}</p></article>', LONG),
        (f'<div class="site-header"><p>{LONG}</p></div>', ""),
    ],
)
def test_names_of_boxes_and_of_subjects(page, text):
    assert main_text(page) == text
