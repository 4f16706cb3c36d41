"""Operators on raw texts and tables: line clean-up, classification, containment, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

MAX_CHARS = 220_000


# What ends a line in a legacy file, what is no line of text.
LINE_ENDS, CONTROLS = r"[\r\n\x0B\x0C\x07\t]+", r"[\x00-\x08\x0E-\x1F]"
NOISE = r"^[-_=*·. ]*$|(?i)^(?:DOCPROPERTY|MERGEFORMAT|HYPERLINK|PAGEREF)\b|(?i)^Toc\d+$"


def salvage_lines(texts: DataFrame) -> DataFrame:
    """(id, salvaged): lines squeezed and trimmed, control characters being spaces; kept are first
    occurrences of 2 to 300 characters that are no noise and of which at least 35 % are Latin letters, digits or
    CJK, until 220 000 characters are reached. All of it is done within the row, without a shuffle."""

    def good(line: Column) -> Column:
        told = F.length(F.regexp_replace(line, r"[^A-Za-z0-9\x{4e00}-\x{9fff}]", ""))
        return F.length(line).between(2, 300) & (told > 0) & (told >= 0.35 * F.length(line)) & ~line.rlike(NOISE)

    lines = F.transform(F.split(F.regexp_replace("text", LINE_ENDS, "\n"), "\n"), lambda x: T.strip(F.regexp_replace(F.regexp_replace(x, CONTROLS, " "), r"(?U)\s+", " ")))
    start = F.struct(F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("n"))
    step = lambda t, x: F.when(t["chars"] < MAX_CHARS, F.struct((t["chars"] + F.length(x) + 1).alias("chars"), (t["n"] + 1).alias("n"))).otherwise(t)
    kept = texts.select("id", F.array_distinct(F.filter(lines, good)).alias("lines")).withColumn("n", F.aggregate("lines", start, step)["n"])
    return kept.select("id", F.coalesce(F.array_join(F.slice("lines", F.lit(1), F.col("n")), "\n"), F.lit("")).alias("salvaged"))


def salvage_files(files: DataFrame) -> DataFrame:
    """(id, salvaged) of legacy files(id, content), whatever else is in them: their bytes as UTF-16, what is none
    left out, and of that the lines that are text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = [(c.as_py() or b"").decode("utf-16-le", "ignore") for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["id", "text"])

    rows = files.select("id", "content")
    return salvage_lines(rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, text string"))


def classify_tables(tables: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """tables(id, headers): the type all of whose required headers occur in some header; the one with the
    most of them, then the first by name; else unknown."""
    fits = [F.when(F.forall(F.array(*map(F.lit, need)), lambda r: F.exists("headers", lambda h: F.upper(h).contains(F.upper(r)))), F.struct(F.lit(-len(need)).alias("n"), F.lit(kind).alias("kind"))) for kind, need in sorted(patterns.items())]
    return tables.select("id", F.coalesce(F.array_min(F.array_compact(F.array(*fits)))["kind"], F.lit("unknown")).alias("table_type"))


def route(texts: DataFrame, modules: dict[str, list[str]], base: list[str]) -> DataFrame:
    """(id, modules): the base modules and every module with a keyword in the text, in order."""
    low = F.lower("text")
    hit = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)), F.lit(m)) for m, words in modules.items()]
    return texts.select("id", F.array_join(F.array_compact(F.array(*map(F.lit, base), *hit)), ",").alias("modules"))


# The modules of an extraction, and what in a chunk asks for one: its role, a step or a word in its
# section path, a word in its text where the text is the whole report's or of no known part.
BASE_MODULES = ["8d-report-extraction-core", "8d-actor-entity-typing", "8d-temporal-normalization", "8d-relationship-normalization"]
MODULES = {
    "8d-d2-event-extraction": (None, ["D2"], ["问题描述", "故障描述", "故障现象", "客诉", "投诉", "异常", "事件", "试验", "问题定义", "故障信息"], ["发生", "出现", "故障", "异常", "客诉", "投诉", "报警", "试验", "上报", "现象"]),
    "8d-d4-root-cause-extraction": ("hypothesis", ["D4"], ["根因", "原因分析", "原因验证", "5WHY", "鱼骨", "失效分析"], ["根因", "原因", "导致", "由于", "验证", "5WHY"]),
    "8d-d5-action-extraction": ("action", ["D3", "D5", "D6", "D7"], ["措施", "纠正", "预防", "验证", "遏制", "防再发"], ["措施", "整改", "更换", "隔离", "返工", "培训", "检验", "预防", "验证"]),
}
FULL_SECTIONS, OPEN_ROLES = ["全文", "full_document"], ["unknown", "evidence", "conclusion"]


def report_modules(chunks: DataFrame, base: list[str] = BASE_MODULES, modules: dict = MODULES) -> DataFrame:
    """(doc, modules): the base modules and those that any chunk(doc, section_path, chunk_role, text) of the report
    asks for, in order."""
    has = lambda c, words: F.upper(c).rlike("|".join(re.escape(w.upper()) for w in words))
    parts = F.filter(F.transform(F.coalesce("section_path", F.array().cast("array<string>")), T.strip), lambda p: p != "")
    text, path = F.coalesce("text", F.lit("")), F.coalesce("section_path", F.array().cast("array<string>"))
    whole = (F.size(path) == 0) | ((F.size(path) == 1) & F.coalesce(F.get(path, F.lit(0)).isin(FULL_SECTIONS), F.lit(False))) | F.coalesce(F.col("chunk_role").isin(OPEN_ROLES), F.lit(False))
    told = lambda steps, sections: lambda p: F.upper(p).isin(steps) | has(p, sections)
    asked = []
    for name, (role, steps, sections, words) in modules.items():
        by_role = F.coalesce(F.col("chunk_role") == role, F.lit(False)) if role else F.lit(False)
        by_section = F.exists(parts, told(steps, sections))
        asked.append(F.when(F.bool_or(by_role | by_section | (whole & has(text, words))), F.lit(name)))
    return chunks.groupBy("doc").agg(F.concat(F.array(*map(F.lit, base)), F.array_compact(F.array(*asked))).alias("modules"))


def single_chunks(texts: DataFrame, fallback: str = "DOC-") -> DataFrame:
    """One chunk a document: its id comes from the report id in the text, else from the whole of the document's."""
    report = F.coalesce(T.report_id(F.col("text")), F.concat(F.lit(fallback), F.col("id").cast("string")))
    body = T.strip(F.col("text"))
    return texts.select("id", F.concat(report, F.lit("#full_document#0")).alias("chunk_id"), report.alias("report_id"), F.lit("unknown").alias("chunk_role"), F.length(body).alias("char_count"), F.size(F.split(body, r"(?U)\s+")).alias("token_count"))


def begins(short: DataFrame, long: DataFrame, width: int = 16) -> DataFrame:
    """(short_id, long_id) where the short text begins the long one. Texts of `width` characters or
    more meet on their first `width`; a shorter text meets the long one's head of its own length.
    An empty text begins only empty texts, and null has no pairs."""
    s = short.select(F.col("id").alias("short_id"), F.col("text").alias("s"))
    g = long.select(F.col("id").alias("long_id"), F.col("text").alias("g"))
    head = lambda c: F.substring(c, 1, width).alias("head")
    met = s.where(F.length("s") >= width).select("*", head("s")).join(g.where(F.length("g") >= width).select("*", head("g")), "head").where(F.col("g").startswith(F.col("s"))).select("short_id", "long_id")
    brief = s.where(F.length("s") < width)
    sizes = sorted(r["k"] for r in brief.select(F.length("s").alias("k")).distinct().collect())  # at most `width` numbers
    if not sizes:
        return met
    fits = F.filter(F.array(*map(F.lit, sizes)), lambda k: F.when(k == 0, F.length("g") == 0).otherwise(k <= F.length("g")))
    heads = g.select("long_id", F.explode(F.transform(fits, lambda k: F.col("g").substr(F.lit(1), k))).alias("s"))
    return met.unionByName(brief.join(heads, "s").select("short_id", "long_id"))


def prefix_pairs(short: DataFrame, long: DataFrame, width: int = 16) -> DataFrame:
    """(short_id, long_id) where the short text begins the long one and the ids differ; see begins()."""
    return begins(short, long, width).where(F.col("short_id") != F.col("long_id"))
