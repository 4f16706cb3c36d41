"""Findings and their polarity: what a text says is there, may be there, or is not.

A text is one pass over its tokens: terms of a lexicon, cues, words that end a cue's scope, other words (CJK
characters are words of their own). A cue before a term reaches over at most `window` tokens and not beyond the
end of its clause; so do enumerations. Each further negation within reach turns the polarity round ("not without"),
a cue of doubt makes it neutral. A cue behind a term ("was ruled out", "不存在") speaks of the terms of its clause
that no cue stands before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cues:
    """Words that tell polarity; of overlapping ones the longest counts."""

    negative: tuple[str, ...]
    behind: tuple[str, ...]
    doubt: tuple[str, ...]
    ends: tuple[str, ...]


# Words of negation, of doubt, and such as stand behind what they deny.
CUES = Cues(
    negative=("未发现", "未见", "无", "非", "未", "没有", "不存在", "不属于", "排除", "并非", "不存在于", "no", "not", "none", "without", "ruled out", "excluded", "absent", "negative", "no evidence", "no indication"),
    behind=("不存在", "被排除", "已排除", "正常", "ruled out", "excluded", "absent", "negative"),
    doubt=("可能", "疑似", "possible", "possibly", "suspected", "may"),
    ends=("但", "但是", "然而", "but", "however", "although", "except"),
)
STOPS = r"[.!?;。！？；\n]"
WINDOW = 12


def _either(words: list[str]) -> str:
    """A pattern for any of these, longest first; words of letters stand alone."""
    bare = [re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))]
    return "|".join(rf"(?<![A-Za-z0-9]){b}(?![A-Za-z0-9])" if re.match(r"[A-Za-z0-9]", w) else b for b, w in zip(bare, sorted(words, key=lambda w: (-len(w), w)), strict=True))


def tokens(text: Column, terms: list[str], cues: Cues) -> Column:
    """The tokens of a text in order, in lower case."""
    known = _either([w.lower() for w in {*terms, *cues.negative, *cues.behind, *cues.doubt, *cues.ends}])
    return F.regexp_extract_all(F.lower(text), F.lit(rf"({known}|{STOPS}|[\x{{4e00}}-\x{{9fff}}]|[\p{{L}}\p{{N}}]+)"), F.lit(1))


def polarities(text: Column, terms: list[str], cues: Cues = CUES, window: int = WINDOW) -> Column:
    """An array of (term, polarity, place), place counting tokens: positive, negative or neutral."""
    low = [t.lower() for t in terms]
    member = lambda t, words: t.isin([w.lower() for w in words]) if words else F.lit(False)
    found = "array<struct<term:string,polarity:string,place:int>>"
    # place, negations within reach, doubt, tokens of reach left, findings told before this clause, and in it
    start = F.struct(F.lit(0).alias("place"), F.lit(0).alias("no"), F.lit(False).alias("doubt"), F.lit(0).alias("left"), F.array().cast(found).alias("done"), F.array().cast(found).alias("open"))

    def step(s: Column, t: Column) -> Column:
        next_ = s["place"] + 1
        reach = s["left"] > 0
        no, doubt = F.when(reach, s["no"]).otherwise(0), F.when(reach, s["doubt"]).otherwise(False)
        left = F.greatest(s["left"] - 1, F.lit(0))
        told = F.when(doubt, "neutral").when(no % 2 == 1, "negative").when(no > 0, "positive")
        item = lambda p: F.struct(t.alias("term"), p.alias("polarity"), s["place"].alias("place"))
        make = lambda no, doubt, left, done, open_: F.struct(next_.alias("place"), no.cast("int").alias("no"), doubt.alias("doubt"), left.cast("int").alias("left"), done.alias("done"), open_.alias("open"))
        bare = F.exists(s["open"], lambda x: x["polarity"].isNull())
        denied = F.transform(s["open"], lambda x: F.struct(x["term"].alias("term"), F.coalesce(x["polarity"], F.lit("negative")).alias("polarity"), x["place"].alias("place")))
        closed = F.concat(s["done"], s["open"])
        none = F.array().cast(found)
        return (
            F.when(t.rlike(f"^{STOPS}$") | member(t, cues.ends), make(F.lit(0), F.lit(False), F.lit(0), closed, none))
            .when(member(t, cues.behind) & bare, make(F.lit(0), F.lit(False), F.lit(0), s["done"], denied))
            .when(member(t, cues.negative), make(no + 1, doubt, F.lit(window), s["done"], s["open"]))
            .when(member(t, cues.doubt), make(no, F.lit(True), F.lit(window), s["done"], s["open"]))
            .when(t.isin(low), make(no, doubt, F.when(reach, F.lit(window)).otherwise(F.lit(0)), s["done"], F.concat(s["open"], F.array(item(told)))))
            .otherwise(make(no, doubt, left, s["done"], s["open"]))
        )

    every = F.aggregate(tokens(text, terms, cues), start, step, lambda s: F.concat(s["done"], s["open"]))
    return F.transform(every, lambda x: F.struct(x["term"].alias("term"), F.coalesce(x["polarity"], F.lit("positive")).alias("polarity"), x["place"].alias("place")))


def findings(texts: DataFrame, terms: list[str], cues: Cues = CUES, window: int = WINDOW) -> DataFrame:
    """(id, place, term, polarity) of every term in texts(id, text)."""
    return texts.select("id", F.inline(polarities(F.col("text"), terms, cues, window))).select("id", "place", "term", "polarity")


def evidence_edges(found: DataFrame, causes: DataFrame) -> DataFrame:
    """(doc, from_label, from_key, rel_type, to_label, to_key): findings support the causes(doc, key, term) that their
    term stands for, or rule them out; neutral ones do neither. found(doc, key, term, polarity)."""
    told = found.where("polarity <> 'neutral'").join(causes.select("doc", "term", F.col("key").alias("to_key")), ["doc", "term"])
    kind = F.when(F.col("polarity") == "positive", "SUPPORTS").otherwise("RULES_OUT")
    return told.select("doc", F.lit("Finding").alias("from_label"), F.col("key").alias("from_key"), kind.alias("rel_type"), F.lit("CauseItem").alias("to_label"), "to_key").distinct()
