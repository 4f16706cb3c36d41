"""License scans by an exact set-similarity join, with DataFrame functions only.

Base labels come from phrases: places where a phrase's words stand consecutively. The method
adds labels for every block of words that holds at least `threshold` of the distinct words of a
license template. Blocks are windows of twice the longest template's words, at every multiple of
that length, so that any run as long as a template lies whole within a block.

1. Template words are ordered by the number of texts that hold them, the rarest first.
2. Prefix filter: a block that reaches the threshold of a template holds one of the template's
   first |T| - o + 1 words, o being the overlap it needs. Texts with none of these words are not
   cut into blocks at all.
3. Length filter: blocks with too few template words for any template go.
4. A block's template words in the global order are joined to the templates' prefixes on the
   word, under the positional filter: what stands before and after the pair in both orders bounds
   the overlap. Surviving pairs are verified exactly.

Null and empty texts have no words and no labels; repeated rows are scanned each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import text_rows, written

# The base phrases of the contract.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# Notices by which public licenses are applied.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """Words of a parameter text (phrase or template)."""
    import re

    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def needed(n: int, threshold: float) -> int:
    return -int(-(threshold * n) // 1)


def _quoted(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")"


def _places(phrase: list[str]) -> str:
    """SQL: the positions in `words` at which the phrase stands."""
    all_in = " AND ".join(f"array_contains(words, '{w}')" for w in dict.fromkeys(phrase))
    here = " AND ".join([f"x = '{phrase[0]}'", *(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(phrase[1:], 1))])
    return f"CASE WHEN {all_in} THEN filter(transform(words, (x, i) -> CASE WHEN {here} THEN CAST(i AS BIGINT) END), p -> p IS NOT NULL) ELSE CAST(array() AS ARRAY<BIGINT>) END"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    score is 1 with a base label, else the best containment of a template that is reached, else 0.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(words_of(t)))) for label, t in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    span = max(len(words_of(t)) for _, t in templates)
    rows = text_rows(docs, id_col, text_col).select("id", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"))
    # as many rows as the templates have words
    held = rows.select(F.explode(F.expr(f"array_intersect({_quoted(vocabulary)}, words)")).alias("word")).groupBy("word").count()
    often = {r["word"]: r["count"] for r in held.collect()}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    ordered = [(label, sorted(s, key=place.get), needed(len(s), threshold)) for label, s in sets]
    prefix = sorted({w for _, s, o in ordered for w in s[: len(s) - o + 1]})
    least = min(o for _, _, o in ordered)

    own = {label: words_of(p) for label, p in phrases.items()}
    labels = list(own)
    blocks = f"""CASE WHEN arrays_overlap(words, {_quoted(prefix)}) THEN
        filter(transform(sequence(0, (size(words) - 1) DIV {span}), b -> array_intersect({_quoted(order)}, slice(words, CAST(b * {span} + 1 AS INT), {2 * span}))), x -> size(x) >= {least})
        ELSE CAST(array() AS ARRAY<ARRAY<STRING>>) END"""
    scanned = rows.select(F.col("id"), F.monotonically_increasing_id().alias("row"), F.size("words").cast("bigint").alias("n_words"), *(F.expr(_places(own[x])).alias(f"at_{k}") for k, x in enumerate(labels)), F.expr(blocks).alias("blocks"))
    scanned = written(scanned, "scanned")

    index = spark.sql("SELECT inline(array(" + ", ".join(f"named_struct('template', {t}, 'label', '{label}', 'word', '{w}', 'i', {i}, 'of', {_quoted(s)}, 'need', {o})" for t, (label, s, o) in enumerate(ordered) for i, w in enumerate(s[: len(s) - o + 1])) + "))")
    block = scanned.where("size(blocks) > 0").select("row", F.posexplode("blocks").alias("block", "tokens"))
    met = block.select("row", "block", "tokens", F.posexplode("tokens").alias("j", "word")).join(F.broadcast(index), "word")  # the templates' prefixes: a parameter
    met = met.where("least(i, j) + 1 + least(size(of) - i - 1, size(tokens) - j - 1) >= need")
    verified = met.select("row", "label", F.expr("size(array_intersect(tokens, of))").alias("overlap"), F.size("of").alias("n"), "need").where("overlap >= need")
    found = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("n")).alias("best"))

    every = F.flatten(F.array(*(f"at_{k}" for k in range(len(labels)))))
    base = F.array_compact(F.array(*(F.when(F.size(f"at_{k}") > 0, F.lit(x)) for k, x in enumerate(labels))))
    out = scanned.join(found, "row", "left").withColumn("at", every).withColumn("base", base)
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size("at").cast("bigint").alias("n_base"), F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.expr("CAST(array() AS ARRAY<STRING>)"))))), ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def duckdb_sql(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85) -> str:
    """The same result in SQL, without the filters: every block against every template."""
    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    span = max(len(words_of(t)) for _, t in templates)
    own = {label: words_of(p) for label, p in phrases.items()}
    places = {label: " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(ws)) for label, ws in own.items()}
    at = ", ".join(f"list_filter(range(len(words)), lambda i: {cond}) AS at_{k}" for k, cond in enumerate(places.values()))
    every = "flatten([" + ", ".join(f"at_{k}" for k in range(len(own))) + "])"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(at_{k}) > 0 THEN '{label}' END" for k, label in enumerate(own)) + "], lambda x: x IS NOT NULL)"
    best, more = [], []
    for label, t in templates:
        s = sorted(set(words_of(t)))
        o = needed(len(s), threshold)
        top = f"coalesce(list_max(list_transform(blocks, lambda b: len(list_intersect({quote(s)}, b)))), 0)"
        best.append(f"CASE WHEN {top} >= {o} THEN {top} / {len(s)} ELSE 0.0 END")
        more.append(f"CASE WHEN {top} >= {o} THEN '{label}' END")
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
     b AS (SELECT doc_id, words, {at}, list_transform(range(0, len(words), {span}), lambda s: list_distinct(words[s + 1 : s + {2 * span}])) AS blocks FROM w),
     f AS (SELECT doc_id, len(words) AS n_words, {every} AS at_all, {base} AS base, [{", ".join(more)}] AS more, greatest({", ".join(best)}) AS best FROM b)
SELECT doc_id, n_words, len(at_all) AS n_base, list_min(at_all) AS first_word, list_max(at_all) AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, list_filter(more, lambda x: x IS NOT NULL)))), ',') AS labels,
       CASE WHEN len(at_all) > 0 THEN 1.0::DOUBLE ELSE best::DOUBLE END AS score
FROM f"""
