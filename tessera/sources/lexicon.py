"""Lexicon files: JSON with organization_aliases and table_patterns, as the tables and dicts that rules take."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def reload() -> None:
    """Files are read again when they are next asked for."""
    _read.cache_clear()


def organization_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, code, org, alias, kind): a row for each alias of each entry, the entries in the file's order; an
    entry without aliases has one row, its name."""
    rows = [(k, e.get("canonical_code"), e.get("canonical_name"), a, e.get("org_type")) for k, e in enumerate(_read(path).get("organization_aliases", [])) for a in e.get("aliases") or [e.get("canonical_name")]]
    return spark.createDataFrame(rows, "ordinal int, code string, org string, alias string, kind string")


def table_patterns(path: str) -> dict[str, list[str]]:
    """The headers that tables of each type must have."""
    return {k: list(v["required_headers"] if isinstance(v, dict) else v) for k, v in _read(path).get("table_patterns", {}).items()}
