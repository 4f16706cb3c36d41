"""Text normalisers, tokenising, scoring and key extraction as Column expressions (no UDFs).

Patterns use (?U) so that white space and letters are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of query tokens, characters that names ignore, report id shapes.
QUERY_SPLIT = r"(?U)[\s,，、；;]+"
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # what (?U)\s takes
IGNORED = SPACES + "-_()（）,.，:：;；"
REPORT_ID = r"(?i)(?:FS|8D|RPT)[-_]?[A-Z0-9][A-Z0-9\-_/]{3,}"
FAMILY = r"([A-Za-z]{1,8}\d{2,}[A-Za-z0-9-]*)"
AMOUNT = r"(?i)(\d+(?:\.\d+)?)\s*(pcs?|件|个)?"
OPERATOR = "[一-鿿A-Za-z0-9]{2,20}(?:地铁|深铁|轨道交通|铁路局)"
PREVENTIVE = "预防|D7|防再发"
NO_KEY = ("", "unknown", "n/a", "null", "none")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (trim takes only U+0020)."""
    return F.trim(c, F.lit(SPACES))


def norm(c: Column) -> Column:
    """The form in which names are compared."""
    return F.translate(F.lower(c), IGNORED, "")


def tokenize(c: Column) -> Column:
    """Query tokens of at least two characters; the whole query if there is none."""
    q = F.lower(strip(c))
    tokens = F.filter(F.split(q, QUERY_SPLIT), lambda x: F.length(x) >= 2)
    return F.when(q == "", F.array().cast("array<string>")).when(F.size(tokens) == 0, F.array(q)).otherwise(tokens)


def score(text: Column, tokens: Column) -> Column:
    """Share of tokens found, raised when they stand together, squeezed into 0.35 .. 0.98."""
    low = F.lower(text)
    hits = F.size(F.filter(tokens, lambda t: low.contains(t)))
    base = hits / F.size(tokens)
    base = F.when(low.contains(F.array_join(tokens, " ")), F.least(F.lit(1.0), base + 0.25)).otherwise(base)
    return F.when((F.size(tokens) == 0) | (text == ""), F.lit(0.0)).otherwise(F.round(F.least(F.lit(0.98), 0.35 + 0.6 * base), 3))


def report_id(c: Column) -> Column:
    """The first report id in the first 2000 characters, upper-cased, '_' as '-'; else null."""
    found = F.regexp_extract(F.substring(c, 1, 2000), REPORT_ID, 0)
    return F.nullif(F.upper(F.translate(found, "_", "-")), F.lit(""))


def valid_key(c: Column) -> Column:
    """The key, or null where it says nothing."""
    k = strip(c)
    return F.when(~F.lower(k).isin(*NO_KEY) & ~norm(k).contains("unknown"), k)


def amount_value(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, AMOUNT, 1), F.lit("")).try_cast("double")


def amount_unit(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, AMOUNT, 2)), F.lit(""))


def family_code(name: Column, number: Column) -> Column:
    """A product family code from the name, else from the number."""
    one = lambda c: F.nullif(F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), FAMILY, 1)), F.lit(""))
    return F.coalesce(one(name), one(number))


def product_key(name: Column, number: Column) -> Column:
    """FP-FAMILY::, FP-PN::, FP-NAME:: or FP-UNKNOWN."""
    family, pn, nm = family_code(name, number), F.nullif(F.upper(norm(number)), F.lit("")), F.nullif(F.upper(norm(name)), F.lit(""))
    return F.coalesce(F.concat(F.lit("FP-FAMILY::"), family), F.concat(F.lit("FP-PN::"), pn), F.concat(F.lit("FP-NAME::"), nm), F.lit("FP-UNKNOWN"))


def mention_key(scope: Column, name: Column, number: Column, amount: Column, index: Column) -> Column:
    part = lambda c, none: F.coalesce(F.nullif(F.upper(norm(c)), F.lit("")), F.lit(none))
    return F.concat_ws("::", F.lit("FPM"), scope, part(name, "NONAME"), part(number, "NONUM"), part(amount, "NOAMOUNT"), index.cast("string"))


def action_relation(title: Column) -> Column:
    return F.when(title.rlike(PREVENTIVE), "PREVENTIVE_ACTION").otherwise("CORRECTIVE_ACTION")


def email_key(c: Column) -> Column:
    """PER::mail, lower-cased and without white space, if it has an @ and a dot."""
    mail = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    return F.when(mail.contains("@") & mail.contains("."), F.concat(F.lit("PER::"), mail))


def person_name(c: Column) -> Column:
    """Two to four CJK characters, or one to three with a title."""
    return c.rlike("^[\\x{4e00}-\\x{9fff}]{2,4}$") | c.rlike("^[\\x{4e00}-\\x{9fff}]{1,3}(工|经理|主任|总监|总工|班长|老师)$")


def without_think(c: Column) -> Column:
    """A model's answer without its think part and code fences."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?m)^```[a-z]*\s*$", ""))


def best_content(props: Column, keys: list[str]) -> Column:
    """The first non-blank of the keys' values; else, in order of their names, the first value of more
    than four characters, cut to 500; else ''."""
    first = [F.nullif(strip(F.try_element_at(props, F.lit(k))), F.lit("")) for k in keys]
    rest = F.array_sort(F.filter(F.map_entries(props), lambda e: F.length(strip(e["value"])) > 4))
    return F.coalesce(*first, F.substring(F.get(F.transform(rest, lambda e: e["value"]), F.lit(0)), 1, 500), F.lit(""))


def any_property_contains(props: Column, q: str) -> Column:
    return F.exists(F.map_values(props), lambda v: F.lower(v).contains(q.lower()))


def format_of(content: Column) -> Column:
    """docx, doc or null by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B0304"), "docx").when(head == "D0CF11E0A1B11AE1", "doc")


_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def file_name(uri: Column) -> Column:
    """The last segment of a local:// path or of another URI's path; of a URI without a path its last
    segment; null if there is none."""
    last = lambda c: F.nullif(F.regexp_extract(c, "([^/]*)/*$", 1), F.lit(""))
    path = F.regexp_replace(F.regexp_extract(uri, _PATH, 1), "/+$", "")
    return F.when(uri.startswith("local://"), last(F.substr(uri, F.lit(9)))).when(path != "", last(path)).otherwise(last(uri))


def object_location(uri: Column, scheme: str = "minio") -> Column:
    """(bucket, key, error) of an object's URI; error says what is missing, and then the others are null."""
    bucket, path = F.regexp_extract(uri, "^[^:/?#]+://([^/?#]*)", 1), F.regexp_extract(uri, _PATH, 1)
    found = F.lower(F.regexp_extract(uri, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    error = F.when(uri.isNull() | (found != scheme), "scheme").when(bucket == "", "bucket").when(path.isin("", "/"), "key")
    return F.struct(F.when(error.isNull(), bucket).alias("bucket"), F.when(error.isNull(), F.regexp_replace(path, "^/+", "")).alias("key"), error.alias("error"))


def payload(c: Column, schema: str) -> Column:
    """A model's answer as a record: think part and one code fence round the whole go, the rest is read
    as JSON; null if it is none."""
    return F.from_json(F.regexp_replace(strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", "")), r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$", "$1"), schema, {"mode": "PERMISSIVE"})


def time_precision(raw: Column) -> Column:
    """second, minute, day, month or year: what a raw ISO time says; null if it is none."""
    forms = [("second", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"), ("minute", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}$"), ("day", r"^\d{4}-\d{2}-\d{2}$"), ("month", r"^\d{4}-\d{2}$"), ("year", r"^\d{4}$")]
    out = F.when(F.lit(False), "")
    for name, pattern in forms:
        out = out.when(raw.rlike(pattern), name)
    return out


def time_value(raw: Column) -> Column:
    """The time, where it is known to the day at least; a day is never guessed from a month."""
    return F.when(time_precision(raw).isin("second", "minute", "day"), raw.try_cast("timestamp_ntz"))


def iso(c: Column) -> Column:
    """A time without zone in ISO form, with the fraction only where there is one."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(c, "SSSSSS") != "000000", F.date_format(c, ".SSSSSS")).otherwise(""))
