import hashlib

from tessera.llm.warc import warc_round_trip


def expected(rows):
    first = {}
    for k, _, h in rows:
        first[h or ""] = min(first.get(h or "", k), k)
    out = []
    for k, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[h or ""] != k
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long = "é<p>\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (1, "u", None), (2, "u\r\nX-Page-ID: 9", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "x" * 100), (8, "u", "x" * 100), (10, "u", "x" * 99), (11, "u", "x" * 99), (3, "http://a/2", long)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id bigint, url string, html string, digest string")
    assert sorted(map(tuple, warc_round_trip(df).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    assert warc_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
