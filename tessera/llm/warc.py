"""WARC archives with revisit resolution.

Only headers (digest, page) are shuffled to find payloads that occur more than once: the record
of the smallest page_id stays a response, the others become revisit records that refer to it.
The join of pages with those originals is broadcast only below a measured size. Records get
fresh headers and are written as gzipped WARC 1.0 files of a bounded number of records; then
the files are read back, record by record, and revisits are joined to the responses that they
name. Payloads under `least` bytes are always responses.

A null html is an empty payload and a null url an empty target; repeated rows with one page_id
and payload are all responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import new_path, written

RECORDS_PER_FILE = 4000
BROADCAST_BYTES = 32 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n ]", "%20").alias("url"), html.alias("html"))
    return rows.select("*", F.octet_length("html").cast("bigint").alias("size"), F.sha2("html", 256).alias("digest"))


def originals(payloads: DataFrame, least: int) -> DataFrame:
    """(digest, page_id, url) of the first of the payloads that occur more than once."""
    heads = payloads.where(F.col("size") >= least).select("digest", F.struct("page_id", "url").alias("head"))
    return heads.groupBy("digest").agg(F.min("head").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("head.page_id").alias("of"), F.col("head.url").alias("of_url"))


def _record_id(page: str, digest: str) -> F.Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(F.col(page).cast("string"), F.lit("null")), F.col(digest)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def records(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(value): the text of each record, header and block."""
    payloads = _payloads(pages, id_col, url_col, html_col)
    first = written(originals(payloads, least), "originals")
    size = first.agg(F.sum(96 + F.length("of_url"))).first()[0] or 0
    rows = payloads.join(F.broadcast(first) if size <= BROADCAST_BYTES else first, "digest", "left")
    rows = rows.withColumn("revisit", F.expr("of IS NOT NULL AND NOT (page_id <=> of)"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    own = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id("page_id", "digest")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id("of", "digest")), line("WARC-Refers-To-Target-URI", F.col("of_url")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )
    return rows.select(own.alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 100, **columns: str) -> None:
    """Deduplicated archives under path; a record's end mark is the writer's line separator."""
    records(pages, least, **columns).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
_FIELD = re.compile(rb"\r\n([A-Za-z-]+): ([^\r\n]*)")


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], memoryview]]:
    """(header fields, payload) of each record of a WARC file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = data[at : stop + 2]
        n = int(_LENGTH.search(head)[1])
        body = data.index(b"\r\n\r\n", stop + 4, stop + 4 + n) + 4
        yield dict(_FIELD.findall(head)), view[body : stop + 4 + n]
        at = stop + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at += 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record under path.

    Responses are hashed again and must match their headers; revisits take the payload's size
    from the response that they name."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column(0):
                out = []
                for field, payload in parse(gzip.decompress(content.as_py())):
                    kind, digest = field[b"WARC-Type"].decode(), field[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {field[b'WARC-Record-ID']} is damaged")
                    page = field[b"X-Page-ID"]
                    out.append((int(page) if page else None, field[b"WARC-Record-ID"].decode(), kind, digest, len(payload) if kind == "response" else None, field[b"WARC-Refers-To"].decode() if kind == "revisit" else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["page_id", "record", "record_type", "payload_digest", "payload_bytes", "refers"])

    files = spark.read.format("binaryFile").load(path).select("content")
    read = written(files.mapInArrow(batches, "page_id bigint, record string, record_type string, payload_digest string, payload_bytes bigint, refers string"), "records")
    responses = read.where("record_type = 'response'")
    named = responses.select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    named = named.join(read.where("record_type = 'revisit'").select("refers").distinct(), "refers", "left_semi").dropDuplicates(["refers"])
    met = read.where("record_type = 'revisit'").drop("payload_bytes").join(written(named, "named"), "refers", "left")
    met = met.withColumn("full_bytes", F.when(F.col("full_digest") == F.col("payload_digest"), F.col("full_bytes")).otherwise(F.raise_error(F.lit("a revisit names no response with its digest"))))
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(order).unionByName(met.withColumnRenamed("full_bytes", "payload_bytes").select(order))


def warc_round_trip(pages: DataFrame, least: int = 100, **columns: str) -> DataFrame:
    """Writes archives of pages into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least, **columns)
    return read_archives(spark, path)
