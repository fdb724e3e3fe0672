"""WARC archives: one record set per page, and captures assembled from the archives.

Spark's text sink writes the records (a WARC record ends with an empty line, which is the
sink's line separator), so archives are committed like any Spark output, on any file
system. Reading joins request, response and metadata records through their
WARC-Concurrent-To identifiers and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, text_or_empty

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of payload that a file holds on average, and the pages that it holds at most.
FILE_BYTES, FILE_PAGES = 1 << 25, 2000

RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, block string, payload binary"
)


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: 8 groups of 5 hex digits, each 4 digits of 5 bits."""
    digest = F.sha1(text)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) to these, digest, payload_bytes and first_id: the smallest
    page_id of an equal payload if that is another page, else null.

    Only ids and digests meet by digest; the payloads move once, to their page's id.
    """
    base = pages.select("page_id", "url", text_or_empty("html").alias("html")).withColumn("digest", base32_sha1(F.col("html")))
    base = base.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    ids = base.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "digest").distinct()
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    again = ids.join(first, "digest").filter(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first_id").hint("shuffle_hash")
    return base.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """Null headers are left out. The empty line after the block is the sink's."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for k, v in headers]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, records_per_file: int | None = None) -> None:
    """Write a request, a response (or revisit) and a metadata record for every row.

    The payload is html in UTF-8 (null: empty). Of pages with equal payloads of at least
    least_bytes the one with the smallest page_id is the response and the others revisit
    it. Line breaks in a url are percent-encoded; a null url has no target header. Null
    page_ids get an empty id; repeated rows give repeated records. No rows, no records.
    A file has records_per_file records at most; by default as many as make FILE_BYTES of
    the pages' average, so that readers, who take a file whole, can hold it.
    """
    if records_per_file is None:
        average = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
        records_per_file = 3 * int(min(FILE_PAGES, max(1, FILE_BYTES // (average + 1))))
    rows = with_roles(pages, least_bytes)
    urn = lambda page, kind: F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(f":{kind}>"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    response = urn(F.col("page_id"), "response")
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    held = F.when(
        F.col("first_id").isNull(),
        _record([("WARC-Type", "response"), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], F.concat(http, F.col("html"))),
    ).otherwise(
        _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", urn(F.col("first_id"), "response")), ("Content-Type", "application/http; msgtype=response")],
            http,
        )
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", urn(F.col("page_id"), "request")), ("WARC-Concurrent-To", response), *common, ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF + CRLF}")),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", urn(F.col("page_id"), "metadata")), ("WARC-Concurrent-To", response), *common, ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)),
    )
    records = rows.select(F.explode(F.array(request, held, metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _headers(stream: io.BufferedIOBase) -> dict[str, str]:
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _parse(content: bytes, with_payload: bool) -> Iterator[tuple]:
    """Records of one archive, gzipped or not."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else io.BufferedReader(raw)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        head = _headers(stream)
        block = stream.read(int(head.get("content-length", 0)))
        kind, digest, size, payload, text = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
        if kind in ("response", "revisit"):
            top, _, payload = block.partition(b"\r\n\r\n")
            size = len(payload)
            if kind == "response":
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:
                size, payload = int(_headers(io.BytesIO(top)).get("content-length", 0)), None
        else:
            text = block.decode("utf-8", "replace")
        yield head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, size, text, payload if with_payload else None


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives under path; response digests and sizes are those
    of the payload as read, revisits give the ones they state."""
    columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                rows: list[tuple] = []
                for row in _parse(content, with_payload):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, n_concurrent.

    A request or metadata record belongs to the response it names in concurrent_to. Of
    several of a kind the smallest record id is shown and n_concurrent counts them all.
    Records that name an absent response form a capture without one; repeated responses
    give repeated captures.
    """
    response = records.filter("record_type in ('response', 'revisit')")
    nested = F.struct("record_type", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "payload")
    whole = response.select(F.col("record_id").alias("capture_id"), nested.alias("response"))
    small = F.struct("record_id", "target_uri", "date", "block")
    beside = records.filter("record_type in ('request', 'metadata')").groupBy(F.col("concurrent_to").alias("to")).agg(
        F.min(F.when(F.col("record_type") == "request", small)).alias("request"),
        F.min(F.when(F.col("record_type") == "metadata", small)).alias("metadata"),
        F.count(F.lit(1)).alias("n_concurrent"),
    )
    joined = whole.join(beside, F.col("capture_id") == F.col("to"), "full")
    return joined.select(F.coalesce("capture_id", "to").alias("capture_id"), "response", "request", "metadata", F.coalesce("n_concurrent", F.lit(0)).alias("n_concurrent"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = assemble(read_records(spark, path))
    page = lambda urn: F.expr(f"try_cast(regexp_extract({urn}, '^<urn:capture:(.*):response>$', 1) AS BIGINT)")
    return captures.select(
        page("capture_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page("response.refers_to").alias("refers_to"),
        F.col("request.block").alias("request"),
    )


def _oracle() -> str:
    groups = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0)
    )
    return f"""
WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, payload_bytes, {groups} AS payload_digest,
       CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to,
       'GET ' || coalesce(url, '/') || ' HTTP/1.1' || chr(13) || chr(10) || chr(13) || chr(10) AS request
FROM f"""


ORACLE = {"op10_warc": _oracle()}
