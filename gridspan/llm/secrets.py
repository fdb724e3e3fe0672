"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256. Only blobs that the ledger has not
yet seen under the present rule version are scanned, each once however many paths hold
it, and the ledger's findings are joined back to all paths. All of it is built-in SQL
functions.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, new_path, staged, text_or_empty

#: A private key from BEGIN to the next END; without one (or with another BEGIN before it),
#: over the header fields and base64 lines that follow. A run of 16 base64 characters, or a
#: shorter one alone on its line, goes on; backslashes are those of escaped line ends.
_BASE64 = r"[A-Za-z0-9+/=\\]"
_GOES_ON = rf"\s*+(?:(?={_BASE64}{{16}})|(?<=[\r\n][ \t]{{0,8}})(?={_BASE64}++[ \t]*+(?:[\r\n]|\z))){_BASE64}++"
PEM = (
    r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,32}PRIVATE KEY-----"
    r"|(?:\s*+(?:[A-Z][A-Za-z0-9]*-[A-Za-z0-9-]+|Comment): [^\r\n]*+){0,8}"
    rf"{_BASE64}*+(?:{_GOES_ON})*+)"  # possessive: no character is looked at again
)

#: (kind, pattern, group whose length is tested, least length). Base kinds come first.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # runs below the least length never hold a longer one, so the length is in the pattern
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", PEM, 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("vcs", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
]
BASE_KINDS = ("assign", "access", "hex")
#: A changed rule is another version, so nothing that older rules found is reused.
RULE_VERSION = zlib.crc32(repr(RULES).encode()) >> 1

LEDGER_SCHEMA = "blob string, rule_version int, spans array<struct<start:int,kind_no:int,end:int>>"


def _spans(text: Column, kind_no: int) -> Column:
    """Leftmost non-overlapping matches of one rule, as (start, kind_no, end) in code points.

    split() cuts at the matches that regexp_extract_all() returns, so a match starts
    after all gaps and matches before it.
    """
    _, pattern, group, least = RULES[kind_no]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length),
        F.transform(matches, F.length),
        F.transform(tested, F.length),
    )
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    span = lambda acc, x: F.struct(
        (acc["at"] + x["0"] + F.coalesce(x["1"], F.lit(0))).alias("at"),
        F.when(
            x["2"] >= least,
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["0"]).alias("start"), F.lit(kind_no).alias("kind_no"), (acc["at"] + x["0"] + x["1"]).alias("end")))),
        ).otherwise(acc["out"]).alias("out"),
    )
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), span, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, text) to (blob, spans); spans are in order of start, then kind."""
    spans = F.array_sort(F.concat(*[_spans(F.col("text"), k) for k in range(len(RULES))]))
    return blobs.select("blob", spans.alias("spans"))


def scan_incrementally(docs: DataFrame, ledger: str | None = None, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: path_col, blob, spans (start, kind_no, end; end exclusive).

    ledger is the folder of a table (blob, rule_version, spans) that later calls reuse and
    add to; without one a new table is made. Null texts count as empty. Repeated rows and
    null paths are kept, other columns aren't read. An empty table gives an empty table.
    Of the texts only one copy per unseen blob moves between executors, to the side of
    the (much smaller) list of unseen blobs.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    texts = docs.select(F.col(path_col).alias("path"), text_or_empty(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = texts.select("path", "blob")
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    try:
        seen = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).filter(F.col("rule_version") == RULE_VERSION)
        first = first.join(seen.select("blob"), "blob", "left_anti")
    except Exception as e:  # only a missing table starts a new ledger
        if "PATH_NOT_FOUND" not in str(e):
            raise
    unseen = first.select(F.col("blob").alias("new_blob"), F.col("path").alias("new_path")).hint("shuffle_hash")
    blobs = texts.join(unseen, (F.col("blob") == F.col("new_blob")) & F.col("path").eqNullSafe(F.col("new_path"))).select("blob", "text")
    found = scan(blobs).groupBy("blob").agg(F.max("spans").alias("spans"))  # equal rows give a blob twice
    found.select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans").write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).filter(F.col("rule_version") == RULE_VERSION)
    hits = known.filter(F.size("spans") > 0).select("blob", "spans")
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    return paths.join(hits, "blob", "left").select(F.col("path").alias(path_col), "blob", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: str | None = None, path_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span that the ledger holds for its text replaced by mark;
    overlapping spans give one mark. Texts are scanned as in scan_incrementally().

    All columns and rows stay; null texts and those without a secret are as they were.
    The list of blobs with a secret is small beside the texts, which move to its side.
    """
    found = scan_incrementally(docs, ledger, path_col, text_col).filter(F.size("spans") > 0)
    blob, spans = fresh(docs, "blob"), fresh(docs, "spans")
    hits = staged(found.groupBy(F.col("blob").alias(blob)).agg(F.max("spans").alias(spans)), "secret-hits").hint("shuffle_hash")
    text = F.col(text_col)
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    joined = docs.join(hits, F.sha2(text, 256) == F.col(blob), "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNotNull(), clean).otherwise(text)).select(docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_incrementally(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
