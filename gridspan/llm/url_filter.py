"""URL filters: host-suffix and path-prefix rules joined on short hash prefixes.

Every url is cut into the (host suffix, path prefix) expressions that some rule could
equal. Expressions and rules meet in an equi-join on the first 32 bits of a SHA-256,
the whole digest confirms a meeting, and the longest confirmed rule decides. All of it
is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RULES_SCHEMA = "host string, path string, verdict string"

#: (host, path, verdict) of the default list.
DEFAULT_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Hex digits of the digest that the join uses.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(rest, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with digest and shape. Rows without host, path or a known verdict are no rules;
    of equal rules with both verdicts, block stands."""
    host, path = ascii_lower(F.col("host")), F.col("path")
    return (
        rules.filter("host is not null and host <> '' and path is not null and verdict in ('allow', 'block')")
        .groupBy(host.alias("rule_host"), path.alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("hash_prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .withColumn("labels", F.size(F.split("rule_host", r"\.")))
        .withColumn("path_len", F.length("rule_path"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule (`host` + `path`, or null), verdict.

    Only id_col and url_col are read, so other columns may have any name. A null url, or
    one without ://, has an empty host and path and gets the default verdict, as does a
    url that no rule fits. Repeated rows and null ids are kept. Of rules of equal length
    the one with the longer host wins, then the greater string. An empty table gives an
    empty table; without rules everything gets the default.

    The shapes (host labels, path length) that occur among the rules come to the driver:
    there are at most as many as a url's labels times its path lengths. The rules
    themselves are joined; Spark broadcasts them only if they are as small as its
    threshold says, and otherwise sorts and merges both sides.
    """
    table = rule_table(rules)
    shapes = sorted((r[0], r[1]) for r in table.select("labels", "path_len").distinct().collect())
    urls = pages.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    ).withColumn("labels", F.split("host", r"\."))

    def expression(n: int, length: int) -> Column:
        suffix = F.array_join(F.slice("labels", F.size("labels") - n + 1, n), ".")
        prefix = F.substring("path", 1, length)
        fits = (F.size("labels") >= n) & (F.length("path") >= length) & (F.col("host") != "")
        return F.when(fits, _digest(suffix, prefix))

    cuts = F.array_compact(F.array(*[expression(n, k) for n, k in shapes])) if shapes else F.array().cast("array<string>")
    cut = urls.select("id", "host", "path", F.explode(cuts).alias("expr")).withColumn("hash_prefix", F.substring("expr", 1, PREFIX_DIGITS))
    met = cut.join(table.drop("labels", "path_len"), "hash_prefix").filter(F.col("expr") == F.col("digest"))
    name = F.concat("rule_host", "rule_path")
    confirmed = F.struct(F.length(name).alias("n"), F.length("rule_host").alias("h"), name.alias("rule"), F.col("rule_verdict").alias("verdict"))
    rules_met = met.select("id", "host", "path", confirmed.alias("fits"), F.lit(0).alias("row"))
    # each row itself, whether or not a rule fits it
    rows = urls.select("id", "host", "path", F.lit(None).cast(rules_met.schema["fits"].dataType).alias("fits"), F.lit(1).alias("row"))
    judged = rows.unionByName(rules_met).groupBy("id", "host", "path").agg(F.max("fits").alias("best"), F.sum("row").alias("copies"))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(DEFAULT_RULES, RULES_SCHEMA)
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = {
    "op2_url_filter": r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
n AS (SELECT *, row_number() OVER () AS k FROM u),
f AS (
  SELECT k, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
  FROM n JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM n LEFT JOIN f USING (k)
""",
}
