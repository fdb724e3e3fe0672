"""The driver's tables as contacts, track reads and annotations.

A contact is a box of two mates on two contigs. The raw views are in base pairs; the
encoded ones are in units of the dividend, with inclusive ends, as all operators take them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.operators import ingest

DIVIDEND = 10_000
CONTIG_BP = 1_020_000
CONTIGS = [(f"chr{i}", i, CONTIG_BP // DIVIDEND) for i in range(4)]
DATASETS = ["rep0", "rep1", "rep2"]
GROUP_A, GROUP_B = ["rep0", "rep1"], ["rep2"]
TRACKS = ["click", "view", "purchase"]


def contigs(spark: SparkSession) -> DataFrame:
    """(chr, ord, len) in display order; len is in dividend units."""
    return spark.createDataFrame(CONTIGS, "chr string, ord int, len long")


def customer_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, ord, len) of contigs whose lengths follow the customers of each nation."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.selectExpr("concat('nation', c_nationkey) AS chr", "c_nationkey AS ord", "n div (1 + c_nationkey % 3) AS len")


def raw_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos1, pos2 = "(l_partkey * 7919 + l_orderkey * 31) % 1000000", "(l_suppkey * 104729 + l_orderkey * 17 + l_linenumber * 4001) % 1000000"
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey * 10 + l_linenumber AS read_id",
        "concat('rep', l_orderkey % 3) AS dataset",
        "concat('chr', l_partkey % 4) AS chr_x",
        "concat('chr', l_suppkey % 4) AS chr_y",
        f"{pos1} AS pos1_s",
        f"{pos1} + CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 2000 ELSE 0 END AS pos1_e",
        f"{pos2} AS pos2_s",
        f"{pos2} + CASE WHEN l_linenumber % 5 = 0 THEN 7000 ELSE 0 END AS pos2_e",
        "CAST(floor(l_quantity) AS INT) AS mapq",
        "l_returnflag = 'N' AS strand1",
        "l_linestatus = 'O' AS strand2",
        "1L AS cnt",
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.encode_contacts(raw_contacts(spark, sf_dir), DIVIDEND)


def raw_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS read_id",
        "event_type AS dataset",
        "concat('chr', user_id % 4) AS chr",
        "(event_id * 997 + user_id * 131) % 1000000 AS pos",
        "CAST(floor(value) AS INT) % 61 AS mapq",
        "event_id % 2 = 0 AS strand",
        "1L AS cnt",
    )


def track_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.encode_track(raw_track(spark, sf_dir), DIVIDEND)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "(p_partkey * 38971) % 950000"
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "CASE WHEN p_size <= 25 THEN 'gene' ELSE 'exon' END AS type",
        "concat('chr', p_partkey % 4) AS chr",
        f"{start} AS start_bp",
        f"{start} + p_size * 200 AS end_bp",
        "p_partkey % 2 = 0 AS forw",
        "p_name AS info",
        "p_partkey AS desc_id",
    )


def annotation_contacts(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("gene", "exon")) -> DataFrame:
    """Contacts with cat_x and cat_y: for each kind 0 where the first locus lies in an
    annotation of it and 1 elsewhere."""
    return ingest.with_categories(raw_contacts(spark, sf_dir), annotations(spark, sf_dir), kinds, DIVIDEND)


