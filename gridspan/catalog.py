"""Every query over the contact-map operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspan.checks import annotating, base, counting, filing, ingesting, normalizing, parsing, planning, storing, tracking, viewing, whole  # noqa: F401  they register their queries


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["k1_heatmap_export"](spark, sf_dir)
