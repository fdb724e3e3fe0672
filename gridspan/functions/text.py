"""Labels and names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def readable_bp(n: Column) -> Column:
    """Base pairs with the largest unit that divides them."""
    whole = lambda unit, name: F.concat(with_commas(F.floor(n / unit).cast("long")), F.lit(f" {name}"))
    return F.when(n == 0, "0 bp").when(n % 1_000_000 == 0, whole(1_000_000, "Mbp")).when(n % 1_000 == 0, whole(1_000, "kbp")).otherwise(whole(1, "bp"))


def shortened(name: Column, most: int, suffix: str = "") -> Column:
    """A name without the common suffix, cut after most characters."""
    cut = F.when(name.endswith(suffix), F.expr("1") * 0 + F.length(name) - len(suffix)).otherwise(F.length(name)) if suffix else F.length(name)
    bare = F.substring(name, F.lit(1), cut) if suffix else name
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("..."))).otherwise(bare)


def numbered_labels(rows: DataFrame, short: str, order: str) -> DataFrame:
    """rows with label: equal short names get a number each."""
    w = Window.partitionBy(short)
    number, n = F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w)
    return rows.withColumns({"_n": n, "_r": number}).withColumn("label", F.when(F.col("_n") > 1, F.concat(F.col(short), F.lit(" ("), F.col("_r").cast("string"), F.lit(")"))).otherwise(F.col(short))).drop("_n", "_r")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def simplified_path(path: Column) -> Column:
    """The file's name without folders and suffixes."""
    return F.regexp_extract(path, r"([^/.]+)(?:\.[^/]*)?$", 1)


def gff_attribute(attributes: Column, name: str) -> Column:
    """The value of a key in `key=value` lines; empty if there is none."""
    return F.regexp_extract(attributes, rf"(?m)^{re.escape(name)}=(.*)$", 1)
