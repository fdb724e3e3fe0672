"""What the training-data operators share: staged tables and input columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, else (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("gridspan.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gridspan-")
        spark.conf.set("gridspan.shared.dir", found)
    return found.rstrip("/")


#: What this process has put in the shared folder.
_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def remove_staged(spark: SparkSession, keep: tuple[str, ...] = (), since: int = 0) -> None:
    """Delete what was staged since so many paths ago, except the paths in keep. DataFrames
    that read it can't be used any more."""
    for path in [p for p in _written[since:] if p not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def staged_so_far() -> int:
    return len(_written)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a
    lost executor costs a re-read instead of the work before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def slices(part: pa.RecordBatch, column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows, of which only the last may bring the
    bytes in column to size or beyond."""
    lengths = pc.fill_null(pc.binary_length(part.column(column)), 0).to_pylist()
    begin = held = 0
    for at, n in enumerate(lengths):
        held += n
        if held >= size or at + 1 - begin == rows:
            yield part.slice(begin, at + 1 - begin)
            begin, held = at + 1, 0
    if begin < part.num_rows:
        yield part.slice(begin)
