"""A folder of datasets: contacts, summaries of them at several resolutions, and a manifest.

    <folder>/settings.json      dividend, factors of the summaries
    <folder>/contigs            chr, ord, len
    <folder>/data/<batch>/...   one table for each resolution, written before
    <folder>/manifest           one row for each batch of a dataset, only ever appended

What the manifest doesn't name isn't there, so a batch appears as a whole when its row is
written, and one that failed on the way is never read.
"""

from __future__ import annotations

import json
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.operators import count, ingest
from gridspan.plans.axis import genome_axis
from gridspan.plans.heatmap import Heatmap

MANIFEST = "batch string, dataset string, total long, only_upper boolean, only_lower boolean, has_multi boolean, has_map_q boolean, has_strand boolean"
#: Resolutions of summaries, in units; 1 keeps all positions.
FACTORS = (1, 5, 50)
#: What a filter needs of a dataset, and what it does to one without.
NEEDS = {"map_q": "mapping qualities: the filter lets all of its reads through", "strand": "strands: the filter lets all of its reads through", "multi": "reads of several loci: none of its reads counts"}
KEYS = ("dataset", "chr_x", "chr_y", "x_s", "x_e", "y_s", "y_e", "point", "bucket", "same_strand", "y_strand", "cat_x", "cat_y")


def summary(contacts: DataFrame, factor: int) -> DataFrame:
    """contacts with positions in steps of factor units, those that no filter can tell apart
    counted once: cnt sums them, reads is how many rows they were. point tells boxes of one
    unit on both sides."""
    step = {c: F.expr(f"{c} div {factor}") for c in ("x_s", "x_e", "y_s", "y_e")}
    rows = contacts.withColumn("point", F.expr("x_s = x_e and y_s = y_e")).withColumns(step)
    return rows.groupBy(*[c for c in KEYS if c in rows.columns]).agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("reads"))


def as_contacts(rows: DataFrame, contigs: DataFrame, factor: int) -> DataFrame:
    """A summary's rows as contacts for bins whose edges are multiples of factor or ends of
    contigs. Boxes begin with their step and, if they weren't points, end with it, so every
    test but that a box encloses a bin has its answer."""
    if factor == 1:
        return rows
    ends = contigs.select("chr", "len").distinct()
    for s in "xy":
        rows = rows.join(F.broadcast(ends.toDF("_c", "_n")), F.col(f"chr_{s}") == F.col("_c"))  # a row for each contig
        last = F.least((F.col(f"{s}_e") + 1) * factor, F.col("_n")) - 1
        rows = rows.withColumns({f"{s}_e": F.when(F.col("point"), F.col(f"{s}_e") * factor).otherwise(last), f"{s}_s": F.col(f"{s}_s") * factor}).drop("_c", "_n")
    return rows


class Store:
    """An opened folder. Methods that return DataFrames read what the manifest named when they
    were called; the manifest is small, a row for each batch ever added."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        settings = json.loads("\n".join(r["value"] for r in spark.read.text(f"{self.folder}/settings.json").collect()))
        self.dividend, self.factors = settings["dividend"], tuple(settings["factors"])
        self.contigs = spark.read.parquet(f"{self.folder}/contigs")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, contigs: DataFrame, dividend: int, factors: tuple[int, ...] = FACTORS) -> Store:
        """A new store; an existing one is an error."""
        if 1 not in factors:
            raise ValueError("factor 1 keeps the positions that other steps are summed from")
        contigs.select("chr", "ord", "len").write.parquet(f"{folder}/contigs")
        spark.createDataFrame([], MANIFEST).write.parquet(f"{folder}/manifest")
        line = json.dumps({"dividend": dividend, "factors": sorted(factors)})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder}/settings.json")
        return cls(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, name: str, suffix: str = ".store") -> Store:
        """The store that name or name with the suffix is the folder of."""
        for folder in (name, f"{name}{suffix}"):
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/settings.json")
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                return cls(spark, folder)
        raise FileNotFoundError(f"neither {name} nor {name}{suffix} is a store")

    def _batches(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def add(self, dataset: str, contacts: DataFrame, batch: str | None = None) -> str:
        """Add encoded contacts to a dataset, new or not, and return the batch's name. Steps are
        summed from one another, so the contacts are read once; without any the dataset is
        still listed. A batch that has a name is added once, however often it is asked for."""
        if batch is not None and not self._batches().filter(F.col("batch") == batch).isEmpty():
            return batch
        batch = batch or uuid.uuid4().hex
        rows, before = contacts.withColumn("dataset", F.lit(dataset)), 1
        rows = ingest.known_contigs(rows, self.contigs, "chr_x", "chr_y")
        for factor in self.factors:
            at = f"{self.folder}/data/{batch}/{factor}"
            if factor == 1:
                table = summary(rows, 1)
            else:
                fine = self.spark.read.parquet(f"{self.folder}/data/{batch}/{before}") if factor % before == 0 else self.spark.read.parquet(f"{self.folder}/data/{batch}/1")
                step = {c: F.expr(f"{c} div {factor // before if factor % before == 0 else factor}") for c in ("x_s", "x_e", "y_s", "y_e")}
                table = fine.withColumns(step).groupBy(*[c for c in KEYS if c in fine.columns]).agg(F.sum("cnt").alias("cnt"), F.sum("reads").alias("reads"))
            table.write.mode("overwrite").parquet(at)
            before = factor
        kept = self.spark.read.parquet(f"{self.folder}/data/{batch}/1")
        found = ingest.diagnostics(kept.drop("total_reads"), self.contigs).drop("total_reads").join(kept.groupBy("dataset").agg(F.sum("reads").alias("total")), "dataset")
        none = self.spark.createDataFrame([(batch, dataset)], "batch string, dataset string")
        flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("only_upper", "only_lower", "has_multi", "has_map_q", "has_strand")]
        none.join(found, "dataset", "left").select("batch", "dataset", F.coalesce("total", F.lit(0)).alias("total"), *flags).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return batch

    def datasets(self) -> DataFrame:
        """dataset, batches, total, only_upper, only_lower, has_multi, has_map_q, has_strand, symmetry
        (mirror for one triangle). A batch without reads says nothing of what a dataset has."""
        read = F.col("total") > 0
        one = lambda c: F.coalesce(F.bool_and(F.when(read, F.col(c))), F.lit(False)).alias(c)
        some = lambda c: F.coalesce(F.bool_or(F.when(read, F.col(c))), F.lit(False)).alias(c)
        rows = self._batches().groupBy("dataset").agg(F.count(F.lit(1)).alias("batches"), F.sum("total").alias("total"), one("only_upper"), one("only_lower"), some("has_multi"), some("has_map_q"), some("has_strand"))
        return rows.withColumn("symmetry", F.when(F.col("only_upper") | F.col("only_lower"), "mirror").otherwise("all"))

    def contacts(self, datasets: list[str], factor: int = 1) -> DataFrame:
        """Contacts of these datasets, from the summaries of one step. None that is listed is an error."""
        known = self._batches().collect()
        if missing := sorted({*datasets} - {r["dataset"] for r in known}):
            raise ValueError(f"not in the store: {', '.join(missing)}")
        parts = [f"{self.folder}/data/{r['batch']}/{factor}" for r in known if r["dataset"] in datasets]
        return as_contacts(self.spark.read.option("mergeSchema", True).parquet(*parts), self.contigs, factor)

    def warnings(self, datasets: list[str], wanted: dict[str, bool]) -> list[str]:
        """What of wanted (map_q, strand, multi) each dataset can't be filtered by. Those without reads lack all."""
        rows = sorted(r for r in self.datasets().collect() if r["dataset"] in datasets)
        return [f"{r['dataset']} has no {NEEDS[k]}" for k in sorted(NEEDS) if wanted.get(k) for r in rows if not r[f"has_{k}"]]

    def coarsest(self, bin_size: tuple[int, int], window: tuple[int, int, int, int] | None, mode: str, cut_off: str = "larger", whole: bool = True) -> int:
        """The largest step that a heatmap's bins are cut at. Its bins begin at multiples of it
        in each contig, and the box test is one that summaries answer; else it is 1."""
        if mode == "encloses" or not whole:
            return 1
        starts = []
        for side, size in enumerate(bin_size):
            axis = genome_axis(self.contigs, size, cut_off, window[2 * side : 2 * side + 2] if window else None)
            edges = axis.grid.join(self.contigs.select("chr", "len"), "chr").select("origin", "step", F.when(F.col("stop") == F.col("len"), 0).otherwise(F.col("stop")))
            starts += [v for r in edges.collect() for v in r]  # a row for each contig
        return max(f for f in self.factors if all(v % f == 0 for v in starts))

    def heatmap(self, group_a: list[str], group_b: list[str] | None = None, map_q: tuple[int, int, bool] | None = None, direction: str = "all", mode: str = "enclosed", **settings) -> Heatmap:
        """A heatmap of the store's datasets, over the coarsest summaries that answer it. Datasets
        that lack what a filter asks for are warned of: qualities and strands let them pass as a whole."""
        group_b = group_b or []
        names = [*group_a, *group_b]
        wanted = {"map_q": map_q is not None, "strand": direction != "all", "multi": mode.endswith("_only")}
        for line in self.warnings(names, wanted):
            warnings.warn(line, stacklevel=2)
        lacking = {k: [r["dataset"] for r in self.datasets().filter(~F.col(f"has_{k}")).collect()] for k in ("map_q", "strand") if wanted[k]}
        passing = lambda k, test: F.col("dataset").isin(lacking[k]) | test if lacking[k] else test
        filters = list(settings.pop("filters", []))
        filters += [passing("map_q", count.map_quality(*map_q))] if map_q else []
        filters += [passing("strand", count.directionality(direction))] if direction != "all" else []
        whole = settings.get("ddd") is None and settings.get("normalize") != "grid-seq" and not any(settings.get("annotated", ()))
        factor = self.coarsest(settings.get("bin_size", (1, 1)), settings.get("window"), mode, settings.get("cut_off", "larger"), whole)
        totals = self.datasets().select("dataset", "total")
        return Heatmap(self.contacts(names, factor), self.contigs, self.dividend, group_a, group_b, filters=filters, mode=mode, totals=totals, **settings)

