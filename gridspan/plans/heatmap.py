"""The whole heatmap query as one plan: filter, count, fold, combine, correct, normalise, scale."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.operators import combine, count, decay, ingest, normalize, sampling, tracks
from gridspan.plans import axis as axes_of
from gridspan.plans.annotation_window import AnnotationAxis, annotation_bins
from gridspan.plans.axis import Axis, genome_axis
from gridspan.plans.viewpoint import viewpoint_axis

NORMALIZATIONS = ("dont", "rpm", "rpk", "radicl-seq", "ice", "cool-ice", "grid-seq")


@dataclass
class Balancing:
    """Settings of iterative correction: masks and the diagonals that margins leave out."""

    min_nz: int = 10
    sparse: float = 0.0
    mad_max: float = 5.0
    ignore_diagonals: int = 2
    rounds: int = normalize.ROUNDS


@dataclass
class Associated:
    """Settings of the associated slices: line_sweep() rows of one annotation, how many
    samples of it (None: all), least coverages, and the size that tiles are halved to."""

    sweep: DataFrame | None = None
    samples: int | None = 1000
    thresholds: tuple[int, int] = (1, 1)
    most: int = 10
    by_column: bool = True
    intersection: bool = True
    ignore_cis: bool = True


@dataclass
class Decay:
    """Settings of distance-dependent decay; most None takes all samples."""

    least: int = 1
    most: int | None = 200
    quantile: float = 80.0


@dataclass
class Heatmap:
    """Settings of one heatmap over contacts and contigs. Methods return DataFrames that
    nothing has computed yet, but for iterative correction, which loops over small tables.

    filters are about the read as a whole. Annotation filters are named by present and
    absent (a tuple of kinds for each of x and y): for the mirrored bin they change sides.
    annotated names the line_sweep() rows of an annotation for x, y or both: such an axis is
    made of them by the rules across and several, and its window is in their places.
    totals (dataset, total) are the reads of datasets where contacts are summaries of them.
    contigs may have actual and ploidy_group: then copies of a contig are displayed, and
    ploidy_rules says which pairs of copies are real.
    """

    contacts: DataFrame
    contigs: DataFrame
    dividend: int
    group_a: list[str]
    group_b: list[str] = field(default_factory=list)
    bin_size: tuple[int, int] = (1, 1)
    window: tuple[int, int, int, int] | None = None
    cut_off: str = "larger"
    show_small: bool = False
    annotated: tuple[DataFrame | None, DataFrame | None] = (None, None)
    across: str = "stretch"
    several: str = "combine"
    filters: list[Column] = field(default_factory=list)
    kinds: tuple[str, ...] = ()
    present: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())
    absent: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())
    mode: str = "enclosed"
    symmetry: str = "all"
    least: int = 0
    diagonal: int = 0
    in_group: str = "sum"
    ploidy_rules: dict[str, bool] = field(default_factory=dict)
    ddd: Decay | None = None
    normalize: str = "dont"
    by_column: bool = True
    p_accept: float = 0.05
    balancing: Balancing = field(default_factory=Balancing)
    associated: Associated = field(default_factory=Associated)
    between_group: str = "sum"
    scale: str = "max"
    dense: bool = False
    totals: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.normalize not in NORMALIZATIONS:
            raise ValueError(f"normalize is none of {NORMALIZATIONS}")

    @classmethod
    def for_area(cls, contacts: DataFrame, contigs: DataFrame, dividend: int, group_a: list[str], area: tuple[int, int, int, int], interface: dict, margin: float = 0.0, full: bool = False, **settings) -> Heatmap:
        """The heatmap of an area under the interface's settings, which choose the bin size;
        the window is the area with its margin, in whole bins."""
        size = axes_of.bin_size(area, interface, dividend)
        genome = contigs.agg(F.sum("len")).first()[0] or 0  # a sum over contigs
        window = axes_of.render_area(area, size, margin, genome, full)
        return cls(contacts, contigs, dividend, group_a, bin_size=size, window=window, **settings)

    def axes(self) -> tuple[Axis | AnnotationAxis, Axis | AnnotationAxis]:
        w = self.window
        parts = (w[:2], w[2:]) if w else (None, None)
        return self._axis(0, parts[0]), self._axis(1, parts[1])

    def _axis(self, side: int, part: tuple[int, int] | None) -> Axis | AnnotationAxis:
        if self.annotated[side] is None:
            return genome_axis(self.contigs, self.bin_size[side], self.cut_off, part, self.show_small)
        return annotation_bins(self.annotated[side], self.contigs, self.bin_size[side], self.across, self.several, part)

    def bins(self) -> DataFrame:
        """One row: the number of bins of the window."""
        x, y = self.axes()
        return x.size().crossJoin(F.broadcast(y.size().withColumnRenamed("bins", "_y"))).select((F.col("bins") * F.col("_y")).alias("bins"))  # single rows

    def names(self) -> list[str]:
        return sorted({*self.group_a, *self.group_b})

    def filtered(self, mirrored: bool = False) -> DataFrame:
        """The reads that count, or those that count for mirrored bins: their annotation
        filters are exchanged, and their mates aren't yet."""
        rows = self.contacts.filter(F.col("dataset").isin(*self.names()))
        for f in self.filters:
            rows = rows.filter(f)
        turn = -1 if mirrored else 1
        return rows.filter(count.categories(self.kinds, self.present[::turn], self.absent[::turn])) if self.kinds else rows

    def counts(self) -> DataFrame:
        """(dataset, xi, yi, n): folded counts; the mirrored bin is only counted if needed."""
        x, y = self.axes()
        if self.symmetry == "all":
            rows = count.bin_counts(self.filtered(), x, y, self.mode).withColumnRenamed("n", "a").withColumn("b", F.lit(0))
        else:
            rows = count.both_orientations(self.filtered(), x, y, self.mode, self.filtered(mirrored=True))
        return rows.select("dataset", "xi", "yi", count.fold(F.col("a"), F.col("b"), self.symmetry, self.least).alias("n"))

    def grouped(self) -> DataFrame:
        return combine.group_values(self.counts(), F.col("n"), self.group_a, self.group_b, self.in_group)

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (xi, yi, ...) with chr, actual, pos and size of both sides."""
        x, y = self.axes()
        return rows.join(x.side("x"), "xi").join(y.side("y"), "yi")

    def corrected(self) -> DataFrame:
        """(xi, yi, va, vb) for each copy of a contig, over the number of real copies."""
        rows = self.grouped()
        if "ploidy_group" not in self.contigs.columns:
            return rows
        spots = combine.ploidy_divisors(self.contigs.select("chr", F.col("actual"), "ploidy_group"), **self.ploidy_rules)
        met = self.placed(rows).join(F.broadcast(spots), ["chr_x", "chr_y"])  # pairs of contigs
        per = lambda v: F.when(F.col("spots") > 0, F.try_divide(v, "spots")).otherwise(0.0).alias(v)
        return met.select("xi", "yi", per("va"), per("vb"))

    def decays(self) -> DataFrame:
        """(chr_x, chr_y, lo, hi, va, vb) of the bands of the window's bins; contigs are actual ones."""
        x, y = self.axes()
        grid = x.side("x").crossJoin(y.side("y"))  # the interface bounds the number of bins
        if not self.dense:
            grid = self.placed(self.corrected().select("xi", "yi"))
        bands = decay.bands(grid.withColumns({"chr_x": F.col("actual_x"), "chr_y": F.col("actual_y")}))
        lengths = self.contigs.select(F.col("actual" if "actual" in self.contigs.columns else "chr").alias("chr"), "len").distinct()
        d = self.ddd or Decay()
        return decay.group_decay(bands, lengths, self.filtered(), self.filtered(mirrored=True), self.group_a, self.group_b, self.in_group, self.symmetry, self.least, d.least, d.most, d.quantile)

    def undecayed(self) -> DataFrame:
        rows = self.corrected()
        if self.ddd is None:
            return rows
        found = self.decays().select(F.col("chr_x").alias("actual_x"), F.col("chr_y").alias("actual_y"), "lo", "hi", F.col("va").alias("da"), F.col("vb").alias("db"))
        keys = ["actual_x", "actual_y", "lo", "hi"]
        met = decay.bands(self.placed(rows)).join(found, keys, "left")
        per = lambda v, d: F.when(F.col(d) > 0, F.try_divide(v, d)).otherwise(0.0).alias(v)
        return met.select("xi", "yi", per("va", "da"), per("vb", "db"))

    def normalized(self) -> DataFrame:
        """va, vb by the chosen normalisation. The binomial test looks at counts before the
        decay is taken out, all others after."""
        by = {"dont": self.undecayed, "rpm": lambda: self._per_reads(1e6), "rpk": lambda: self._per_reads(1e3), "radicl-seq": self._significant}
        return by.get(self.normalize, self._balanced if self.normalize in ("ice", "cool-ice") else self._associated)()

    def _per_reads(self, unit: float) -> DataFrame:
        return self._over_totals(self.undecayed(), unit, ("xi", "yi"))

    def _over_totals(self, rows: DataFrame, unit: float, keys: tuple[str, ...]) -> DataFrame:
        total = count.fold(F.col("total"), F.col("total"), self.symmetry)
        totals = combine.group_values((ingest.totals(self.contacts) if self.totals is None else self.totals).withColumn("k", F.lit(1)), total, self.group_a, self.group_b, self.in_group, ("k",))
        rows = rows.crossJoin(F.broadcast(totals.select(F.col("va").alias("ta"), F.col("vb").alias("tb"))))  # a single row
        return rows.select(*keys, combine.per(F.col("va"), F.col("ta"), unit).alias("va"), combine.per(F.col("vb"), F.col("tb"), unit).alias("vb"))

    def _significant(self) -> DataFrame:
        x, y = self.axes()
        tests = (y if self.by_column else x).size().withColumnRenamed("bins", "tests")
        out, rows = None, self.corrected()
        for v in ("va", "vb"):
            grid = rows.select("xi", "yi", F.col(v).alias("v")).filter("v > 0").crossJoin(F.broadcast(tests))  # a single row
            found = normalize.binomial(grid, "xi" if self.by_column else "yi", self.p_accept, F.col("tests"))
            found = found.select("xi", "yi", F.col("significant").cast("double").alias(v))
            out = found if out is None else out.join(found, ["xi", "yi"], "full")
        return out.select("xi", "yi", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in ("va", "vb")])

    def biases(self) -> dict[str, tuple[DataFrame, DataFrame, bool]]:
        """By group (va, vb) the biases (xi, bx) and (yi, by), and whether they converged."""
        x, y = self.axes()
        sizes = x.size().first()[0], y.size().first()[0]
        if self.normalize == "cool-ice" and sizes[0] != sizes[1]:
            raise ValueError("cool-ice needs axes of equal size")
        b, rows = self.balancing, self.placed(self.undecayed())
        out = {}
        for v, group in (("va", self.group_a), ("vb", self.group_b)):
            if group:
                grid = normalize.ignore_diagonals(rows.withColumn("v", F.col(v)), b.ignore_diagonals, self.bin_size)
                out[v] = normalize.balance(grid.select("xi", "yi", "v"), sizes, b.min_nz, b.sparse, b.mad_max, b.rounds)
        return out

    def _balanced(self) -> DataFrame:
        rows = self.undecayed()
        for v, (bias_x, bias_y, done) in self.biases().items():
            if not done:
                warnings.warn("iterative correction did not converge, or left nothing to correct", stacklevel=3)
            rows = normalize.balanced(rows.withColumn("v", F.col(v)), bias_x, bias_y).withColumn(v, F.col("v")).drop("v")
        return rows.select("xi", "yi", "va", "vb")

    def background(self) -> DataFrame:
        """(idx, background) of the slices that associated slices are divided by."""
        a = self.associated
        if a.sweep is None:
            raise ValueError("grid-seq needs the intervals of an annotation")
        lengths = self.contigs.select(F.col("actual" if "actual" in self.contigs.columns else "chr").alias("chr"), "len").distinct()
        rows = a.sweep.join(F.broadcast(lengths.select("chr")), "chr", "left_semi").select("desc_id", F.col("interval_id").alias("x"), "chr", "i_s", "i_e")
        picked = sampling.take(rows, a.samples, "x", "desc_id") if a.samples else sampling.first_of(rows, "x", "desc_id")
        samples = picked.select(F.col("desc_id").alias("sample"), "chr", F.col("i_s").alias("low"), F.col("i_e").alias("high"))
        turn = (lambda d: d) if a.by_column else count.transposed
        x, y = self.axes()
        side = x if a.by_column else y
        bins = side.bins().join(side.copies(), "chr")
        straight, flipped = turn(self.filtered()), turn(self.filtered(mirrored=True))
        return tracks.associated_background(straight, flipped, samples, bins, (lengths, lengths), self.names(), self.symmetry, self.least, a.thresholds, a.most, a.intersection, a.ignore_cis)

    def _associated(self) -> DataFrame:
        key = "xi" if self.associated.by_column else "yi"
        rows = self.undecayed().join(self.background().withColumnRenamed("idx", key), key, "left")
        per = lambda v: F.try_divide(v, F.greatest(F.lit(1), F.coalesce("background", F.lit(0)))).alias(v)
        return rows.select("xi", "yi", per("va"), per("vb"))

    def values(self) -> DataFrame:
        """(xi, yi, v, scaled) with both bins' places: of the non-empty bins, or of all if
        dense. Scaling knows of the empty ones either way."""
        rows = self.normalized().select("xi", "yi", combine.between(F.col("va"), F.col("vb"), self.between_group).alias("v"))
        empty = 1.0 if self.between_group == "div+" else 0.0
        if self.dense:
            x, y = self.axes()
            grid = x.side("x").crossJoin(y.side("y"))  # the interface bounds the number of bins
            rows = grid.join(rows, ["xi", "yi"], "left").withColumn("v", F.coalesce("v", F.lit(empty)))
        else:
            rows = self.placed(rows)
        if self.diagonal:
            rows = rows.withColumn("v", F.when(count.near_diagonal(self.diagonal), 0.0).otherwise(F.col("v")))
        return combine.scaled(rows, self.scale, "v", self.bins(), empty)

    def colored(self, low: float = 0.0, high: float = 1.0, base: float = 10.0, colors: int = 256) -> DataFrame:
        """values() with color, the palette's entry."""
        return self.values().withColumn("color", combine.color_index(F.col("scaled"), low, high, base, colors, self.between_group == "sub"))

    def table(self, low: float = 0.0, high: float = 1.0, base: float = 10.0, colors: int = 256) -> DataFrame:
        """What a viewer shows of each bin: places (base pairs), score_a and score_b of the
        groups, score_total, ranged (the score within the colour range) and color."""
        groups = self.normalized().select("xi", "yi", F.col("va").alias("score_a"), F.col("vb").alias("score_b"))
        rows = self.colored(low, high, base, colors).join(groups, ["xi", "yi"], "left")
        at = lambda s, end: ((F.col(f"{s}_pos") + (F.col(f"{s}_size") if end else 0)) * self.dividend).alias(f"{'end' if end else 'start'}_{s}")
        ranged = (F.col("scaled") - low) / (high - low) if high != low else F.lit(0.0)
        filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("score_a", "score_b")]
        return rows.select("chr_x", at("x", False), at("x", True), "chr_y", at("y", False), at("y", True), F.col("scaled").alias("score_total"), ranged.alias("ranged"), "color", *filled)

    def slice_tracks(self) -> DataFrame:
        """(track, idx, value) that the normalisation looks at, by slice: coverage and filled
        bins of each group, the background of associated slices, or biases of both axes."""
        groups = {"va": "A", "vb": "B"}
        if self.normalize == "radicl-seq":
            axis, parts, rows = "xi" if self.by_column else "yi", [], self.corrected()
            for v, group in groups.items():
                found = normalize.slice_coverage(rows.select(axis, F.col(v).alias("v")), axis)
                for column, name in (("coverage", "coverage"), ("filled", "non-empty bins")):
                    parts.append(found.select(F.lit(f"{name} {group}").alias("track"), F.col(axis).alias("idx"), F.col(column).cast("double").alias("value")))
        elif self.normalize == "grid-seq":
            parts = [self.background().select(F.lit("background").alias("track"), "idx", F.col("background").cast("double").alias("value"))]
        elif self.normalize in ("ice", "cool-ice"):
            parts = []
            for v, (bias_x, bias_y, _) in self.biases().items():
                for axis, name, bias in (("xi", "bx", bias_x), ("yi", "by", bias_y)):
                    parts.append(bias.select(F.lit(f"bias {axis[0]} {groups[v]}").alias("track"), F.col(axis).alias("idx"), F.col(name).alias("value")))
        else:
            raise ValueError(f"{self.normalize} looks at no slices")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def export(self) -> DataFrame:
        """chr_x, start_x, end_x, chr_y, start_y, end_y (base pairs), score."""
        at = lambda s, end: ((F.col(f"{s}_pos") + (F.col(f"{s}_size") if end else 0)) * self.dividend).alias(f"{'end' if end else 'start'}_{s}")
        return self.values().select("chr_x", at("x", False), at("x", True), "chr_y", at("y", False), at("y", True), F.col("scaled").alias("score"))

    def viewpoint(self, low: int, high: int, column: bool = True, by_size: bool = True) -> DataFrame:
        """(idx, v): what the bins of one axis hold against a viewpoint low..high on the other
        (x if column), through all of the heatmap's steps; per unit of the viewpoint's
        extent if by_size."""
        w = self.window or (None, None, None, None)
        genome = (0, 1 << 62)
        x, y = (w[0], w[1]) if w[0] is not None else genome, (w[2], w[3]) if w[2] is not None else genome
        seen = replace(self, window=(low, high, *y) if column else (*x, low, high), dense=False)
        near, far = ("xi", "yi") if column else ("yi", "xi")
        rows = seen.values()
        extent = seen.axes()[0 if column else 1].bins().agg(F.sum("index_size").alias("extent"))
        sums = rows.groupBy(F.col(far).alias("idx")).agg(F.sum("v").alias("v"))
        return sums.crossJoin(F.broadcast(extent)).select("idx", (F.try_divide("v", "extent") if by_size else F.col("v")).alias("v"))  # a single row


    def with_viewpoints(self, column: tuple[int, int] | None = None, row: tuple[int, int] | None = None) -> DataFrame:
        """(system, xi, yi, v) of the heatmap and of what its rows hold against the viewpoint
        column on x, and its columns against row on y, from one pass over the contacts and
        one aggregation. A viewpoint (low, high on the concatenated contigs) is one bin for
        each contig that it touches, as in viewpoint_axis(). Values are counts of the groups,
        normalised by reads if asked; other normalisations look at slices of one system: use
        viewpoint() for them."""
        if self.normalize not in ("dont", "rpm", "rpk"):
            raise ValueError("with_viewpoints() normalises by reads only")
        x, y = self.axes()
        systems = {"heatmap": (x, y)}
        if column is not None:
            systems["column"] = (viewpoint_axis(self.contigs, *column), y)
        if row is not None:
            systems["row"] = (x, viewpoint_axis(self.contigs, *row))
        keys, zero = ("system", "xi", "yi"), F.lit(0).cast("long")
        rows = count.in_systems(self.filtered(), systems, self.mode).select("dataset", *keys, F.col("cnt").alias("a"), zero.alias("b"))
        if self.symmetry != "all":
            turned = count.in_systems(count.transposed(self.filtered(mirrored=True)), systems, self.mode)
            rows = rows.union(turned.select("dataset", *keys, zero.alias("a"), F.col("cnt").alias("b")))
        rows = rows.groupBy("dataset", *keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        rows = combine.group_values(rows, count.fold(F.col("a"), F.col("b"), self.symmetry, self.least), self.group_a, self.group_b, self.in_group, keys)
        if self.normalize != "dont":
            rows = self._over_totals(rows, 1e6 if self.normalize == "rpm" else 1e3, keys)
        return rows.select(*keys, combine.between(F.col("va"), F.col("vb"), self.between_group).alias("v"))


def check_capabilities(contacts: DataFrame, contigs: DataFrame, wanted: dict[str, bool]) -> list[str]:
    """Warnings for filters that datasets can't serve: wanted says whether a query filters by
    map_q, strand or multi (several loci of a read). Such a filter lets all reads of these
    datasets through, as their codes are the ones that every filter keeps."""
    rows = ingest.diagnostics(contacts, contigs).collect()  # one row per dataset
    texts = {"map_q": "mapping qualities", "strand": "strands", "multi": "reads of several loci"}
    return [f"{r['dataset']} has no {texts[k]}: the filter lets all of its reads through" for k in sorted(texts) if wanted.get(k) for r in sorted(rows) if not r[f"has_{k}"]]
