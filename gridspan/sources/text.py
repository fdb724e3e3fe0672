"""Text sources: pairs and track tables with declared columns, GFF, sizes, ploidy, pixels.

Lines are parsed with column expressions, so a file of any size is split and parsed by
all executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known columns, their defaults, and other names for them.
PAIR_COLUMNS = {"readid": "-", "chr1": ".", "pos1": "0", "chr2": ".", "pos2": "0", "strand1": "+", "strand2": "+", "mapq1": "*", "mapq2": "*", "xa1": "", "xa2": "", "cnt": "1", "pair_type": "UU"}
TRACK_COLUMNS = {"readid": "-", "chr": ".", "pos": "0", "strand": "+", "mapq": "*", "xa": "", "cnt": "1"}
SYNONYMS = {"chrom1": "chr1", "chrom2": "chr2", "chrom": "chr", "readname": "readid", "count": "cnt"}
REQUIRED = {"pairs": ("chr1", "pos1", "chr2", "pos2"), "track": ("chr", "pos")}
DEFAULT_PAIRS = "[readid] chr1 pos1 chr2 pos2 [strand1] [strand2] [.] [mapq1] [mapq2] [xa1] [xa2] [cnt]"
DEFAULT_TRACK = "[readid] chr pos [strand] [mapq] [xa] [cnt]"


def declared(layout: str, known: dict[str, str], required: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(column, optional) of a layout: [x] is optional and . is skipped."""
    out = []
    for word in layout.split():
        optional = word.startswith("[") and word.endswith("]")
        name = (word[1:-1] if optional else word).lower()
        name = SYNONYMS.get(name, name)
        if name != "." and name not in known:
            raise ValueError(f"unknown column {name}")
        if optional and name in required:
            raise ValueError(f"{name} can't be optional")
        out.append((name, optional))
    names = [n for n, _ in out if n != "."]
    if len(set(names)) < len(names):
        raise ValueError("a column is given twice")
    if missing := set(required) - set(names):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return out


def bound(layout: list[tuple[str, bool]], fields: int) -> list[str] | None:
    """The columns of a line of so many fields: optional columns go, the last first, until
    it fits; further fields have no column. None if there are too few fields."""
    kept = list(range(len(layout)))
    for k in reversed(range(len(layout))):
        if len(kept) > fields and layout[k][1]:
            kept.remove(k)
    return None if len(kept) > fields else [layout[k][0] for k in kept]


def parse_table(lines: DataFrame, kind: str = "pairs", layout: str | None = None) -> DataFrame:
    """(value) lines to string columns of all known names.

    Fields are parted by tabs if there is one, else by spaces. Lines that begin with #, and
    blank ones, are left out; a line with fewer fields than required columns is an error.
    """
    known = PAIR_COLUMNS if kind == "pairs" else TRACK_COLUMNS
    columns = declared(layout or (DEFAULT_PAIRS if kind == "pairs" else DEFAULT_TRACK), known, REQUIRED[kind])
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("value", F.regexp_replace("value", r"[\r\n]+$", ""))
    rows = rows.select(*[c for c in lines.columns if c != "value"], F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split(F.trim("value"), " +")).alias("_f"))
    least = sum(not optional for _, optional in columns)

    def field(name: str) -> Column:
        out = F.when(F.size("_f") < least, F.raise_error(F.concat(F.lit("too few fields: "), F.concat_ws(" ", "_f"))).cast("string"))
        for n in range(least, len(columns) + 1):
            names = bound(columns, n) or []
            here = F.get(F.col("_f"), F.lit(names.index(name))) if name in names else F.lit(known[name])
            out = out.when(F.size("_f") == n, here) if n < len(columns) else out.otherwise(here)
        return out

    return rows.select(*[c for c in rows.columns if c != "_f"], *[field(n).alias(n) for n in known])


def declared_layout(spark: SparkSession, path: str) -> str | None:
    """The layout of a file's own `#columns:` line, if it has one."""
    found = spark.read.text(path).filter(F.col("value").startswith("#columns:")).limit(1).collect()
    return found[0]["value"].removeprefix("#columns:").strip() if found else None


def read_table(spark: SparkSession, path: str, kind: str = "pairs", layout: str | None = None) -> DataFrame:
    return parse_table(spark.read.text(path), kind, layout or declared_layout(spark, path))


def parse_xa(tag: Column) -> Column:
    """`chr,+-pos,CIGAR,NM;...` to an array of (chr, pos, strand); empty and notag give none."""
    bare = F.regexp_replace(F.coalesce(tag, F.lit("")), "^XA:Z:", "")
    parts = F.filter(F.transform(F.split(bare, ";"), lambda p: F.split(p, ",")), lambda p: F.size(p) == 4)
    place = lambda p: F.get(p, F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("chr"), F.abs(place(p).cast("long")).alias("pos"), (~place(p).startswith("-")).alias("strand")))


def parse_gff(lines: DataFrame) -> DataFrame:
    """(value) lines to chr, type, start_bp, end_bp, forw, info; 8 columns or an error."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))
    at = lambda n: F.get(F.col("f"), F.lit(n))
    checked = F.when(F.size("f") < 8, F.raise_error(F.concat(F.lit("not 8 columns: "), "value")).cast("string")).otherwise(at(0))
    info = F.replace(F.replace(F.coalesce(at(8), F.lit("")), F.lit(";"), F.lit("\n")), F.lit("%2C"), F.lit(","))
    return rows.select(checked.alias("chr"), at(2).alias("type"), at(3).cast("long").alias("start_bp"), at(4).cast("long").alias("end_bp"), (at(6) == "+").alias("forw"), info.alias("info"))


def contig_sizes(lines: DataFrame, dividend: int) -> DataFrame:
    """`name length` lines in display order (ord is the line's place in `at`)."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value") != "").select("at", F.get(f, F.lit(0)).alias("chr"), F.get(f, F.lit(1)).cast("long").alias("len_bp"))
    return rows.select("chr", "at", "len_bp", F.floor(F.col("len_bp") / dividend).cast("long").alias("len"))


def gff_contigs(lines: DataFrame, dividend: int) -> DataFrame:
    """Contigs of `##sequence-region name 1 length` lines; another start is an error."""
    f = F.split("value", r"\s+")
    rows = lines.filter(F.col("value").startswith("##sequence-region")).select(F.get(f, F.lit(1)).alias("chr"), F.get(f, F.lit(2)).alias("start"), F.get(f, F.lit(3)).cast("long").alias("len_bp"))
    name = F.when(F.col("start") != "1", F.raise_error(F.lit("a contig has to start at 1")).cast("string")).otherwise(F.col("chr"))
    return rows.select(name.alias("chr"), "len_bp", F.floor(F.col("len_bp") / dividend).cast("long").alias("len"))


def read_ploidy(lines: list[str], known: set[str]) -> list[tuple[str, str, int]]:
    """(source, shown, group) of a ploidy file, which lists contigs and is small: a line of
    dashes begins a group; unknown sources and repeats within a group are left out; a shown
    name given twice is an error."""
    out, group, shown, inside = [], 0, set(), set()
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        if set(line) == {"-"}:
            group, inside = group + 1, set()
            continue
        source, name = line.split()
        if source not in known or source in inside:
            continue
        if name in shown:
            raise ValueError(f"{name} is given twice")
        shown.add(name)
        inside.add(source)
        out.append((source, name, group))
    return out


def pixel_contacts(pixels: DataFrame, bins: DataFrame, dataset: str) -> DataFrame:
    """Pixels (bin1_id, bin2_id, count) with their bins (bin_id, chr, start, end) as points."""
    side = lambda n, s: bins.select(F.col("bin_id").alias(f"bin{n}_id"), F.col("chr").alias(f"chr_{s}"), F.col("start").alias(f"{s}_s"))
    rows = pixels.join(side(1, "x"), "bin1_id").join(side(2, "y"), "bin2_id")
    return rows.select(F.lit(dataset).alias("dataset"), "chr_x", "chr_y", "x_s", F.col("x_s").alias("x_e"), "y_s", F.col("y_s").alias("y_e"), F.col("count").alias("cnt"))
