"""Queries of text sources: the driver's rows written as lines and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F


from gridspan.sources import text, views

from .base import ANNOTATIONS, CONTACTS, CUSTOMER_CONTIGS, RAW, TRACK, query
from .counting import AXES, counts_sql


@query("s4_pairs", f"WITH {RAW} SELECT read_id::VARCHAR AS readid, chr_x AS chr1, pos1_s AS pos1, chr_y AS chr2, pos2_s AS pos2, CASE WHEN strand1 THEN '+' ELSE '-' END AS strand1, mapq::VARCHAR AS mapq2, '1' AS cnt FROM r")
def _pairs(spark, sf_dir):
    rows = views.raw_contacts(spark, sf_dir)
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    lines = rows.select(F.concat_ws("\t", "read_id", "chr_x", "pos1_s", "chr_y", "pos2_s", sign("strand1"), sign("strand2"), F.lit("."), "mapq", "mapq").alias("value"))
    table = text.parse_table(lines)
    return table.select("readid", "chr1", F.col("pos1").cast("long").alias("pos1"), "chr2", F.col("pos2").cast("long").alias("pos2"), "strand1", "mapq2", "cnt")


@query("s7_optional_columns", f"WITH {RAW} SELECT CASE WHEN mapq % 2 = 0 THEN read_id::VARCHAR ELSE '-' END AS readid, chr_x AS chr1, pos2_s::VARCHAR AS pos2, CASE WHEN mapq % 2 = 0 THEN mapq::VARCHAR ELSE '*' END AS mapq1 FROM r")
def _optional(spark, sf_dir):
    rows = views.raw_contacts(spark, sf_dir)
    full = F.concat_ws(" ", "read_id", "chr_x", "pos1_s", "chr_y", "pos2_s", "mapq")
    lines = rows.select(F.when(F.col("mapq") % 2 == 0, full).otherwise(F.concat_ws(" ", "chr_x", "pos1_s", "chr_y", "pos2_s")).alias("value"))
    return text.parse_table(lines, layout="[ReadName] chrom1 pos1 chrom2 pos2 [mapq1]").select("readid", "chr1", "pos2", "mapq1")


@query("s6_track_table", f"WITH {TRACK} SELECT read_id::VARCHAR AS readid, chr, CASE WHEN strand = 0 THEN '+' ELSE '-' END AS strand, '*' AS mapq FROM t")
def _track(spark, sf_dir):
    rows = views.raw_track(spark, sf_dir)
    lines = rows.select(F.concat_ws("\t", "read_id", "chr", "pos", F.when(F.col("strand"), "+").otherwise("-")).alias("value"))
    return text.parse_table(lines, "track").select("readid", "chr", "strand", "mapq")


@query("s8_xa_tags", f"WITH {RAW} SELECT read_id, chr_y AS chr, pos2_s AS pos, strand2 AS strand FROM r UNION ALL SELECT read_id, chr_x, pos1_s, strand1 FROM r WHERE mapq > 25")
def _xa(spark, sf_dir):
    place = lambda c, p, s: F.concat_ws(",", F.col(c), F.concat(F.when(F.col(s), "+").otherwise("-"), F.col(p).cast("string")), F.lit("50M"), F.lit("0"))
    rows = views.raw_contacts(spark, sf_dir)
    tag = F.concat(F.lit("XA:Z:"), place("chr_y", "pos2_s", "strand2"), F.lit(";"), F.when(F.col("mapq") > 25, F.concat(place("chr_x", "pos1_s", "strand1"), F.lit(";"))).otherwise("bad,1;"))
    return rows.select("read_id", F.inline(text.parse_xa(tag)))


@query("s3_gff", f"WITH {ANNOTATIONS} SELECT chr, type, start_bp, end_bp, forw, 'ID=' || desc_id || chr(10) || 'description=a,b' AS info FROM an")
def _gff(spark, sf_dir):
    rows = views.annotations(spark, sf_dir)
    attributes = F.concat(F.lit("ID="), F.col("desc_id").cast("string"), F.lit(";description=a%2Cb"))
    lines = rows.select(F.concat_ws("\t", "chr", F.lit("made"), "type", "start_bp", "end_bp", F.lit("."), F.when(F.col("forw"), "+").otherwise("-"), F.lit("."), attributes).alias("value"))
    return text.parse_gff(lines.union(spark.createDataFrame([("##gff-version 3",), ("",)], "value string")))


def _described(spark, sf_dir):
    return views.customer_contigs(spark, sf_dir).selectExpr("ord AS at", "chr", "len * 10000 + ord AS bp")


@query("s1_contig_sizes", f"WITH {CUSTOMER_CONTIGS} SELECT chr, len * 10000 + ord AS len_bp, (len * 10000 + ord) // 10000 AS len FROM g")
def _sizes(spark, sf_dir):
    return text.contig_sizes(_described(spark, sf_dir).selectExpr("at", "concat(chr, '\t', bp) AS value"), views.DIVIDEND).drop("at")


@query("s2_gff_contigs", f"WITH {CUSTOMER_CONTIGS} SELECT chr, len * 10000 + ord AS len_bp, (len * 10000 + ord) // 10000 AS len FROM g")
def _regions(spark, sf_dir):
    """Region lines among annotation lines."""
    lines = _described(spark, sf_dir).selectExpr("concat('##sequence-region ', chr, ' 1 ', bp) AS value")
    return text.gff_contigs(lines.union(views.annotations(spark, sf_dir).selectExpr("concat_ws('\t', chr, 'made', type, start_bp, end_bp) AS value")), views.DIVIDEND)


@query("s10_ploidy", f"WITH {CUSTOMER_CONTIGS} SELECT chr AS source, chr || '-a' AS shown, 0 AS ploidy_group FROM g WHERE len >= 25 UNION ALL SELECT chr, chr || '-b', 1 FROM g WHERE len >= 25 AND ord % 2 = 0")
def _ploidy(spark, sf_dir):
    contigs = views.customer_contigs(spark, sf_dir).orderBy("ord").collect()  # a list that the interface reads on the driver
    lines = ["# copies", *[f"{c['chr']} {c['chr']}-a" for c in contigs], "nowhere nowhere-a", "---", *[f"{c['chr']} {c['chr']}-b" for c in contigs if c["ord"] % 2 == 0]]
    return spark.createDataFrame(text.read_ploidy(lines, {c["chr"] for c in contigs if c["len"] >= 25}), "source string, shown string, ploidy_group int")


@query("j13_pixels", f"WITH {CONTACTS}, {AXES}, n AS ({counts_sql()}) SELECT x.chr AS chr_x, y.chr AS chr_y, x.index_pos AS x_s, y.index_pos AS y_s, n AS cnt FROM n JOIN ax x ON xi = x.idx JOIN ay y ON yi = y.idx WHERE dataset = 'rep1'")
def _pixels(spark, sf_dir):
    from .counting import _axis, _counted

    pixels = _counted(spark, sf_dir, F.col("dataset") == "rep1").select(F.col("xi").alias("bin1_id"), F.col("yi").alias("bin2_id"), F.col("n").alias("count"))
    bins = _axis(spark).bins().select(F.col("idx").alias("bin_id"), "chr", F.col("index_pos").alias("start"), (F.col("index_pos") + F.col("index_size")).alias("end"))
    return text.pixel_contacts(pixels, bins, "cool").select("chr_x", "chr_y", "x_s", "y_s", "cnt")


