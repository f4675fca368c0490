"""Transcript and repeat annotations in GTF, and RepeatMasker output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.text import attribute, chrom_if_numeric, chrom_short, chrom_without_prefix

_NAMES = ("chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no: lines of a file in their order. Numbers grow along the file but leave gaps between splits."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def read_gtf(spark: SparkSession, path: str, feature: str | None = "exon") -> DataFrame:
    """The nine fields and line_no; comments, other features and lines with another number of fields are left out."""
    fields = F.split("value", "\t")
    rows = lines(spark, path).where(~F.col("value").startswith("#")).where(F.size(fields) == 9)
    if feature:
        rows = rows.where(fields[2] == feature)
    out = rows.select(*[fields[i].alias(n) for i, n in enumerate(_NAMES)], "line_no")
    return out.withColumn("start", F.col("start").try_cast("long")).withColumn("end", F.col("end").try_cast("long")).where("start IS NOT NULL AND end IS NOT NULL")


def exons(spark: SparkSession, path: str, chrom: Column | None = None) -> DataFrame:
    """chrom, strand, gene, isoform, start, end of exons with start <= end; numeric chromosome names lose their prefix unless told otherwise."""
    name = chrom if chrom is not None else chrom_if_numeric(F.col("chrom"))
    g = read_gtf(spark, path).where("start <= end")
    return g.select(
        name.alias("chrom"), "strand", attribute(F.col("attributes"), "gene_id").alias("gene"), attribute(F.col("attributes"), "transcript_id").alias("isoform"), "start", "end"
    ).where("gene IS NOT NULL AND isoform IS NOT NULL")


def transcripts_for_repeats(spark: SparkSession, path: str) -> DataFrame:
    """isoform, gene, chrom, strand, exons in transcription order, transcript_length."""
    e = exons(spark, path, chrom_short(F.col("chrom")))
    t = e.groupBy("isoform").agg(
        F.first("gene").alias("gene"), F.first("chrom").alias("chrom"), F.first("strand").alias("strand"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"), F.sum(F.col("end") - F.col("start") + 1).alias("transcript_length"),
    )
    return t.withColumn("exons", F.when(F.col("strand") == "+", F.col("exons")).otherwise(F.sort_array("exons", asc=False)))


def repeats(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand, te_start, te_end, repeat_name, subfamily, family, class, locus, te_length, line_no; elements of one base are left out.

    Missing attributes are Unknown; the locus name stands for the element, or its subfamily where it has none.
    """
    g = read_gtf(spark, path, None).where("start < end")
    known = {k: F.coalesce(attribute(F.col("attributes"), n), F.lit("Unknown")) for k, n in (("subfamily", "gene_id"), ("family", "family_id"), ("class", "class_id"))}
    name = attribute(F.col("attributes"), "transcript_id")
    g = g.withColumn("chrom", chrom_short(F.col("chrom")))
    return g.select(
        "chrom", "strand", F.col("start").alias("te_start"), F.col("end").alias("te_end"),
        F.when((name != "") & name.isNotNull(), name).otherwise(known["subfamily"]).alias("repeat_name"),
        *[v.alias(k) for k, v in known.items()],
        F.coalesce(attribute(F.col("attributes"), "locus"), F.format_string("%s:%d-%d", "chrom", "start", "end")).alias("locus"),
        (F.col("end") - F.col("start") + 1).alias("te_length"),
        F.coalesce(attribute(F.col("attributes"), "consensus_length").try_cast("int"), F.lit(0)).alias("consensus_length"), "line_no",
    )


def loci(repeats: DataFrame) -> DataFrame:
    """One row a locus attribute; of repeated loci the last line counts."""
    row = F.struct("subfamily", "family", "class", "te_length", "consensus_length")
    return repeats.groupBy("locus").agg(F.max_by(row, "line_no").alias("r")).select("locus", "r.*")


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    """RepeatMasker output after its three header lines: coordinates, strand (C is -, others +), names, class and family, remaining positions, locus serials.

    Serials count the loci of a subfamily in the order of the file and are part of their names. Lines of fewer than 15 fields are left out. The header is known by its words.
    """
    from pyspark.sql import Window

    f = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(F.size(f) >= 15).where(f[0].rlike(r"^\d+$"))
    parts = F.split(f[10], "/")

    def number(c: Column) -> Column:
        return F.regexp_replace(c, "[()]", "").try_cast("long")

    reverse = f[8] == "C"
    out = rows.select(
        chrom_without_prefix(f[4]).alias("chrom"), f[5].try_cast("long").alias("start"), f[6].try_cast("long").alias("end"),
        F.when(reverse, "-").otherwise("+").alias("strand"), f[9].alias("subfamily"), parts[0].alias("class"),
        F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0]).alias("family"),
        number(F.when(reverse, f[13]).otherwise(f[11])).alias("rep_start"), number(f[12]).alias("rep_end"),
        number(F.when(reverse, f[11]).otherwise(f[13])).alias("rep_left"), "line_no",
    ).where("start IS NOT NULL AND end IS NOT NULL")
    serial = F.row_number().over(Window.partitionBy("subfamily").orderBy("line_no"))
    whole = F.col("rep_end") + F.col("rep_left")
    known = whole > 0
    return out.withColumn("serial", serial).withColumns(
        {
            "name": F.format_string("%s.%d", "subfamily", serial),
            "consensus_length": F.when(known, whole).otherwise(F.col("end") - F.col("start") + 1),
            "truncated_proportion": F.when(known, F.round((F.col("rep_end") - F.col("rep_start")) / whole, 3)).otherwise(0.0),
        }
    )


def genes_of(spark: SparkSession, path: str) -> DataFrame:
    """gene, chrom, start, end of gene features."""
    g = read_gtf(spark, path, "gene")
    return g.select(attribute(F.col("attributes"), "gene_id").alias("gene"), "chrom", "start", "end")
