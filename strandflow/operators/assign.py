"""Reads given to single isoforms, molecules by similar names, and tables joined to genes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.intervals import interval_join
from strandflow.operators.store import materialize


def assign_reads(compatible: DataFrame, theta: DataFrame) -> DataFrame:
    """compatible (read, isoform, ...) with theta (isoform, theta): for each read the isoform of the largest theta, of equal ones the first by name; reads without known isoforms go."""
    known = compatible.join(theta.select("isoform", "theta"), "isoform")
    order = Window.partitionBy("read").orderBy(F.col("theta").desc(), "isoform")
    return known.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "theta")


def _masks(length: int, distance: int) -> list[str]:
    """Every name of so many characters as a pattern of the characters that are kept, where as many as the distance are left out."""
    left_out = combinations(range(length), min(distance, length))
    return ["".join("0" if i in gone else "1" for i in range(length)) for gone in map(set, left_out)]


def near_earlier(names: DataFrame, keys: list[str], name: str, distance: int) -> DataFrame:
    """names (keys, name, distinct) with near: whether an earlier name of the same keys is within the distance.

    Two names of the same length are within it just if they agree outside some choice of so many places. Each name is therefore listed under what is left of it by every choice, and
    of each list only the first name counts: lists are combined before they are shuffled, and no pairs are made, however many names a key has. Names of different lengths are as far
    apart as the longer one is long. A name is listed as often as its places can be chosen, which is meant for the distances of one or two that molecules' names take.
    """
    lengths = [r[0] for r in names.select(F.length(name).alias("n")).where("n IS NOT NULL").distinct().orderBy("n").collect()]  # lengths of names: a few
    text = F.col(name)
    listed = F.array().cast("array<struct<mask:string,rest:string>>")
    for n in lengths:
        if n <= distance:
            here = F.array(F.struct(F.lit("short").alias("mask"), F.lit("").alias("rest")))
        else:
            masks = F.array(*[F.lit(m) for m in _masks(n, distance)])
            letters = F.split(text, "")
            rest = F.transform(masks, lambda m: F.struct(F.concat(F.lit(f"{n}:"), m).alias("mask"), F.array_join(F.zip_with(letters, F.split(m, ""), lambda c, k: F.when(k == "1", c).otherwise("*")), "").alias("rest")))
            here = rest
        listed = F.when(F.length(name) == n, here).otherwise(listed)
    entries = names.select(*keys, name, F.explode(listed).alias("x")).select(*keys, name, "x.mask", "x.rest")
    first = entries.groupBy(*keys, "mask", "rest").agg(F.min(name).alias("__first"))
    back = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    first = first.withColumnsRenamed({k: f"__{k}" for k in keys} | {"mask": "__mask", "rest": "__rest"})
    seen = entries.join(first, [*back, F.col("mask") == F.col("__mask"), F.col("rest") == F.col("__rest")])
    return seen.groupBy(*keys, name).agg(F.max(F.col("__first") < F.col(name)).alias("near"))


def molecule_counts(assigned: DataFrame, distance: int = 0) -> DataFrame:
    """barcode, isoform, count: distinct molecules (umi, else the read's name).

    With a distance, a name that is within it of an earlier one, in the order of names, is no molecule of its own: it belongs to the group of the first such name. Names therefore count as many
    groups as there are names without a near earlier one.
    """
    m = assigned.where("barcode IS NOT NULL").select("barcode", "isoform", F.coalesce("umi", "read").alias("umi")).distinct()
    if not distance:
        return m.groupBy("barcode", "isoform").agg(F.count("*").alias("count"))
    m = materialize(m, "molecules")
    return near_earlier(m, ["barcode", "isoform"], "umi", distance).groupBy("barcode", "isoform").agg(F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("count"))


def whitelisted(reads: DataFrame, whitelist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads of listed barcodes, and one row with the number of reads (rejected) that have another one."""
    listed = whitelist.select("barcode").distinct()
    rejected = reads.where("barcode IS NOT NULL").join(listed, "barcode", "left_anti").agg(F.count("*").alias("rejected"))
    return reads.join(listed, "barcode", "left_semi"), rejected


def most_overlapping_gene(reads: DataFrame, genes: DataFrame, width: int = 1 << 14) -> DataFrame:
    """read, gene, overlap: the gene that most of a read's span overlaps, of equal ones the first by name. reads: read, chrom, start, end; genes: chrom, gene, gene_start, gene_end."""
    pairs = interval_join(reads, genes, ["chrom"], "start", "end", "gene_start", "gene_end", width)
    overlap = F.least("end", "gene_end") - F.greatest("start", "gene_start") + 1
    order = Window.partitionBy("read").orderBy(F.col("overlap").desc(), "gene")
    return pairs.withColumn("overlap", overlap).withColumn("__k", F.row_number().over(order)).where("__k = 1").select("read", "chrom", "gene", "overlap")


def low_overlap(overlaps: DataFrame) -> DataFrame:
    """chrom, gene, tenth: of a gene's n sorted overlaps the one at n // 10, counted from 0."""
    w = Window.partitionBy("chrom", "gene")
    k = F.row_number().over(w.orderBy("overlap")) - 1
    r = overlaps.withColumn("k", k).withColumn("n", F.count("*").over(w))
    return r.where(F.col("k") == F.floor(F.col("n") / 10)).select("chrom", "gene", F.col("overlap").alias("tenth"))


def gene_tpm(isoforms: DataFrame) -> DataFrame:
    """gene and tpm: the sum of its isoforms'."""
    return isoforms.groupBy("gene").agg(F.sum("tpm").alias("tpm"))


def in_both(short: DataFrame, long: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both tables have."""
    return short.select(*keys).distinct().join(long.select(*keys).distinct(), keys)


def external_expression(isoforms: DataFrame, quantified: DataFrame) -> DataFrame:
    """gene and values: each of the gene's isoforms (by name) with the quantified tpm, 0 where there is none."""
    t = isoforms.select("gene", "isoform").join(quantified.groupBy("isoform").agg(F.max("tpm").alias("tpm")), "isoform", "left").fillna(0.0, ["tpm"])
    return t.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("isoform", "tpm"))).alias("values"))
