"""Which regions of genes count, and what reads say about them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.config import KSettings
from strandflow.functions.text import exon_count, region_type
from strandflow.operators.annotation import GENE
from strandflow.operators.em import _whole_groups as whole_groups
from strandflow.operators.identifiability import region_lengths, stacks

REGION = [*GENE, "region"]


def coordinates(region: Column, points: Column) -> Column:
    """A region's name with coordinates for points. points: a map from P-names to coordinates."""
    part = F.transform(F.split(region, "-"), lambda p: F.array_join(F.transform(F.split(p, ":"), lambda x: F.element_at(points, x).cast("string")), ":"))
    return F.array_join(part, "-")


def with_points(regions: DataFrame, points: DataFrame) -> DataFrame:
    """regions with points, the map of its gene. points: chrom, gene, at, point."""
    by_gene = points.groupBy(*GENE).agg(F.map_from_entries(F.collect_list(F.struct("point", "at"))).alias("points"))
    return regions.join(by_gene, GENE)


def fits_reads(regions: DataFrame, least: int, most: int | None = None, junction: int = 1) -> DataFrame:
    """Regions (with points) that reads of least to most bases can show: those of at most least bases, and longer ones whose inner
    exons fit into a read with the junction's bases on both sides. Without an upper bound no longer region counts."""
    parts = F.transform(F.split("region", "-"), lambda p: F.transform(F.split(p, ":"), lambda x: F.element_at("points", x)))
    r = regions.withColumn("__parts", parts)
    first, last = F.element_at("__parts", 1), F.element_at("__parts", -1)

    def length(e: Column) -> Column:
        return F.element_at(e, -1) - F.element_at(e, 1) + 1

    def shown(e: Column, left: bool, right: bool) -> Column:
        """Bases of an exon that a read must hold: all but the outermost pieces on its open sides."""
        a = F.element_at(e, 1) if left else F.element_at(e, 2)
        b = F.element_at(e, -1) if right else F.element_at(e, -2)
        return F.when(F.size(e) == 2, F.lit(1)).otherwise(b - a + (2 if left or right else 3))

    kind = region_type(F.col("region"))
    inner = F.aggregate(F.slice("__parts", 2, F.greatest(F.size("__parts") - 2, F.lit(0))), F.lit(0).cast("long"), lambda s, e: s + length(e))
    ends = 2 * junction - 2 + shown(first, False, True) + shown(last, True, False)
    wide = (length(first) > junction) & (length(last) > junction)
    fits = (
        F.when(kind.isin("one_exon", "two_exons"), F.lit(True))
        .when(kind == "one_junction", wide & ((exon_count(F.col("region")) == 2) | (ends <= most)))
        .when(kind == "exons", shown(first, False, False) <= most)
        .otherwise(wide & (inner + ends <= most))
    )
    return r.where((F.col("region_len") <= least) | (F.lit(most is not None) & fits)).drop("__parts")


def single_exons_and_junctions(regions: DataFrame) -> DataFrame:
    return regions.where(region_type(F.col("region")).isin("one_exon", "one_junction"))


def _longest(regions: DataFrame) -> DataFrame:
    """A row a region and isoform: pieces, and most, the pieces of the isoform's longest region."""
    long = regions.select(*REGION, F.explode("isoforms").alias("isoform"), exon_count(F.col("region")).alias("pieces"))
    return long.withColumn("most", F.max("pieces").over(Window.partitionBy(*GENE, "isoform")))


def near_full_length(regions: DataFrame) -> DataFrame:
    """Regions of all but one of the pieces of some isoform's longest region, or more; of isoforms of one piece the first region by name."""
    long = _longest(regions)
    first = F.row_number().over(Window.partitionBy(*GENE, "isoform").orderBy(F.col("pieces").desc(), "region"))
    kept = long.withColumn("k", first).where(F.when(F.col("most") <= 1, F.col("k") == 1).otherwise(F.col("pieces") >= F.col("most") - 1))
    return regions.join(kept.select(*REGION).distinct(), REGION, "left_semi")


def full_length(regions: DataFrame) -> DataFrame:
    """Regions with as many pieces as the longest region of some isoform of theirs."""
    return regions.join(_longest(regions).where("pieces = most").select(*REGION).distinct(), REGION, "left_semi")


def _full_rank(occupied: DataFrame) -> DataFrame:
    """chrom, gene, full: whether the regions tell all the gene's isoforms (n) apart. A gene's regions come to one task; Python gets many whole genes at a time."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        n = g.drop_duplicates(GENE).set_index(GENE)["n"]
        out = []
        for keys, a in stacks(g):
            every = n.loc[pd.MultiIndex.from_frame(keys)].to_numpy()
            out.append(keys.assign(full=(a.shape[2] == every) & (np.linalg.matrix_rank(a) == every)))
        return pd.concat(out, ignore_index=True)

    rows = occupied.select(*REGION, "isoform", "n", F.lit(1.0).alias("value")).repartition(*GENE).sortWithinPartitions(*GENE)
    return rows.mapInPandas(lambda b: whole_groups(b, GENE, kernel), "chrom string, gene string, full boolean")


def with_reads(regions: DataFrame, counts: DataFrame, policy: str = "all", short: bool = False) -> DataFrame:
    """regions with their reads (chrom, gene, region, reads), without those that no read shows, but for: under all, full-length ones; under nonfullrank, full-length ones
    (short reads: those without junctions) of genes whose other regions do not tell the isoforms apart; under none, none."""
    r = regions.join(counts.select(*REGION, "reads"), REGION, "left").fillna(0, ["reads"])
    if policy == "none":
        return r.where("reads > 0")
    if policy == "all":
        spared = full_length(regions)
    else:
        n = regions.select(*GENE, F.explode("isoforms").alias("isoform")).groupBy(*GENE).agg(F.countDistinct("isoform").alias("n"))
        seen = r.where("reads > 0").select(*REGION, F.explode("isoforms").alias("isoform")).join(n, GENE)
        poor = n.join(_full_rank(seen).where("full"), GENE, "left_anti")
        spared = (regions.where(region_type(F.col("region")).isin("one_exon", "two_exons", "exons")) if short else full_length(regions)).join(poor, GENE, "left_semi")
    kept = spared.select(*REGION).withColumn("spared", F.lit(True))
    return r.join(kept, REGION, "left").where("reads > 0 OR spared").drop("spared")


def without_regions(models: DataFrame, regions: DataFrame) -> DataFrame:
    """chrom, gene, isoform of genes that no region is left of: results list them as not available."""
    gone = models.join(regions.select(*GENE).distinct(), GENE, "left_anti")
    return gone.select(*GENE, F.explode("isoforms.isoform").alias("isoform"))


def abundance(regions_with_reads: DataFrame, short: bool = False, s: KSettings = KSettings()) -> DataFrame:
    """The reads of each region, of short reads over its effective length."""
    r = region_lengths(regions_with_reads, s)
    return r.withColumn("abundance", F.col("reads") / F.col("eff_len") if short else F.col("reads").cast("double"))


def isoform_counts(regions_with_reads: DataFrame) -> DataFrame:
    """chrom, gene, reads, multi_isoforms, unique_isoforms: reads in regions of several isoforms and of one."""
    many = F.size("isoforms") > 1
    return regions_with_reads.groupBy(*GENE).agg(
        F.sum("reads").alias("reads"), F.sum(F.when(many, F.col("reads")).otherwise(0)).alias("multi_isoforms"), F.sum(F.when(many, 0).otherwise(F.col("reads"))).alias("unique_isoforms")
    )


def missing_pieces(regions_with_reads: DataFrame) -> DataFrame:
    """kind (unique, multi), missing, reads: how many pieces a read's region lacks of the isoform's longest one that reads show; of several isoforms, the median."""
    shown = regions_with_reads.where("reads > 0")
    long = _longest(shown).join(shown.select(*REGION, "reads"), REGION)
    per = long.groupBy(*REGION).agg(F.median(F.col("most") - F.col("pieces")).alias("missing"), F.count("*").alias("n"), F.first("reads").alias("reads"))
    kind = F.when(F.col("n") == 1, "unique").otherwise("multi").alias("kind")
    return per.groupBy(kind, "missing").agg(F.sum("reads").alias("reads"))


def short_isoforms(reads: DataFrame, isoforms: DataFrame) -> DataFrame:
    """chrom, gene, isoform, iso_len, longest: isoforms shorter than the gene's longest read. reads: chrom, gene, read_len."""
    longest = reads.groupBy(*GENE).agg(F.max("read_len").alias("longest"))
    return isoforms.select(*GENE, "isoform", "iso_len").join(longest, GENE).where("iso_len < longest")
