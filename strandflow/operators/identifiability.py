"""How well regions tell a gene's isoforms apart: condition numbers of its design matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.config import KSettings
from strandflow.functions.text import region_type
from strandflow.operators.em import _whole_groups as whole_groups

_SCHEMA = "chrom string, gene string, n_isoforms int, n_regions int, k_value double, condition double, generalised double, product double"


def region_lengths(regions: DataFrame, s: KSettings = KSettings()) -> DataFrame:
    """regions (region, region_len, inner_len) with eff_len: start places of a read by the kind of region, 1 at least."""
    kind = region_type(F.col("region"))
    r, m = s.read_length, s.junction_length
    exon = F.when(F.col("region_len") > r, F.col("region_len") - r + 1).otherwise(1)
    value = (
        F.when(kind == "one_exon", exon).when(kind == "one_junction", F.lit(r - m)).when(kind == "two_exons", F.lit(r - 1))
        .when(kind == "exons", r - F.col("inner_len") - 1).otherwise(r - F.col("inner_len") - m)
    )
    return regions.withColumn("eff_len", F.greatest(value, F.lit(1)).cast("double"))


def weights(regions: DataFrame, s: KSettings = KSettings()) -> DataFrame:
    """regions with weight: the entry of their isoforms in the design matrix before columns are normalised."""
    if s.minus_inner:
        share = (s.read_length - F.col("inner_len") - 1) / s.read_length
        many = region_type(F.col("region")).isin("junctions", "exons")
        return regions.withColumn("weight", F.when(many & (share > 0) & (share <= 1), share).otherwise(1.0))
    return region_lengths(regions, s).withColumnRenamed("eff_len", "weight") if s.weighted else regions.withColumn("weight", F.lit(1.0))


def design_matrix(regions: DataFrame, s: KSettings = KSettings()) -> DataFrame:
    """chrom, gene, region, isoform, value: weights of regions, normalised for each isoform; entries that are not listed are 0."""
    long = weights(regions, s).select("chrom", "gene", "region", "weight", F.explode("isoforms").alias("isoform"))
    total = F.sum("weight").over(Window.partitionBy("chrom", "gene", "isoform"))
    return long.select("chrom", "gene", "region", "isoform", (F.col("weight") / F.when(total == 0, 1.0).otherwise(total)).alias("value"))


def condition(a: np.ndarray, tolerance: float = 0.0) -> tuple[float, float, float, float]:
    """K, condition number, its form without zero values, and the product of the extreme values, from roots of the singular values of A'A.

    tolerance: least singular value that counts as positive; whether the rank is full does not hang on it.
    """
    gram = a.T @ a
    values = np.linalg.svd(gram, compute_uv=False)
    rank = int(np.linalg.matrix_rank(gram))
    positive = values[values > tolerance] if tolerance else values[:rank]
    if not rank or not len(positive):
        return (float("nan"),) * 4
    top, low = float(np.sqrt(values[0])), float(np.sqrt(positive.min()))
    if rank == len(values):
        least = float(np.sqrt(values[-1]))
        return (top - least) / top, top / least, top / low, top * low
    return top / low, float("inf"), top / low, top * low


def stacks(g: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The matrices of many whole genes (chrom, gene, region, isoform, value), those of one shape as a stack: their keys and the stack, rows and columns in order of their names."""
    gene = g.groupby(["chrom", "gene"], sort=False, dropna=False).ngroup().to_numpy()
    place = []
    for name in ("region", "isoform"):
        code, names = pd.factorize(g[name], sort=True)
        both, at = np.unique(gene * (len(names) + 1) + code, return_inverse=True)
        first = np.searchsorted(both, np.arange(gene.max() + 1) * (len(names) + 1))
        place.append((at - first[gene], np.diff(np.append(first, len(both)))))
    keys = g[["chrom", "gene"]].iloc[np.unique(gene, return_index=True)[1]].reset_index(drop=True)
    (row, rows), (col, cols) = place
    shape = rows * (cols.max() + 1) + cols
    for x in np.unique(shape):
        here = np.flatnonzero(shape == x)
        at = np.full(len(keys), -1)
        at[here] = np.arange(len(here))
        mine = at[gene] >= 0
        a = np.zeros((len(here), rows[here[0]], cols[here[0]]))
        a[at[gene[mine]], row[mine], col[mine]] = g["value"].to_numpy(float)[mine]
        yield keys.iloc[here], a


def _matrices(regions: DataFrame, s: KSettings, make: Callable[[np.ndarray], list], schema: str) -> DataFrame:
    """make(stack of design matrices), a row of values for each gene. A gene's regions come to one task: they are bounded by its own structure, not by reads. Python gets many whole genes at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for keys, a in stacks(g):
            values = pd.DataFrame(make(a), columns=names[4:])
            out.append(pd.concat([keys.reset_index(drop=True), pd.DataFrame({names[2]: a.shape[2], names[3]: a.shape[1]}, index=range(len(a))), values], axis=1))
        return pd.concat(out, ignore_index=True)

    rows = design_matrix(regions, s).repartition("chrom", "gene").sortWithinPartitions("chrom", "gene")
    return rows.mapInPandas(lambda b: whole_groups(b, ["chrom", "gene"], kernel), schema)


def k_values(regions: DataFrame, s: KSettings = KSettings()) -> DataFrame:
    """regions (chrom, gene, region, region_len, inner_len, isoforms) -> one row a gene."""
    return _matrices(regions, s, lambda a: [condition(x, s.tolerance) for x in a], _SCHEMA)


def singular_values(regions: DataFrame, s: KSettings = KSettings()) -> DataFrame:
    """The same with the singular values of the design matrix, largest first: as many as isoforms, those of missing regions 0."""

    def values(a: np.ndarray) -> list[tuple[list[float]]]:
        found = np.linalg.svd(a, compute_uv=False)
        return [(x,) for x in np.pad(found, ((0, 0), (0, a.shape[2] - found.shape[1]))).tolist()]

    return _matrices(regions, s, values, "chrom string, gene string, n_isoforms int, n_regions int, singular_values array<double>")
