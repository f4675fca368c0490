"""Expression of a gene's isoforms from its regions: a non-negative quadratic programme by gene, reads dealt once by its solution, and the tables of genes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.annotation import GENE
from strandflow.operators.em import _starts, _whole_groups
from strandflow.operators.store import materialize

#: Genes of so many isoforms at most are solved together.
TOGETHER = 16


def least_squares(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The x >= 0 of least x'Gx/2 - t'x, G positive definite, by an active set: variables enter by the steepest gradient, and leave where a step would make them negative."""
    n = len(target)
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = 1e-12 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(10 * n + 10):
        slope = target - gram @ x
        slope[free] = -np.inf
        enter = int(np.argmax(slope)) if n else 0
        if not n or slope[enter] <= scale:
            break
        free[enter] = True
        while True:
            best = np.zeros(n)
            best[free] = np.linalg.solve(gram[np.ix_(free, free)], target[free])
            low = free & (best <= 0)
            if not low.any():
                x = best
                break
            step = x[low] / np.maximum(x[low] - best[low], 1e-300)
            x = np.maximum(x + step.min() * (best - x), 0)
            free &= x > 0
            x[~free] = 0
            if not free.any():
                break
    return x


def least_squares_of_many(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """least_squares of a stack of small problems, all in the same step at a time. Variables of no target and no tie to others stay 0."""
    x, free, n = np.zeros(target.shape), np.zeros(target.shape, bool), target.shape[1]
    scale = 1e-12 * np.maximum(1.0, np.abs(target).max(1, initial=0))
    live = np.arange(len(target))
    for _ in range(10 * n + 10):
        slope = target[live] - np.einsum("gij,gj->gi", gram[live], x[live])
        slope[free[live]] = -np.inf
        enter = slope.argmax(1)
        up = slope[np.arange(len(live)), enter] > scale[live]
        live, enter = live[up], enter[up]
        if not len(live):
            break
        free[live, enter] = True
        inner = live
        while len(inner):
            f = free[inner]
            m = np.where(f[:, :, None] & f[:, None, :], gram[inner], 0) + np.eye(n) * ~f[:, None, :]
            best = np.where(f, np.linalg.solve(m, np.where(f, target[inner], 0)[..., None])[..., 0], 0)
            low = f & (best <= 0)
            more = low.any(1)
            x[inner[~more]] = best[~more]
            inner, low, best = inner[more], low[more], best[more]
            now = x[inner]
            step = np.where(low, now / np.maximum(now - best, 1e-300), np.inf).min(1, initial=np.inf, keepdims=True)
            now = np.maximum(now + np.where(np.isinf(step), 0, step) * (best - now), 0)
            free[inner] &= now > 0
            x[inner] = np.where(free[inner], now, 0)
            inner = inner[free[inner].any(1)]
    return x


def _kernel(g: pd.DataFrame, alpha: float, beta: float, bounds: bool) -> pd.DataFrame:
    """g: chrom, gene, side, region, isoform, value, b of whole genes, sorted by gene."""
    first = _starts(g, GENE)
    gene = np.cumsum(first) - 1
    code, names = pd.factorize(g["isoform"], sort=True)
    both, at = np.unique(gene * (len(names) + 1) + code + 1, return_inverse=True)
    home = both // (len(names) + 1)
    col, size = at - np.searchsorted(home, np.arange(gene[-1] + 1))[gene], np.bincount(home)
    long = (g["side"] == "L").to_numpy()
    weight = np.where(long, alpha, 1 - alpha)
    region, regions = pd.factorize(g["region"])
    x = np.zeros(len(both))
    small = size <= TOGETHER
    for genes in (*([np.flatnonzero(small)] if small.any() else []), *np.flatnonzero(~small)[:, None]):
        place = np.full(len(size), -1)
        place[genes] = np.arange(len(genes))
        n = size[genes].max()
        gram, target, low = np.tile(beta * np.eye(n), (len(genes), 1, 1)), np.zeros((len(genes), n)), np.zeros((len(genes), n))
        mine = np.flatnonzero((place[gene] >= 0) & (weight != 0))
        if len(mine):
            key, row, of = np.unique((gene[mine] * 2 + ~long[mine]) * (len(regions) + 1) + region[mine] + 1, return_index=True, return_inverse=True)
            owner, side = place[gene[mine][row]], long[mine][row]
            a, b = np.zeros((len(key), n)), np.zeros(len(key))
            a[of, col[mine]] = g["value"].to_numpy(float)[mine]
            b[of] = g["b"].to_numpy(float)[mine]
            total = np.bincount(owner[~side], b[~side], len(genes))
            b = np.where(~side & (total[owner] != 0), b / np.where(total[owner] != 0, total[owner], 1), b)
            w, has, starts = weight[mine][row][:, None], *np.unique(owner, return_index=True)
            # Few variables: sums of the regions' products. Many: one gene alone.
            gram[has] += np.add.reduceat((w * a)[:, :, None] * a[:, None, :], starts) if n <= TOGETHER else ((w * a).T @ a)[None]
            target[has] += np.add.reduceat(w * a * b[:, None], starts)
            if bounds:
                alone = np.flatnonzero((a != 0).sum(1) == 1)
                j = (a[alone] != 0).argmax(1)
                np.maximum.at(low, (owner[alone], j), b[alone] / a[alone, j])
        rest = target - np.einsum("gij,gj->gi", gram, low)
        found = low + (least_squares_of_many(gram, rest) if n <= TOGETHER else least_squares(gram[0], rest[0])[None])
        here = np.flatnonzero(place[home] >= 0)
        x[here] = found[place[home[here]], (np.arange(len(home)) - np.searchsorted(home, home))[here]]
    keys = g[GENE][first].reset_index(drop=True).iloc[home].reset_index(drop=True)
    label = np.append(np.asarray(names, object), None)[both % (len(names) + 1) - 1]
    return keys.assign(isoform=label, x=x)


def solve_genes(long: DataFrame, short: DataFrame | None = None, alpha: float = 1.0, beta: float = 1e-6, bounds: bool = False) -> DataFrame:
    """chrom, gene, isoform, x: of all x >= 0 the one of the least alpha |Lx - l|^2 + (1 - alpha) |Sx - s|^2 + beta |x|^2.

    long and short: chrom, gene, region, isoform, value (of the design matrix), b (of the region; short ones are divided by their sum). bounds: a region of one isoform alone gives it at least b over
    its value. Genes of one side only use that side. One shuffle; Python gets many whole genes at a time, each bounded by its own structure, not by reads.
    """
    columns = [*GENE, "region", "isoform", F.col("value").cast("double").alias("value"), F.col("b").cast("double").alias("b")]
    rows = long.select(F.lit("L").alias("side"), *columns)
    if short is not None:
        rows = rows.unionByName(short.select(F.lit("S").alias("side"), *columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _whole_groups(batches, GENE, lambda g: _kernel(g, alpha, beta, bounds))

    return rows.repartition(*GENE).sortWithinPartitions(*GENE).mapInPandas(run, "chrom string, gene string, isoform string, x double")


def reassign(design: DataFrame, x: DataFrame) -> DataFrame:
    """chrom, gene, isoform, count: a region's reads (b) go to its one isoform, or to its several ones by value times x.

    design: chrom, gene, region, isoform, value, b. Where some region with reads has no x at all, all x of the gene are raised by a hundredth of its smallest positive one, or
    are equal if none is positive.
    """
    d = design.where("value <> 0").join(x.select(*GENE, "isoform", "x"), [*GENE, "isoform"], "left").fillna(0.0, ["x"])
    region, gene = Window.partitionBy(*GENE, "region"), Window.partitionBy(*GENE)
    d = d.withColumn("n", F.count("*").over(region)).withColumn("whole", F.sum(F.col("value") * F.col("x")).over(region))
    poor = F.max((F.col("n") > 1) & (F.col("b") != 0) & (F.col("whole") == 0)).over(gene)
    d = d.withColumn("poor", poor)
    some = x.groupBy(*GENE).agg(F.min(F.when(F.col("x") > 0, F.col("x"))).alias("least"))
    d = d.join(some, GENE, "left")
    theta = F.when(~F.col("poor"), F.col("x")).when(F.col("least").isNull(), F.lit(1.0)).otherwise(F.col("x") + 0.01 * F.col("least"))
    d = d.withColumn("w", F.col("value") * theta).withColumn("whole", F.sum("w").over(region))
    count = F.when(F.col("n") == 1, F.col("b")).when(F.col("b") == 0, 0.0).otherwise(F.col("b") * F.col("w") / F.col("whole"))
    return d.groupBy(*GENE, "isoform").agg(F.sum(count).alias("count"))


def estimate(long: DataFrame, short: DataFrame | None = None, alpha: float = 1.0, beta: float = 1e-6, linear: bool = False, bounds: bool = False) -> DataFrame:
    """chrom, gene, isoform, count: the reads of each isoform. Genes without reads have 0.

    The programme's x are shares of one. linear: all reads of the gene go by these; otherwise each region's reads by its isoforms' (reassign).
    """
    x = solve_genes(long, short, alpha, beta, bounds)
    total = F.sum("x").over(Window.partitionBy(*GENE))
    # The programme is solved once, whatever asks for its shares.
    x = materialize(x.withColumn("x", F.when(total > 0, F.col("x") / total).otherwise(0.0)), "shares")
    if linear:
        reads = long.select(*GENE, "region", "b").distinct().groupBy(*GENE).agg(F.sum("b").alias("reads"))
        return x.join(reads, GENE, "left").select(*GENE, "isoform", (F.col("x") * F.coalesce("reads", F.lit(0.0))).alias("count"))
    return x.join(reassign(long, x), [*GENE, "isoform"], "left").select(*GENE, "isoform", F.coalesce("count", F.lit(0.0)).alias("count"))


def gene_expression(counts: DataFrame, short_tpm: DataFrame, alpha: float | DataFrame = 1.0) -> DataFrame:
    """chrom, gene, isoform, count, long_tpm, short_tpm, alpha, tpm: long reads' counts per million of all, mixed with the short reads' TPM (isoform, tpm). alpha: one number, or a table
    (gene, alpha), where genes that it lacks have 1."""
    total = counts.agg(F.sum("count")).first()[0] or 1.0
    t = counts.withColumn("long_tpm", F.col("count") / F.lit(float(total)) * 1e6)
    t = t.join(short_tpm.groupBy("isoform").agg(F.max("tpm").alias("short_tpm")), "isoform", "left").fillna(0.0, ["short_tpm"])
    t = t.join(alpha.select("gene", "alpha"), "gene", "left").fillna(1.0, ["alpha"]) if isinstance(alpha, DataFrame) else t.withColumn("alpha", F.lit(float(alpha)))
    return t.select(*GENE, "isoform", "count", "long_tpm", "short_tpm", "alpha", ((1 - F.col("alpha")) * F.col("short_tpm") + F.col("alpha") * F.col("long_tpm")).alias("tpm"))
