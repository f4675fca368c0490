"""Connected components, and the communities of genes that multi-gene reads link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators.store import discard, materialize

#: Edges that one task may hold: a graph of so many or fewer is finished in one.
ONE_TASK = 1 << 20


class Forest:
    """Disjoint sets over positions 0..n-1; the root of a set is its smallest position."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def contracted(u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """The edges as stars: every node (u) but the smallest of its component, with the smallest (v)."""
    at, nodes = pd.factorize(pd.concat([u, v], ignore_index=True), sort=True)
    f = Forest(len(nodes))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        f.union(x, y)
    root = np.array([f.find(x) for x in range(len(nodes))], np.int64)
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[leaf], "v": nodes[root[leaf]]})


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield contracted(b["u"], b["v"])


def _all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every = list(batches)
    if every:
        e = pd.concat(every, ignore_index=True)
        yield contracted(e["u"], e["v"])


def stars(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges (u, v of any ordered type), in any direction, repeats allowed -> (node, root): the smallest node of its component.

    Only nodes that are not their own root are listed; nulls and loops are left out. Each batch of edges is first contracted to stars, which leaves a forest of no more
    edges than the batch has nodes. What is left is finished in one task if it has at most one_task edges. Otherwise large-star and small-star
    steps alternate: each node tells its larger (then its smaller) neighbours of its smallest one, until all components are
    stars. Steps are joins and grouped minima over no more edges than before; each is written to the shared folder, and what the one before wrote is deleted.
    """
    schema = edges.select("u", "v").schema
    kept = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialize(kept.mapInPandas(_each, schema).distinct(), "edges")
    named = {"u": "node", "v": "root"}
    if e.limit(one_task + 1).count() <= one_task:
        return materialize(e.coalesce(1).mapInPandas(_all, schema), "stars").withColumnsRenamed(named)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, before = materialize(large, "large-star"), e
        discard(before)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        far = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(far.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large)
        # Stars: every u has one edge, and no v is a u.
        roles = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        roles = roles.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if roles.where("out > 1 OR out = 1 AND in = 1").isEmpty():
            return e.withColumnsRenamed(named)


def components(edges: DataFrame, u: str = "u", v: str = "v", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node of its component, for every node of edges (of any ordered type, in any direction)."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).where("node IS NOT NULL").distinct()
    return nodes.join(stars(e, one_task), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def gene_communities(read_isoform: DataFrame, isoforms: DataFrame) -> DataFrame:
    """(gene, community): components over reads, isoforms and genes. read_isoform (read, gene, ...), isoforms (gene, ...).

    Every isoform hangs on its gene, so components over genes suffice, linked by reads of several genes. A read's genes are a star around its smallest, not all pairs.
    """
    pairs = read_isoform.select("read", "gene").distinct()
    per_read = pairs.groupBy("read").agg(F.min("gene").alias("u"), F.max("gene").alias("far")).where("u <> far").drop("far")
    links = pairs.join(per_read, "read").where("u <> gene").select("u", F.col("gene").alias("v")).distinct()
    found = stars(links)
    return isoforms.select("gene").distinct().join(found.withColumnRenamed("node", "gene"), "gene", "left").select("gene", F.coalesce("root", "gene").alias("community"))
