"""Expectation-maximisation of isoform abundances, by community (bulk, hybrid) and by community and cell."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandflow.config import EmSettings
from strandflow.operators.classes import copies, number, sharded
from strandflow.operators.store import discard, materialize, new_dir

_TINY = 1e-100
#: Isoforms with a smaller share do not hold up the end of the iteration.
_MINOR = 1e-7
#: Rows that a task holds where a community iterates over shards.
ROWS_IN_SHARD = 1_000_000
_BULK = "isoform {iso}, theta double, iterations int"


def classes(cond: DataFrame) -> DataFrame:
    """community, hits (sorted isoform, p and m), n: reads with the same isoforms and probabilities as one row.

    Reads of one region and length agree in all of them, so that what an iteration holds grows with distinct classes, not with reads. Rows of cond may stand for n reads themselves, and for m isoforms alike.
    """
    per_read = cond.groupBy("community", "read").agg(F.array_sort(F.collect_list(F.struct("isoform", "p", copies(cond).alias("m")))).alias("hits"), F.max(number(cond)).alias("n"))
    return per_read.groupBy("community", "hits").agg(F.sum("n").alias("n"))


def _of_reads(cond: DataFrame, read: str, p: str) -> DataFrame:
    return cond.select("community", F.col(read).alias("read"), "isoform", F.coalesce(p, F.lit(0.0)).alias("p"), number(cond).alias("n"), copies(cond).alias("m"))


def _shares(row: np.ndarray, iso: np.ndarray, p: np.ndarray, theta: np.ndarray, weight: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Reads that each isoform gets: every row's weight, dealt by p times theta. m: how many isoforms alike each stands for."""
    q = p * theta[iso]
    total = np.bincount(row, q * m[iso], len(weight))
    total[total == 0] = 1
    return np.bincount(iso, q * (weight / total)[row], len(theta))


def _starts(g: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether each row is the first of its group; rows are sorted by the keys, nulls included."""
    first = np.zeros(len(g), bool)
    first[:1] = True
    for c in keys:
        code = pd.factorize(g[c])[0]
        first[1:] |= code[1:] != code[:-1]
    return first


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kernel of many whole groups at a time, from batches sorted by the keys. Holds a batch and the group that the batch ends in."""
    waiting: list[pd.DataFrame] = []  # parts of one group, whose end is not known yet
    for b in batches:
        if not len(b):
            continue
        tail = len(waiting[-1]) if waiting else 0
        starts = np.flatnonzero(_starts(pd.concat([*waiting[-1:], b], ignore_index=True), keys))
        cut = int(starts[-1]) - tail  # rows of b before its last group; no new group begins in b if this is negative
        if cut < 0 or cut == 0 and not waiting:
            waiting.append(b)
            continue
        yield kernel(pd.concat([*waiting, b[:cut]], ignore_index=True))
        waiting = [b[cut:]]
    if waiting:
        yield kernel(pd.concat(waiting, ignore_index=True))


class _Communities:
    """The isoforms of several communities in one table, and sums by community. Rows are sorted by community."""

    def __init__(self, g: pd.DataFrame):
        first = _starts(g, ["community"])
        self.of_row = np.cumsum(first) - 1
        self.names = g["community"][first].reset_index(drop=True)
        name, names = pd.factorize(g["isoform"], sort=True)
        self.iso, isos = pd.factorize(self.of_row * len(names) + name, sort=True)
        self.home, self.isoform = isos // max(len(names), 1), names[isos % max(len(names), 1)]
        self.m = np.ones(len(isos))
        self.m[self.iso] = g["m"] if "m" in g else 1.0
        self.size = np.bincount(self.home, self.m, len(self.names))

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.home, x * self.m, len(self.names))

    def numbered(self, row: pd.Series, which: np.ndarray) -> tuple[np.ndarray, int]:
        """Rows' numbers by community and name, and how many there are."""
        code, names = pd.factorize(row[which])
        found, rows = pd.factorize(self.of_row[which] * (len(names) + 1) + code)
        return found, len(rows)

    def iterate(self, step: Callable[[np.ndarray], np.ndarray], s: EmSettings) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Thetas and iterations; a community stands still once its own thetas are settled. step: shares before they are normalised."""
        theta, going, k, seen = 1.0 / self.size[self.home], np.ones(len(self.names), bool), np.zeros(len(self.names), np.int32), []
        for n in range(1, s.iterations + 1):
            x = step(theta)
            total = self.total(x)
            x = x / np.where(total > 0, total, 1)[self.home]
            new = np.where(going[self.home], np.where(x < _TINY, 0, x), theta)
            k[going] = n
            moved = (new > _MINOR) & (np.abs(theta - new) > s.tolerance * new)
            theta, going = new, going & (self.total(moved) > 0)
            seen.append(new)
            if not going.any():
                break
        return theta, k, seen

    def table(self, **columns) -> pd.DataFrame:
        return pd.DataFrame({"community": self.names.iloc[self.home].reset_index(drop=True), "isoform": self.isoform, **columns})


def bulk_kernel(g: pd.DataFrame, s: EmSettings, history: bool = False) -> pd.DataFrame:
    """g: community, row, isoform, p, n, m of whole communities, sorted by community. history: a row for each iteration, numbered from 1 in iterations."""
    c = _Communities(g)
    row, n_rows = c.numbered(g["row"], np.ones(len(g), bool))
    weight = np.zeros(n_rows)
    weight[row] = g["n"]
    p = g["p"].to_numpy(float)
    theta, k, seen = c.iterate(lambda t: _shares(row, c.iso, p, t, weight, c.m), s)
    if not history:
        return c.table(theta=theta, iterations=k[c.home])
    return pd.concat([c.table(theta=x, iterations=np.int32(n))[k[c.home] >= n] for n, x in enumerate(seen, 1)], ignore_index=True)


def bulk_history(cond: DataFrame, s: EmSettings = EmSettings()) -> DataFrame:
    """community, isoform, theta, iteration: the thetas after each iteration, for reports; in the same two forms as bulk_em."""
    spark = cond.sparkSession
    c = materialize(classes(_of_reads(cond, "read", "p")), "classes")
    size = materialize(c.groupBy("community").agg(F.sum(F.size("hits")).alias("rows")), "communities")
    small, large = size.where(F.col("rows") <= s.rows_in_task), size.where(F.col("rows") > s.rows_in_task)
    rows, schema = _hits(c), _schema(cond, _BULK)
    found = _by_community(rows.join(small.select("community"), "community", "left_semi"), lambda g: bulk_kernel(g, s, True), schema)
    if large.limit(1).count():
        seen: list[DataFrame] = []
        _large(rows.join(large.select("community"), "community", "left_semi"), s, seen)
        for x in seen:
            found = found.unionByName(x.to(spark.createDataFrame([], schema).schema))
    return found.withColumnRenamed("iterations", "iteration")


def _hits(classes: DataFrame) -> DataFrame:
    """A row a class and isoform. home: a number of the first isoform; classes that share their isoforms share it."""
    rows = classes.select("community", F.xxhash64("hits").alias("row"), F.xxhash64(F.col("hits")[0]["isoform"]).alias("home"), "n", F.explode("hits").alias("h"))
    return rows.select("community", "row", "home", "n", "h.isoform", "h.p", "h.m")


def _schema(df: DataFrame, columns: str) -> str:
    kind = {c: df.schema[c].dataType.simpleString() for c in ("community", "isoform")}
    return f"community {kind['community']}, " + columns.format(iso=kind["isoform"])


def _by_community(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One shuffle by community; Python gets many small communities at a time."""
    return rows.drop("home").repartition("community").sortWithinPartitions("community").mapInPandas(lambda b: _whole_groups(b, ["community"], kernel), schema)


def bulk_em(cond: DataFrame, s: EmSettings = EmSettings()) -> DataFrame:
    """cond (community, read, isoform, p) -> community, isoform, theta, iterations, community_reads, cpm, expected_reads. With a column n a row stands for n reads alike, with a column m for m isoforms alike, whose values are those of each.

    A community whose classes have more than s.rows_in_task rows does not go to one task: it iterates as joins and grouped sums.
    A community without any positive probability ends with theta 0. Null p counts as 0. No reads: no rows.
    """
    spark = cond.sparkSession
    c = materialize(classes(_of_reads(cond, "read", "p")), "classes")
    size = c.groupBy("community").agg(F.sum(F.size("hits")).alias("rows"), F.sum("n").alias("community_reads"))
    size = materialize(size, "communities")
    total = size.agg(F.sum("community_reads")).first()[0] or 0
    rows, schema = _hits(c), _schema(cond, _BULK)
    small, large = size.where(F.col("rows") <= s.rows_in_task), size.where(F.col("rows") > s.rows_in_task)
    found = _by_community(rows.join(small.select("community"), "community", "left_semi"), lambda g: bulk_kernel(g, s), schema)
    if large.limit(1).count():
        found = found.unionByName(_large(rows.join(large.select("community"), "community", "left_semi"), s).to(spark.createDataFrame([], schema).schema))
    out = found.join(size.select("community", "community_reads"), "community")
    expected = F.col("community_reads") * F.col("theta")
    return out.withColumn("cpm", expected / F.lit(float(total or 1)) * 1e6).withColumn("expected_reads", expected)


def _share_kernel(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """What the rows of one shard give each isoform, by kind; given: theta and eff of the isoforms that the shard asks for."""
    m = rows.merge(given, on=["community", "isoform"])
    row = m.groupby(["community", "kind", "row"], sort=False).ngroup().to_numpy()
    is_long = (m["kind"] == "L").to_numpy()
    q = m["p"].to_numpy(float) * m["theta"].to_numpy(float) * np.where(is_long, 1.0, m["eff"].to_numpy(float))
    total = np.bincount(row, q * m["m"].to_numpy(float))
    total[total == 0] = 1
    share = q * m["n"].to_numpy(float) / total[row]
    out = m[["community", "isoform"]].assign(long=np.where(is_long, share, 0.0), short=np.where(is_long, 0.0, share))
    return out.groupby(["community", "isoform"], sort=False, as_index=False).sum()


class _Shards:
    """Rows (community, kind, row, home, isoform, p, n, m) of large communities, written once in buckets by shard. A round moves the numbers of the isoforms that a shard asks for and its
    sums, never rows: rows that share their isoforms share a shard, unless they are too many for one."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.kinds = {c: rows.schema[c].dataType.simpleString() for c in ("community", "isoform")}
        dealt, parts = sharded(rows, int(self.spark.conf.get("spark.sql.shuffle.partitions")), ROWS_IN_SHARD)
        self.table = f"rows_{uuid.uuid4().hex}"
        dealt.repartition(parts, "shard").write.bucketBy(parts, "shard").option("path", new_dir(self.spark, "rows")).saveAsTable(self.table)
        self.rows = self.spark.table(self.table)
        self.asked = materialize(self.rows.select("shard", "community", "isoform").distinct(), "asked")

    def sums(self, theta: DataFrame) -> DataFrame:
        """community, isoform, long, short. theta: community, isoform, theta, eff."""
        given = self.asked.join(theta, ["community", "isoform"]).groupBy("shard")
        kinds = self.kinds
        found = self.rows.groupBy("shard").cogroup(given).applyInPandas(_share_kernel, f"community {kinds['community']}, isoform {kinds['isoform']}, long double, short double")
        return found.groupBy("community", "isoform").agg(F.sum("long").alias("long"), F.sum("short").alias("short"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _large(rows: DataFrame, s: EmSettings, seen: list[DataFrame] | None = None) -> DataFrame:
    """The same iteration over shards of rows. What an iteration writes is deleted when the next one has it, unless seen gathers the thetas of each."""
    shards = _Shards(rows.withColumn("kind", F.lit("L")))
    n = F.sum("m").over(Window.partitionBy("community"))
    written = materialize(shards.rows.select("community", "isoform", "m").distinct().withColumn("theta", 1 / n), "theta")
    theta = written
    for k in range(1, s.iterations + 1):
        new = shards.sums(theta.select("community", "isoform", "theta", F.lit(1.0).alias("eff"))).select("community", "isoform", F.col("long").alias("share"))
        new = new.join(theta, ["community", "isoform"])
        every = new.groupBy("community").agg(F.sum(F.col("share") * F.col("m")).alias("every"))
        value = F.when(F.col("every") > 0, F.col("share") / F.col("every")).otherwise(0.0)
        new = new.join(every, "community").withColumn("value", value)
        new = materialize(new.select("community", "isoform", "m", F.when(F.col("value") < _TINY, 0.0).otherwise(F.col("value")).alias("new"), "theta"), "theta")
        open_ = new.where((F.col("new") > _MINOR) & (F.abs(F.col("new") - F.col("theta")) > s.tolerance * F.col("new"))).limit(1).count()
        if seen is None:
            discard(written)
        else:
            seen.append(new.select("community", "isoform", F.col("new").alias("theta"), F.lit(k).cast("int").alias("iterations")))
        written, theta = new, new.select("community", "isoform", "m", F.col("new").alias("theta"))
        if not open_:
            break
    shards.drop()
    return theta.drop("m").withColumn("iterations", F.lit(k).cast("int"))


def hybrid_kernel(g: pd.DataFrame, s: EmSettings) -> pd.DataFrame:
    """g: community, kind (L, S or I), row, isoform, p, n, m, eff_len and alpha of whole communities, sorted by community; the rows I list their isoforms with effective lengths."""
    c = _Communities(g)
    kind, p, n = g["kind"].to_numpy(), g["p"].to_numpy(float), g["n"].to_numpy(float)
    eff = np.ones(len(c.home))
    eff[c.iso[kind == "I"]] = g["eff_len"].to_numpy(float)[kind == "I"]
    alpha = np.zeros(len(c.names))
    np.maximum.at(alpha, c.of_row, g["alpha"].to_numpy(float))
    alpha = alpha[c.home]
    sides = {}
    for k in "LS":
        row, rows = c.numbered(g["row"], kind == k)
        weight = np.zeros(rows)
        weight[row] = n[kind == k]
        sides[k] = (row, c.iso[kind == k], p[kind == k], weight)
    once = np.unique(sides["S"][0], return_index=True)[1]
    fragments = np.bincount(c.of_row[kind == "S"][once], n[kind == "S"][once], minlength=len(c.names))

    def step(theta: np.ndarray) -> np.ndarray:
        long = alpha * _shares(*sides["L"][:3], theta, sides["L"][3], c.m)
        short = (1 - alpha) * _shares(*sides["S"][:3], theta * eff, sides["S"][3], c.m)
        mass = c.total(theta * eff)
        below = (c.total(short) / np.where(mass > 0, mass, 1))[c.home] * eff + c.total(long)[c.home]
        return np.divide(short + long, below, out=np.zeros(len(eff)), where=below > 0)

    theta, k, _ = c.iterate(step, s)
    mass = c.total(theta * eff)
    return c.table(theta=theta, iterations=k[c.home], expression=np.where(mass > 0, fragments / np.where(mass > 0, mass, 1), 0)[c.home] * theta, m=c.m.astype(np.int64))


def hybrid_em(long: DataFrame, short: DataFrame, isoforms: DataFrame, alpha: DataFrame | float, s: EmSettings = EmSettings()) -> DataFrame:
    """long (community, read, isoform, p), short (community, fragment, isoform, ant), isoforms (community, isoform, eff_len); alpha: one
    number or a table (community, alpha), where communities that it lacks have 0.5. Gives community, isoform, theta, iterations, tpm.

    Reads, and fragments, of the same isoforms and values are one row with their number n, which both tables may have already. All three may have m where a row stands for isoforms alike. Isoforms whose community lacks reads of both kinds end with theta 0. A community of more
    than s.rows_in_task rows iterates as joins and grouped sums.
    """
    spark = isoforms.sparkSession
    schema = _schema(isoforms, _BULK + ", expression double, m bigint")
    none = F.lit(None).cast("double")

    def side(kind: str, reads: DataFrame) -> DataFrame:
        return _hits(classes(reads)).select("community", F.lit(kind).alias("kind"), "row", "home", "isoform", "p", "n", "m", none.alias("eff_len"))

    every = side("L", _of_reads(long, "read", "p")).unionByName(side("S", _of_reads(short, "fragment", "ant")))
    zero = F.lit(0).cast("long")
    names = isoforms.select("community", F.lit("I").alias("kind"), zero.alias("row"), zero.alias("home"), "isoform", none.alias("p"), zero.alias("n"), copies(isoforms).alias("m"), "eff_len")
    every = every.unionByName(names)
    if isinstance(alpha, DataFrame):
        every = every.join(alpha.select("community", "alpha"), "community", "left").fillna(0.5, ["alpha"])
    else:
        every = every.withColumn("alpha", F.lit(float(alpha)))
    every = materialize(every, "sides")

    size = every.groupBy("community").agg(F.count("*").alias("rows"))
    large = materialize(size.where(F.col("rows") > s.rows_in_task).select("community"), "large")
    if large.isEmpty():
        found = _by_community(every, lambda g: hybrid_kernel(g, s), schema)
    else:
        found = _by_community(every.join(large, "community", "left_anti"), lambda g: hybrid_kernel(g, s), schema)
        found = found.unionByName(_hybrid_large(every.join(large, "community", "left_semi"), s).to(spark.createDataFrame([], schema).schema))
    out = materialize(found, "hybrid")
    discard(every)
    total = out.agg(F.sum(F.col("expression") * F.col("m"))).first()[0] or 1.0
    return out.withColumn("tpm", F.col("expression") / F.lit(float(total)) * 1e6).drop("expression", "m")


def _hybrid_large(every: DataFrame, s: EmSettings) -> DataFrame:
    """The same iteration over shards of rows."""
    shards = _Shards(every.where("kind <> 'I'").select("community", "kind", "row", "home", "isoform", "p", "n", "m"))
    names = every.groupBy("community", "isoform").agg(F.coalesce(F.max("eff_len"), F.lit(1.0)).alias("eff"), F.max("alpha").alias("alpha"), F.max("m").alias("m"))
    whole = Window.partitionBy("community")
    theta = materialize(names.withColumn("theta", 1 / F.sum("m").over(whole)), "theta")
    for k in range(1, s.iterations + 1):
        dealt = shards.sums(theta.select("community", "isoform", "theta", "eff"))
        new = theta.join(dealt, ["community", "isoform"], "left").fillna(0.0, ["short", "long"])
        new = new.withColumns({"short": (1 - F.col("alpha")) * F.col("short"), "long": F.col("alpha") * F.col("long")})
        m = F.col("m")
        totals = new.groupBy("community").agg(F.sum(m * F.col("short")).alias("all_short"), F.sum(m * F.col("long")).alias("all_long"), F.sum(m * F.col("theta") * F.col("eff")).alias("mass"))
        below = F.col("all_short") * F.col("eff") / F.when(F.col("mass") > 0, F.col("mass")).otherwise(1.0) + F.col("all_long")
        new = new.join(totals, "community").withColumn("x", F.when(below > 0, (F.col("short") + F.col("long")) / below).otherwise(0.0))
        every_x = new.groupBy("community").agg(F.sum(m * F.col("x")).alias("every_x"))
        value = F.when(F.col("every_x") > 0, F.col("x") / F.col("every_x")).otherwise(0.0)
        new = new.join(every_x, "community").select("community", "isoform", "eff", "alpha", "m", F.col("theta").alias("old"), F.when(value < _TINY, 0.0).otherwise(value).alias("theta"))
        new = materialize(new, "theta")
        open_ = not new.where((F.col("theta") > _MINOR) & (F.abs(F.col("theta") - F.col("old")) > s.tolerance * F.col("theta"))).isEmpty()
        discard(theta)
        theta = new
        if not open_:
            break
    fragments = materialize(shards.rows.where("kind = 'S'").select("community", "row", "n").distinct().groupBy("community").agg(F.sum("n").alias("fragments")), "fragments")
    shards.drop()
    mass = F.sum(F.col("theta") * F.col("eff") * F.col("m")).over(whole)
    out = theta.withColumn("mass", mass).join(fragments, "community", "left").fillna(0, ["fragments"])
    expression = F.when(F.col("mass") > 0, F.col("fragments") * F.col("theta") / F.col("mass")).otherwise(0.0)
    return out.select("community", "isoform", "theta", F.lit(k).cast("int").alias("iterations"), expression.alias("expression"), "m")


def molecules(cond: DataFrame) -> DataFrame:
    """The largest p of each isoform over the reads of a molecule (community, barcode, umi)."""
    return cond.groupBy("community", "barcode", "umi", "isoform").agg(F.max("p").alias("p"))


_CELL = ["community", "barcode"]


def _cell_thetas(cell: np.ndarray, row: np.ndarray, name: np.ndarray, p: np.ndarray, m: np.ndarray, weight: np.ndarray, s: EmSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, isoform and theta of each isoform of a cell. A row of each molecule, or of weight molecules alike of one cell, and isoform: its cell, molecule, isoform, p, and how many isoforms alike it stands for.

    All cells iterate at once, each on its own. A cell starts from its molecules of one isoform, and stops when none of its thetas moves by the tolerance.
    """
    n_cells, n_names = int(cell.max(initial=-1)) + 1, int(name.max(initial=-1)) + 1
    iso, isos = pd.factorize(cell * n_names + name, sort=True)
    home = isos // max(n_names, 1)
    at = np.searchsorted(home, np.arange(n_cells))
    many = np.ones(len(isos))
    many[iso] = m
    alone = (p > 0) & (np.bincount(row, (p > 0) * m, len(weight))[row] == 1)
    theta = np.bincount(iso[alone], weight[row[alone]], len(isos))
    total = np.bincount(home, theta * many, n_cells)
    theta = np.where(total[home] > 0, theta / np.where(total > 0, total, 1)[home], 1 / np.bincount(home, many, n_cells)[home])
    going = np.ones(n_cells, bool)
    for _ in range(s.iterations):
        q = p * theta[iso]
        whole = np.bincount(row, q * m, len(weight))
        x = np.bincount(iso, q * (weight / np.where(whole > 0, whole, 1))[row], len(isos))
        total = np.bincount(home, x * many, n_cells)
        going &= total > 0
        new = np.where(going[home], x / np.where(total > 0, total, 1)[home], theta)
        moved, theta = np.maximum.reduceat(np.abs(new - theta), at), new
        going &= moved >= s.tolerance
        if not going.any():
            break
        if going.mean() < 0.5:  # entries of cells that have stopped go
            keep = going[cell]
            cell, row, iso, p, m = cell[keep], row[keep], iso[keep], p[keep], m[keep]
    return home, isos % max(n_names, 1), theta


def unit_kernel(g: pd.DataFrame, s: EmSettings) -> pd.DataFrame:
    """g: community, barcode, umi, isoform, p of whole cells, sorted by community and cell."""
    first = _starts(g, _CELL)
    cell = np.cumsum(first) - 1
    umi, umis = pd.factorize(g["umi"])
    row, rows = pd.factorize(cell * (len(umis) + 1) + umi + 1)
    name, names = pd.factorize(g["isoform"], sort=True)
    home, iso, theta = _cell_thetas(cell, row, name, g["p"].to_numpy(float), np.ones(len(g)), np.ones(len(rows)), s)
    molecules_of = np.bincount(rows // (len(umis) + 1), minlength=int(first.sum()))
    heads = g[_CELL][first].iloc[home].reset_index(drop=True)
    return heads.assign(isoform=names[iso], theta=theta, n=molecules_of[home].astype(np.int64))


def unit_em(cond: DataFrame, s: EmSettings = EmSettings()) -> DataFrame:
    """cond (community, barcode, umi, isoform, p) -> community, barcode, isoform, theta, n (molecules).

    Molecules are written once; one shuffle more, by community and cell. Python gets sorted batches of many small cells; it holds a batch and the cell that the batch ends in. A cell of more than s.rows_in_task rows in
    one community iterates as joins and grouped sums.
    """
    spark = cond.sparkSession
    t = {c: cond.schema[c].dataType.simpleString() for c in ("community", "barcode", "isoform")}
    schema = f"community {t['community']}, barcode {t['barcode']}, isoform {t['isoform']}, theta double, n bigint"

    def small(rows: DataFrame) -> DataFrame:
        return rows.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(lambda b: _whole_groups(b, _CELL, lambda g: unit_kernel(g, s)), schema)

    mol = materialize(molecules(cond), "molecules")
    large = materialize(mol.groupBy(*_CELL).agg(F.count("*").alias("rows")).where(F.col("rows") > s.rows_in_task).drop("rows"), "large")
    if large.isEmpty():
        return small(mol)
    own = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _CELL]
    found = _unit_large(mol.alias("l").join(large.alias("r"), own, "left_semi"), s)
    return small(mol.alias("l").join(large.alias("r"), own, "left_anti")).unionByName(found.to(spark.createDataFrame([], schema).schema))


def molecule_kinds(reads: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reads (barcode, umi, class) and values (read, which names a class, community, isoform, p, and m for isoforms alike) -> molecules (community, barcode, umi, kind) and
    kinds (community, kind, isoform, p, m), as molecules gives them, without a row for each molecule and isoform: molecules whose reads are of the same classes are of one kind, whose p are the largest of its classes."""
    names = materialize(values.select(F.col("read").alias("class"), "community").distinct().withColumn("id", F.monotonically_increasing_id()), "classes")
    ids = F.array_sort(F.collect_set("id"))
    found = reads.select("barcode", "umi", "class").join(names, "class").groupBy("community", "barcode", "umi").agg(F.array_join(ids.cast("array<string>"), ",").alias("kind"))
    found = materialize(found, "molecules")
    each = found.select("community", "kind").distinct().withColumn("id", F.explode(F.split("kind", ",").cast("array<long>"))).join(names.drop("community"), "id")
    kinds = each.join(values.withColumnRenamed("read", "class"), ["class", "community"]).groupBy("community", "kind", "isoform").agg(F.max("p").alias("p"), F.max(copies(values)).alias("m"))
    return found, materialize(kinds, "kinds")


def _kind_kernel(cells: pa.Table, kinds: pa.Table, s: EmSettings, schema: pa.Schema) -> pa.Table:
    """cells: barcode, kind, n of whole cells of one community; kinds: kind, isoform, p, m."""
    place = pc.sort_indices(kinds["kind"])
    kinds = kinds.take(place).combine_chunks()
    kind = kinds["kind"].combine_chunks().dictionary_encode()
    first = np.flatnonzero(np.diff(kind.indices.to_numpy(), prepend=-1))
    size = np.diff(first, append=len(kinds))
    at = pc.index_in(cells["kind"].combine_chunks(), kind.dictionary).to_numpy()
    barcode = cells["barcode"].combine_chunks().dictionary_encode(null_encoding="encode")
    cell, n = barcode.indices.to_numpy(), cells["n"].to_numpy().astype(float)
    isoform = kinds["isoform"].combine_chunks().dictionary_encode()
    row = np.repeat(np.arange(len(at)), size[at])
    of = np.arange(len(row)) - np.repeat(np.cumsum(size[at]) - size[at] - first[at], size[at])
    home, iso, theta = _cell_thetas(cell[row].astype(np.int64), row, isoform.indices.to_numpy()[of], kinds["p"].to_numpy()[of], kinds["m"].to_numpy()[of].astype(float), n, s)
    molecules_of = np.bincount(cell, n).astype(np.int64)
    community = pa.repeat(cells["community"][0], len(home)) if len(home) else pa.nulls(0, schema.field("community").type)
    return pa.table([community, barcode.dictionary.take(pa.array(home)), isoform.dictionary.take(pa.array(iso)), pa.array(theta), pa.array(molecules_of[home])], schema=schema)


def unit_em_kinds(mol: DataFrame, kinds: DataFrame, s: EmSettings = EmSettings()) -> DataFrame:
    """unit_em of what molecule_kinds gives: community, barcode, isoform, theta, n, with the values of each isoform alike. Cells' rows are made from their kinds in the tasks, about ROWS_IN_SHARD at a time, and are neither written nor shuffled; only a
    cell of more than s.rows_in_task rows iterates as joins, over its kinds and blocks of isoforms."""
    cells = materialize(mol.groupBy(*_CELL, "kind").agg(F.count("*").alias("n")), "cells")
    size = materialize(kinds.groupBy("community", "kind").agg(F.count("*").alias("rows")), "sizes")
    rows = materialize(cells.join(size, ["community", "kind"]).groupBy(*_CELL).agg(F.sum("rows").alias("rows")), "rows")
    large = rows.where(F.col("rows") > s.rows_in_task).drop("rows")
    parts = materialize(rows.where(F.col("rows") <= s.rows_in_task).groupBy("community").agg(F.ceil(F.sum("rows") / ROWS_IN_SHARD).alias("parts")), "parts")
    own = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _CELL]
    some = not large.isEmpty()
    left = cells.alias("l").join(large.alias("r"), own, "left_anti") if some else cells
    dealt = left.join(parts, "community").withColumn("part", F.pmod(F.xxhash64("barcode"), F.col("parts"))).drop("parts")
    given = kinds.join(parts, "community").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    t = {c: f.dataType.simpleString() for f in [*cells.schema, *kinds.schema] for c in [f.name]}
    schema = f"community {t['community']}, barcode {t['barcode']}, isoform {t['isoform']}, theta double, n bigint"
    arrow = to_arrow_schema(cells.sparkSession.createDataFrame([], schema).schema)
    found = dealt.groupBy("community", "part").cogroup(given.groupBy("community", "part")).applyInArrow(lambda a, b: _kind_kernel(a, b, s, arrow), schema)
    if not some:
        return found
    held = cells.alias("l").join(large.alias("r"), own, "left_semi")
    return found.unionByName(_kinds_large(held, kinds, s).to(cells.sparkSession.createDataFrame([], schema).schema))


def _total(values: Column, m: Column) -> Column:
    return F.aggregate(F.zip_with(values, m, lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)


def _summed(rows: Column, size: Column) -> Column:
    """rows (by, values), of arrays of one length, added up."""
    zero = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(rows, zero, lambda a, r: F.zip_with(a, r["values"], lambda x, v: x + r["by"] * v))


def _kinds_large(cells: DataFrame, kinds: DataFrame, s: EmSettings) -> DataFrame:
    """The iteration of _unit_large over cells' kinds (community, barcode, kind, n). Isoforms that belong to the same kinds are a block, whose values are one array: a round joins and sums arrays of blocks, with as many
    rows as cells have kinds, not kinds times isoforms."""
    of = Window.partitionBy("community", "kind")
    block = kinds.groupBy("community", "isoform").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("kind")), ";"), 256).alias("block"))
    hits = F.sum((F.col("p") > 0).cast("int") * F.col("m")).over(of)
    packed = kinds.withColumn("alone", ((F.col("p") > 0) & (hits == 1)).cast("double")).join(block, ["community", "isoform"])
    packed = packed.groupBy("community", "kind", "block").agg(F.array_sort(F.collect_list(F.struct("isoform", "p", "alone", "m"))).alias("x"))
    packed = materialize(packed.select("community", "kind", "block", *[F.col(f"x.{c}").alias(c) for c in ("isoform", "p", "alone", "m")]), "blocks")
    names = packed.groupBy("community", "block").agg(F.first("isoform").alias("isoform"))
    rows = cells.join(packed.drop("isoform"), ["community", "kind"])
    cell, part, m = Window.partitionBy(*_CELL), [*_CELL, "block"], F.col("m")
    start = rows.groupBy(*part).agg(F.first("m").alias("m"), F.collect_list(F.struct(F.col("n").alias("by"), F.col("alone").alias("values"))).alias("l"))
    start = start.select(*part, "m", _summed(F.col("l"), F.size("m")).alias("x"))
    total, every = F.sum(_total(F.col("x"), m)).over(cell), F.sum(F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x)).over(cell)
    start = start.withColumn("total", total).withColumn("every", every)
    start = start.withColumn("theta", F.transform("x", lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(1 / F.col("every"))))
    theta = materialize(start.select(*part, "m", "theta", F.lit(True).alias("going")), "theta")
    for _ in range(s.iterations):
        q = rows.drop("m", "alone").join(theta.where("going").drop("going"), part)
        q = q.withColumn("whole", F.sum(_total(F.zip_with("p", "theta", lambda x, y: x * y), m)).over(Window.partitionBy(*_CELL, "kind")))
        by = F.when(F.col("whole") > 0, F.col("n") / F.col("whole")).otherwise(0.0)
        x = q.groupBy(*part).agg(F.collect_list(F.struct(by.alias("by"), F.col("p").alias("values"))).alias("l"))
        new = theta.join(x, part, "left").withColumn("x", F.zip_with("theta", _summed(F.col("l"), F.size("m")), lambda a, b: a * b)).drop("l")
        new = new.withColumn("total", F.sum(_total(F.col("x"), m)).over(cell))
        new = new.withColumn("new", F.when(F.col("going") & (F.col("total") > 0), F.transform("x", lambda v: v / F.col("total"))).otherwise(F.col("theta")))
        moved = F.max(F.array_max(F.zip_with("new", "theta", lambda a, b: F.abs(a - b)))).over(cell)
        going = F.col("going") & (F.coalesce("total", F.lit(0.0)) > 0) & (moved >= s.tolerance)
        new = materialize(new.withColumn("on", going).select(*part, "m", F.col("new").alias("theta"), F.col("on").alias("going")), "theta")
        discard(theta)
        theta = new
        if theta.where("going").isEmpty():
            break
    size = cells.groupBy(*_CELL).agg(F.sum("n").alias("n"))
    each = theta.join(names, ["community", "block"]).join(size, _CELL)
    return each.select(*_CELL, "n", F.inline(F.arrays_zip("isoform", "theta"))).select(*_CELL, "isoform", "theta", "n")


def _unit_large(mol: DataFrame, s: EmSettings) -> DataFrame:
    """The same iteration as joins: a molecule's rows meet by a window, sums by isoform are combined before the shuffle. A cell that has settled stands still. A row may stand for n molecules of one kind, and m isoforms, alike."""
    mol = materialize(mol.withColumns({"n": number(mol), "m": copies(mol)}), "cells")
    cell, of = Window.partitionBy(*_CELL), Window.partitionBy(*_CELL, "umi")
    m = F.col("m")
    hits = F.sum((F.col("p") > 0).cast("int") * m).over(of)
    start = mol.withColumn("alone", ((F.col("p") > 0) & (hits == 1)).cast("double") * F.col("n")).groupBy(*_CELL, "isoform").agg(F.sum("alone").alias("x"), F.max("m").alias("m"))
    total = F.sum(m * F.col("x")).over(cell)
    start = start.withColumn("theta", F.when(total > 0, F.col("x") / total).otherwise(1 / F.sum("m").over(cell)))
    theta = materialize(start.select(*_CELL, "isoform", "m", "theta", F.lit(True).alias("going")), "theta")
    for _ in range(s.iterations):
        q = mol.join(theta.drop("m"), [*_CELL, "isoform"]).where("going").withColumn("q", F.col("p") * F.col("theta"))
        whole = F.sum(m * F.col("q")).over(of)
        x = q.withColumn("x", F.when(whole > 0, F.col("n") * F.col("q") / whole).otherwise(0.0)).groupBy(*_CELL, "isoform").agg(F.sum("x").alias("x"))
        n = theta.join(x, [*_CELL, "isoform"], "left").withColumn("total", F.sum(m * F.col("x")).over(cell))
        n = n.withColumn("new", F.when(F.col("going") & (F.col("total") > 0), F.col("x") / F.col("total")).otherwise(F.col("theta")))
        moved = F.max(F.abs(F.col("new") - F.col("theta"))).over(cell)
        going = F.col("going") & (F.coalesce("total", F.lit(0.0)) > 0) & (moved >= s.tolerance)
        new = materialize(n.withColumn("on", going).select(*_CELL, "isoform", "m", F.col("new").alias("theta"), F.col("on").alias("going")), "theta")
        discard(theta)
        theta = new
        if theta.where("going").isEmpty():
            break
    size = mol.select(*_CELL, "umi", "n").distinct().groupBy(*_CELL).agg(F.sum("n").alias("n"))
    return theta.drop("going", "m").join(size, _CELL)
