"""Estimators that iterate over all isoforms at once: long reads, short reads, or both, from several starts, with likelihoods that may change each round.

Reads of the same isoforms and values are one row with their number; isoforms that cannot be told apart may be one row with their number m (operators/classes.py), whose theta is that of each. These rows are dealt into shards once, and written in buckets by shard, so that no round moves them:
a round sends each shard the numbers of the isoforms that it asks for, and the shards send back one sum an isoform. What changes in the likelihood
from round to round depends on a read's length only; it travels as a further number for each length.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.config import GlobalSettings
from strandflow.operators.classes import copies, number, sharded
from strandflow.operators.likelihood import cdf_at, conditional_probabilities, cumulative, initial_theta, length_histogram, probability, tail_support, with_length, with_read_length
from strandflow.operators.store import discard, materialize, new_dir

_TINY, _MINOR = 1e-100, 1e-7


def _normal(theta: DataFrame) -> DataFrame:
    """theta0 as shares of one; all 0 stay 0. The totals are one row."""
    total = theta.agg(F.sum(F.col("theta0") * copies(theta))).first()[0] or 1.0
    return theta.withColumn("theta0", F.col("theta0") / F.lit(float(total)))


def _random(isoforms: DataFrame, seed: int) -> DataFrame:
    """A point of a uniform Dirichlet distribution: exponential numbers, normalised. They come from each isoform's name and the seed, so that any partitions give the same ones."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("isoform").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("double")
    return _normal(isoforms.select("isoform", (-F.log((bits + 1) / F.lit(float(1 << 48) + 1))).alias("theta0")))


def start_theta(isoforms: DataFrame, long: DataFrame | None, short: DataFrame | None, s: GlobalSettings = GlobalSettings()) -> DataFrame:
    """isoform, theta0 of every isoform (isoform, eff_len), by s.start. long: counts of reads (isoform, theta0), short: of fragments over effective lengths (isoform, theta0).

    Pseudo-counts go to the isoforms whose start is below s.least_start (as a count where there are long reads only, else as a share), or to all. With no least start none is below it.
    """
    known = ["m"] if "m" in isoforms.columns else []
    names = isoforms.select("isoform", "eff_len", *known)
    most = names.agg(F.max("eff_len")).first()[0] or 1.0
    pseudo_short = s.pseudo_short if s.pseudo_short is not None else 1 / most

    def counts(found: DataFrame | None) -> DataFrame:
        return names.select("isoform", *known, F.lit(0.0).alias("theta0")) if found is None else names.select("isoform", *known).join(found, "isoform", "left").fillna(0.0, ["theta0"])

    def lifted(c: DataFrame, pseudo: float, share: bool) -> DataFrame:
        total = float(c.agg(F.sum(F.col("theta0") * copies(c))).first()[0] or 1.0)
        low = F.lit(True) if s.pseudo_counts == "all" else F.col("theta0") / F.lit(total if share else 1.0) < s.least_start
        return _normal(c.withColumn("theta0", F.col("theta0") + F.when(low, pseudo).otherwise(0.0))).select("isoform", "theta0")

    kind = s.start.removesuffix("_unique")
    if kind == "uniform":
        return _normal(names.select("isoform", *known, F.lit(1.0).alias("theta0"))).select("isoform", "theta0")
    if kind == "LR":
        return lifted(counts(long), s.pseudo_long, short is not None)
    if kind == "SR":
        return lifted(counts(short), pseudo_short, True)
    if kind == "random":
        if known and names.where("m > 1").limit(1).count():
            raise ValueError("a random start tells all isoforms apart")
        reads = float(counts(long).agg(F.sum("theta0")).first()[0] or 0.0)
        r = _random(names, s.seed)
        if s.pseudo_counts == "all":
            return _normal(r.withColumn("theta0", F.col("theta0") * reads + s.least_start))
        return _normal(r.withColumn("theta0", F.when(F.col("theta0") < s.least_start, F.col("theta0") * reads + s.pseudo_long).otherwise(F.col("theta0") * reads))) if reads else r
    if kind != "hybrid":
        raise ValueError(f"no start {s.start}")
    a, b = counts(long), counts(short)
    both = _normal(a).select("isoform", F.col("theta0").alias("l")).join(_normal(b).select("isoform", F.col("theta0").alias("s")), "isoform")
    low = F.lit(True) if s.pseudo_counts == "all" else (F.col("l") + F.col("s")) / 2 < s.least_start
    low = both.where(low).select("isoform", F.lit(True).alias("low"))

    def raised(c: DataFrame, pseudo: float) -> DataFrame:
        return _normal(c.join(low, "isoform", "left").withColumn("theta0", F.col("theta0") + F.when(F.col("low"), pseudo).otherwise(0.0)).drop("low")).select("isoform", "theta0")

    half = raised(a, s.pseudo_long).withColumnRenamed("theta0", "l").join(raised(b, pseudo_short).withColumnRenamed("theta0", "s"), "isoform")
    return half.select("isoform", ((F.col("l") + F.col("s")) / 2).alias("theta0"))


def _kernel(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """What the reads of one shard give each isoform, by side. given: numbers of the isoforms (kind I) and of the reads' lengths (kind L)."""
    out = []
    iso = given[given["kind"] == "I"].sort_values("key")
    keys, theta, eff, m = iso["key"].to_numpy(), iso["value"].to_numpy(float), iso["eff_len"].to_numpy(float), iso["m"].to_numpy(float)
    at = np.searchsorted(keys, rows["id"].to_numpy())
    lengths = given[given["kind"] == "L"].sort_values("key")
    p = rows["p"].to_numpy(float)
    if len(lengths):
        support = lengths["value"].to_numpy(float)[np.searchsorted(lengths["key"].to_numpy(), rows["read_len"].to_numpy()) % len(lengths)]
        support = np.where(rows["side"] == "L", support, 1)
        none = support == 0
        p = np.where(none, rows["p_alone"].to_numpy(float), p / np.where(none, 1, support))
        p = np.where((p > _TINY) & np.isfinite(p), p, 0)
    row, names = pd.factorize(rows["row"])
    weight = np.zeros(len(names))
    weight[row] = rows["n"].to_numpy(float)
    side = rows["side"].to_numpy()
    q = p * theta[at] * np.where(side == "S", eff[at], 1)
    total = np.bincount(row, q * m[at], len(names))
    likely = weight * np.log(np.where(total > 0, total, 1))
    q = q * (weight / np.where(total > 0, total, 1))[row]
    first = np.unique(row, return_index=True)[1]
    for k in ("L", "S"):
        here = side == k
        if here.any():
            sums = np.bincount(at[here], q[here], len(keys))
            out.append(pd.DataFrame({"id": keys, "side": k, "q": sums, "likely": 0.0}))
            out.append(pd.DataFrame({"id": [None], "side": [k], "q": [0.0], "likely": [likely[side[first] == k].sum()]}))
    return pd.concat(out, ignore_index=True).astype({"id": "Int64"})


@dataclass
class Outcome:
    """expression: isoform, eff_len, theta, tpm. rounds: of each round the log-likelihoods of long and short reads before it, up to constants, and whether any isoform still moved."""

    expression: DataFrame
    rounds: list[dict]


def _rows(side: str, reads: DataFrame, refreshed: bool) -> DataFrame:
    """Reads (read, isoform, p; with a refreshed likelihood also p_alone and read_len) of the same values as one row with their number n, which they may have already. home: a number of the first isoform; rows that share their isoforms share it."""
    hit = F.struct("isoform", F.coalesce("p", F.lit(0.0)).alias("p"), *([F.coalesce("p_alone", F.lit(0.0)).alias("p_alone")] if refreshed else []))
    keys = ["read", "read_len"] if refreshed else ["read"]
    per_read = reads.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.max(number(reads)).alias("n"))
    same = per_read.groupBy(*keys[1:], "hits").agg(F.sum("n").alias("n"))
    h = same.select(F.lit(side).alias("side"), F.xxhash64(F.lit(side), *keys[1:], "hits").alias("row"), F.xxhash64(F.col("hits")[0]["isoform"]).alias("home"), *keys[1:], "n", F.explode("hits").alias("h"))
    more = [F.col("h.p_alone").alias("p_alone"), F.col("read_len").cast("long").alias("read_len")] if refreshed else [F.lit(0.0).alias("p_alone"), F.lit(0).cast("long").alias("read_len")]
    return h.select("side", "row", "home", "n", "h.isoform", "h.p", *more)


def global_em(isoforms: DataFrame, theta: DataFrame, long: DataFrame | None = None, short: DataFrame | None = None, alpha: float = 1.0, support=None, s: GlobalSettings = GlobalSettings()) -> Outcome:
    """Iterate from theta (isoform, theta0) over long (read, isoform, p) and short (read, isoform, p) together, long reads weighing alpha and short ones the rest.

    isoforms: isoform, eff_len, and m where rows stand for isoforms alike. support: a function of the thetas (isoform, theta) that gives read_len and sm, by which long reads' p is divided in each round; long then also has
    read_len and p_alone, the p of reads without support. Ends when no isoform of more than a ten-millionth moves by s.tolerance of itself, or after s.iterations. Isoforms that no
    read fits end with 0. No reads: all 0.
    """
    spark = isoforms.sparkSession
    names = materialize(isoforms.select("isoform", "eff_len", copies(isoforms).alias("m")).join(theta, "isoform", "left").select("isoform", "m", F.coalesce("eff_len", F.lit(1.0)).alias("eff_len"), F.coalesce("theta0", F.lit(0.0)).alias("theta")).withColumn("id", F.monotonically_increasing_id()), "isoforms")
    parts = [_rows(side, reads, support is not None and side == "L") for side, reads in (("L", long), ("S", short)) if reads is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = materialize(rows.join(names.select("isoform", "id"), "isoform").drop("isoform"), "rows")
    dealt, shards = sharded(rows, int(spark.conf.get("spark.sql.shuffle.partitions")), s.rows_in_shard)
    table = f"shards_{uuid.uuid4().hex}"
    dealt.repartition(shards, "shard").write.bucketBy(shards, "shard").option("path", new_dir(spark, "shards")).saveAsTable(table)
    dealt = spark.table(table)
    asked = dealt.select("shard", F.lit("I").alias("kind"), F.col("id").alias("key")).distinct()
    if support is not None:
        asked = asked.unionByName(dealt.where("side = 'L'").select("shard", F.lit("L").alias("kind"), F.col("read_len").alias("key")).distinct())
    asked = materialize(asked, "asked")
    now, rounds = names, []
    for _ in range(s.iterations):
        given = asked.where("kind = 'I'").join(now.select(F.col("id").alias("key"), F.col("theta").alias("value"), "eff_len", "m"), "key")
        if support is not None:
            sm = support(now.select("isoform", "theta"))
            lengths = asked.where("kind = 'L'").join(sm.select(F.col("read_len").cast("long").alias("key"), F.col("sm").alias("value"), F.lit(1.0).alias("eff_len"), F.lit(1).cast("long").alias("m")), "key", "left").fillna(0.0, ["value"]).fillna(1.0, ["eff_len", "m"])
            given = given.unionByName(lengths)
        given = given.select("shard", "kind", "key", "value", "eff_len", "m")
        sums = dealt.groupBy("shard").cogroup(given.groupBy("shard")).applyInPandas(_kernel, "id long, side string, q double, likely double")
        sums = materialize(sums.groupBy("id").agg(F.sum(F.when(F.col("side") == "L", F.col("q"))).alias("l"), F.sum(F.when(F.col("side") == "S", F.col("q"))).alias("s"), *[F.sum(F.when(F.col("side") == k, F.col("likely"))).alias(f"likely_{k}") for k in "LS"]), "sums")
        counted = sums.join(names.select("id", "m"), "id", "left")  # likelihoods are in rows without an isoform
        t = counted.agg(*[F.coalesce(F.sum(F.col(c) * F.coalesce("m", F.lit(1))), F.lit(0.0)) for c in ("l", "s", "likely_L", "likely_S")]).first()
        mass = now.agg(F.sum(F.col("theta") * F.col("eff_len") * F.col("m"))).first()[0] or 1.0
        below = F.lit((1 - alpha) * t[1] / mass) * F.col("eff_len") + F.lit(alpha * t[0])
        x = F.when(below > 0, (F.lit(1 - alpha) * F.coalesce("s", F.lit(0.0)) + F.lit(float(alpha)) * F.coalesce("l", F.lit(0.0))) / below).otherwise(0.0)
        new = now.select("isoform", "m", "eff_len", "id", F.col("theta").alias("old")).join(sums.where("id IS NOT NULL").select("id", "l", "s"), "id", "left").withColumn("x", x).drop("l", "s")
        new = materialize(new, "thetas")
        total = float(new.agg(F.sum(F.col("x") * F.col("m"))).first()[0] or 0.0) or 1.0
        value = F.col("x") / F.lit(total)
        before, now = now, new.withColumn("theta", F.when(value < _TINY, 0.0).otherwise(value))
        moving = not now.where((F.col("theta") > _MINOR) & (F.abs(F.col("theta") - F.col("old")) > s.tolerance * F.col("theta"))).isEmpty()
        discard(sums)
        if before is not names:
            discard(previous)
        previous = new
        rounds.append({"long": float(t[2]), "short": float(t[3]), "moving": moving})
        if not moving:
            break
    out = now.select("isoform", "eff_len", "theta", (F.col("theta") * 1e6).alias("tpm"))
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return Outcome(out, rounds)


def long_read_em(read_isoform: DataFrame, isoforms: DataFrame, s: GlobalSettings = GlobalSettings(), form: str = "form_2") -> Outcome:
    """Long reads alone. read_isoform: read, isoform, iso_len and read_len (or offsets); isoforms: isoform, iso_len, which stands for the effective length."""
    names = isoforms.select("isoform", F.col("iso_len").cast("double").alias("eff_len"), copies(isoforms).alias("m"))
    rule = "LR_unique" if s.start.endswith("_unique") else "LR"
    counts = initial_theta(read_isoform, rule)
    p = conditional_probabilities(read_isoform, isoforms, form, rule).select("read", "isoform", "p", number(read_isoform).alias("n"))
    return global_em(names, start_theta(names, counts, None, s), p, s=s)


def refreshed_probabilities(read_isoform: DataFrame, isoforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read, isoform, read_len, p and p_alone of reads with and without support, and the cumulative table of lengths."""
    r = read_isoform if "read_len" in read_isoform.columns else with_read_length(read_isoform)
    cdf = materialize(cumulative(length_histogram(r)), "lengths")
    r = r.join(cdf.select("read_len", "pdf"), "read_len").join(materialize(cdf_at(isoforms, cdf), "cdf"), "iso_len")
    one = F.lit(1.0)

    def p(form: str) -> Column:
        return probability(form, F.col("pdf"), F.col("cdf"), one, F.col("iso_len"), F.col("read_len"))

    return r.select("read", "isoform", "read_len", number(read_isoform).alias("n"), p("form_2").alias("p"), p("no_isoform_specific").alias("p_alone")), cdf


def iterative_em(read_isoform: DataFrame, isoforms: DataFrame, s: GlobalSettings = GlobalSettings(), plain: bool = False) -> Outcome:
    """The likelihood is computed anew in each round: what a read's length has of support among the isoforms that are long enough, by the thetas of that round.

    plain: the support is the sum of thetas alone, and a read's p has no share of an isoform's length. Otherwise each theta counts over the share of reads that its isoform is long enough for.
    """
    p, cdf = refreshed_probabilities(read_isoform, isoforms)
    if plain:
        p = p.withColumn("p", F.col("p_alone")).withColumn("p_alone", F.lit(0.0))
    lengths = materialize(cdf.select("read_len"), "lengths")
    at = materialize(cdf_at(isoforms, cdf), "cdf")
    known = with_length(isoforms)

    def support(theta: DataFrame) -> DataFrame:
        return tail_support(known.join(theta, "isoform"), lengths, None if plain else at)

    names = isoforms.select("isoform", F.col("iso_len").cast("double").alias("eff_len"), copies(isoforms).alias("m"))
    start = start_theta(names, initial_theta(read_isoform, "LR_unique" if s.start.endswith("_unique") else "LR"), None, s)
    return global_em(names, start, p, support=support, s=s)


def support_by_length(read_isoform: DataFrame, isoforms: DataFrame, theta: DataFrame, plain: bool = False) -> DataFrame:
    """read_len and sm: the support of each read length under theta (isoform, theta)."""
    _, cdf = refreshed_probabilities(read_isoform, isoforms)
    return tail_support(with_length(isoforms).join(theta, "isoform"), cdf.select("read_len"), None if plain else cdf_at(isoforms, cdf))


def plain_probabilities(read_isoform: DataFrame, isoforms: DataFrame, theta: DataFrame) -> DataFrame:
    """read, isoform, p: the share of reads of the read's length, over the thetas of the isoforms that are long enough, over the start places. What is infinite, negative or below 1e-100 is 0."""
    p, cdf = refreshed_probabilities(read_isoform, isoforms)
    sm = materialize(tail_support(with_length(isoforms).join(theta, "isoform"), cdf.select("read_len"), None), "support")
    value = F.try_divide("p_alone", "sm")
    return p.join(sm, "read_len").select("read", "isoform", F.when(value > _TINY, value).otherwise(0.0).alias("p"))
