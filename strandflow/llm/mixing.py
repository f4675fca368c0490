"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time. Its integral is the
source's weight; the inverse of its cumulative demand assigns every taken
document a training position. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: (weight at the start, weight at the end) of training, dealt to sources in code-point order and repeated.
SCHEDULES = ((7.5, 2.5), (2.0, 2.0), (0.5, 1.5))
#: Prefix sums of a source are cut at so many ranges of its hash order, so that no task orders a whole source.
RANGES_LOG2 = 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A target for each row of sources (source, source_size).

    The schedules' integrals share ``share`` times all words; no target is above ``most`` times its
    source, and what is above is shared again by weight. That has a closed form: in ascending order of
    cap by weight, the first k sources are at their caps and the others get the same level times their weight.
    There is one row a source, so the unpartitioned windows see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    lows = F.array(*[F.lit(float(a)) for a, _ in schedules])
    highs = F.array(*[F.lit(float(b)) for _, b in schedules])
    at = ((F.row_number().over(by_name) - 1) % len(schedules)).cast("int") + 1
    s = (
        sources.withColumn("at", at)
        .withColumn("low", F.element_at(lows, F.col("at")))
        .withColumn("high", F.element_at(highs, F.col("at")))
        .withColumn("weight", (F.col("low") + F.col("high")) / 2)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    s = s.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(whole))
    return s.select(
        "source",
        "source_size",
        "low",
        "high",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _set_aside(docs: DataFrame, *own: str) -> tuple[dict[str, str], DataFrame]:
    """docs with new names for all columns but its own ones, so that none clashes with a name used here; and the new name of each."""
    names = {c: f"aside{i}" for i, c in enumerate(docs.columns) if c not in own}
    return names, docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns])


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, seed: int = 17, ordered: bool = True) -> DataFrame:
    """Add size, source_size, target, taken and positions to docs, range-sorted by first position (unless not ordered).

    A source is passed in the order of a seeded hash, as often as its target asks; the last pass ends
    within one document, of which the first words are taken. ``positions`` holds one value in [0, 1) for each
    (whole or partial) pass over a document, ``position`` the first of them; null where nothing is taken.

    Null or empty texts have size 0 and are taken 0 words. A null source is a source of its own, last in
    order. Rows that repeat are rows of their own; if they are equal in every column, which of them is cut
    does not show. An empty table gives an empty result. Columns of docs that clash with the added ones are replaced; others stay, whatever their names.
    """
    added = ["size", "source_size", "target", "taken", "positions", "position"]
    kept = docs.drop(*added)
    names, d = _set_aside(kept, "doc_id", "text", "source")
    keep = [F.col(names.get(c, c)).alias(c) for c in kept.columns]
    d = d.withColumn("size", word_count(F.col("text"))).withColumn(
        "__h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))
    )
    d = d.withColumn("__range", F.shiftrightunsigned(F.col("__h"), 64 - RANGES_LOG2).cast("int"))
    # The source in two columns without nulls: the join and the window below then share one exchange of the documents.
    d = d.withColumn("__source", F.coalesce("source", F.lit(""))).withColumn("__none", F.col("source").isNull())
    key = ["__source", "__none", "__range"]

    ranges = d.groupBy("source", "__range").agg(F.sum("size").alias("range_size"))
    total = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), schedules, share, most)
    so_far = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(so_far), F.lit(0))).alias("r")
    total = total.alias("t")
    ranges = ranges.join(total, F.expr("r.source <=> t.source")).select(
        F.coalesce("r.source", F.lit("")).alias("__source"),
        F.col("r.source").isNull().alias("__none"),
        "__range",
        "range_start",
        "source_size",
        "low",
        "high",
        "target",
        F.round("target").cast("long").alias("budget"),
    )
    # All hashes of a range have the same leading bits, so their signed order is that of the remaining ones.
    within = (
        Window.partitionBy(*key)
        .orderBy("__h", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    d = d.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ranges, key)
    start = F.col("range_start") + F.col("__before")
    d = (
        d.withColumn("__start", start)
        .withColumn("__full", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("__rest", F.col("budget") - F.col("__full") * F.col("source_size"))
        .withColumn("__part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("__rest") - F.col("__start"))))
        .withColumn("taken", F.col("size") * F.col("__full") + F.col("__part"))
        .withColumn("__passes", F.when(F.col("size") > 0, F.col("__full") + (F.col("__part") > 0).cast("long")).otherwise(F.lit(0)))
    )
    # A schedule from low to high, scaled to mean 1, has the cumulative demand u(t) = a t + (b - a) t^2 / 2; its inverse gives t.
    mean = (F.col("low") + F.col("high")) / 2
    a, slope = F.col("low") / mean, (F.col("high") - F.col("low")) / mean

    def when_due(p: Column) -> Column:
        u = (p * F.col("source_size") + F.col("__start")) / F.col("budget")
        return F.when(slope == 0, u).otherwise((F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * u)) - a) / slope)

    d = d.withColumn(
        "positions",
        F.when(F.col("__passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__passes") - 1, F.lit(0))), when_due)),
    ).withColumn("position", F.element_at("positions", 1))
    # Documents that are not taken have no position; the hash spreads them over the sort's ranges.
    return (d.orderBy("position", "__h") if ordered else d).select(*keep, *added)


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: docs' rows as often as they are taken, in the order of their training positions.

    Of a document that the mix ends in, the first words are given, joined by one space; n_chars, if there is such a column, follows. Documents of which nothing
    is taken are not in the mix.
    """
    names, d = _set_aside(docs, "doc_id", "text", "source", "n_chars")
    keep = d.columns
    m = mix(d, ordered=False, **parameters).where("taken > 0").select(*keep, "size", "taken", F.posexplode("positions").alias("__pass", "__position"))
    left = F.least(F.col("size"), F.col("taken") - F.col("__pass") * F.col("size"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    m = m.withColumn("__cut", left < F.col("size")).withColumn("text", F.when(F.col("__cut"), F.array_join(F.slice(words, 1, left.cast("int")), " ")).otherwise(F.col("text")))
    if "n_chars" in keep:
        kind = dict(d.dtypes)["n_chars"]
        m = m.withColumn("n_chars", F.when(F.col("__cut"), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return m.orderBy("__position").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def op10_mixing_weights(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position", "positions")
