"""Interval joins and unions without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.store import materialize


def _binned(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    # An interval of very many bins would be a very long array; it is exploded row by row and only as wide as it is.
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, width: int, extra: Column | None = None) -> DataFrame:
    """Pairs of equal keys with right.start < left.end and right.end > left.start (half-open test on inclusive coordinates).

    Both sides fall into bins of ``width``; the join is an equi-join on keys and bin, which spreads a hot key over its bins. A pair is
    kept only in the first bin that both have, so no distinct is needed. Column names of the sides must differ but for the keys.
    """
    a, b = _binned(left, ls, le, width, "__bin"), _binned(right, rs, re, width, "__bin")
    pairs = a.join(b, [*keys, "__bin"])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("__bin")
    test = (F.col(rs) < F.col(le)) & (F.col(re) > F.col(ls)) & first
    return pairs.where(test if extra is None else test & extra).drop("__bin")


def containment_join(points: DataFrame, ranges: DataFrame, keys: list[str], ps: str, pe: str, rs: str, re: str, tolerance: Column, width: int) -> DataFrame:
    """Pairs with range.start <= point.start + tolerance and range.end >= point.end - tolerance, of equal keys.

    Only the bin of the point's start, moved by its tolerance, is looked up: a range that passes the first test and reaches that far covers it.
    Where the tolerance turns the point inside out, ranges are looked up at both ends.
    """
    p = points.withColumn("__tol", tolerance).withColumn("__lo", F.col(ps) + F.col("__tol")).withColumn("__hi", F.col(pe) - F.col("__tol"))
    # The range must meet [min(lo, hi), max(lo, hi)]; it does so in the bin of hi if lo <= hi, else somewhere between.
    p = p.withColumn("__bin", F.explode(F.sequence(F.floor(F.least("__lo", "__hi") / width), F.floor(F.greatest("__lo", "__hi") / width))))
    r = _binned(ranges, rs, re, width, "__bin")
    at = F.floor(F.greatest(F.least("__lo", "__hi"), F.col(rs)) / width) == F.col("__bin")
    pairs = p.join(r, [*keys, "__bin"]).where((F.col(rs) <= F.col("__lo")) & (F.col(re) >= F.col("__hi")) & at)
    return pairs.drop("__bin", "__tol", "__lo", "__hi")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, touching: bool, spread: bool = False) -> DataFrame:
    """Unions of overlapping intervals: keys, start, end. touching: intervals that only share an endpoint are merged, too.

    A key's intervals are ordered in one task. spread: for few keys of very many intervals, they are ordered over ranges of all tasks instead.
    """
    if spread:
        return _merge_spread(df, keys, start, end, touching)
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    apart = F.col(start) > reach if touching else F.col(start) >= reach
    flagged = df.withColumn("__new", F.coalesce(apart.cast("int"), F.lit(1)))
    so_far = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = flagged.withColumn("__island", F.sum("__new").over(so_far))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def _merge_spread(df: DataFrame, keys: list[str], start: str, end: str, touching: bool) -> DataFrame:
    """Ranges of the global order look back over their own rows; of each range and key, one row tells how far its intervals reach and where its last union begins."""
    order = [*keys, start, end]
    d = materialize(df.select(*order).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "intervals")
    within = Window.partitionBy(*keys, "__part").orderBy(start, end)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    reach = d.groupBy(*keys, "__part").agg(F.max(end).alias("__far")).select(*keys, "__part", F.max("__far").over(ranges).alias("__carried"))
    d = d.join(reach, [*keys, "__part"]).withColumn("__reach", F.greatest(F.max(end).over(before), "__carried"))
    new = F.col("__reach").isNull() | (F.col(start) > F.col("__reach") if touching else F.col(start) >= F.col("__reach"))
    # A union goes by its first start; unions that begin at the same place, one base long but for the last, by their ends as well.
    d = d.withColumn("__first", F.last(F.when(new, F.struct(start, end)), True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opened = d.groupBy(*keys, "__part").agg(F.max("__first").alias("__open")).select(*keys, "__part", F.max("__open").over(ranges).alias("__before"))
    d = d.join(opened, [*keys, "__part"]).withColumn("__union", F.coalesce("__first", "__before"))
    return d.groupBy(*keys, "__union").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__union")


def union_length(df: DataFrame, keys: list[str], start: str, end: str, touching: bool = False, spread: bool = False) -> DataFrame:
    """Inclusive length of the union by keys: keys, union_len. Unmerged endpoints that touch count their shared base twice."""
    merged = merge_intervals(df, keys, start, end, touching, spread)
    return merged.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).alias("union_len"))
