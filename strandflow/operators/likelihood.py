"""Read lengths and the probability of a read given an isoform.

Tables of reads and isoforms may have a row for n reads of one class (operators/classes.py), with their number as n, and for m isoforms alike; tables of isoforms then have m, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.classes import copies, number
from strandflow.operators.store import materialize


def with_read_length(read_isoform: DataFrame) -> DataFrame:
    """The longest length of a read over its isoforms, as iso_len less offsets."""
    n = F.col("iso_len") - F.col("off5") - F.col("off3")
    return read_isoform.withColumn("read_len", F.max(n).over(Window.partitionBy("read")))


def length_histogram(read_isoform: DataFrame) -> DataFrame:
    """read_len and cnt, each read once."""
    per_read = read_isoform.groupBy("read").agg(F.max("read_len").alias("read_len"), F.max(number(read_isoform)).alias("n"))
    return per_read.groupBy("read_len").agg(F.sum("n").alias("cnt"))


def cumulative(histogram: DataFrame) -> DataFrame:
    """read_len, cnt, pdf and cdf. The window sees one row for each distinct length, however many reads there are."""
    whole = Window.orderBy("read_len").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy("read_len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("cnt").over(whole)
    return histogram.select("read_len", "cnt", (F.col("cnt") / total).alias("pdf"), (F.sum("cnt").over(so_far) / total).alias("cdf"))


def cdf_at(lengths: DataFrame, cdf: DataFrame) -> DataFrame:
    """iso_len and cdf: the share of reads of 1 to iso_len bases, for each distinct iso_len."""
    points = lengths.select(F.col("iso_len").alias("at"), F.lit(True).alias("asked"), F.lit(None).cast("double").alias("cdf")).distinct()
    both = points.unionByName(cdf.where("read_len >= 1").select(F.col("read_len").alias("at"), F.lit(False).alias("asked"), "cdf"))
    so_far = Window.orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("cdf", F.coalesce(F.last("cdf", ignorenulls=True).over(so_far), F.lit(0.0))).where("asked").select(F.col("at").alias("iso_len"), "cdf")


def initial_theta(read_isoform: DataFrame, rule: str = "LR") -> DataFrame:
    """isoform and theta0: reads that fit it alone count 1; those that fit n count 1/n each, or nothing under LR_unique."""
    fits = F.sum(copies(read_isoform)).over(Window.partitionBy("read"))
    r = read_isoform.select("isoform", number(read_isoform).alias("n"), fits.alias("fits"))
    share = F.when(F.col("fits") == 1, 1.0).otherwise(F.lit(0.0) if rule == "LR_unique" else 1.0 / F.col("fits"))
    return r.groupBy("isoform").agg(F.sum(F.col("n") * share).alias("theta0"))


def with_length(isoforms: DataFrame) -> DataFrame:
    """isoform, iso_len and m."""
    return isoforms.select("isoform", "iso_len", copies(isoforms).alias("m"))


def length_support(isoforms: DataFrame, theta0: DataFrame, cdf: DataFrame, lengths: DataFrame) -> DataFrame:
    """read_len and sm: sum of theta0 / cdf(iso_len) over isoforms at least that long, for each length of lengths."""
    theta = with_length(isoforms).join(theta0.select("isoform", F.col("theta0").alias("theta")), "isoform")
    return tail_support(theta, lengths, cdf_at(isoforms, cdf))


def tail_support(theta: DataFrame, lengths: DataFrame, at: DataFrame | None) -> DataFrame:
    """read_len and sm: sum of theta (isoform, iso_len, m, theta) over isoforms at least that long, each over the cdf of its length where at (iso_len, cdf) is given.

    The window sees one row for each distinct length of isoforms and reads, however many there are.
    """
    if at is None:
        w = theta.groupBy("iso_len").agg(F.sum(F.col("theta") * copies(theta)).alias("w"))
    else:
        w = theta.join(at, "iso_len").groupBy("iso_len").agg(F.sum(copies(theta) * F.when(F.col("cdf") > 0, F.col("theta") / F.col("cdf")).otherwise(0.0)).alias("w"))
    both = w.select(F.col("iso_len").alias("at"), "w", F.lit(False).alias("asked")).unionByName(
        lengths.select(F.col("read_len").alias("at"), F.lit(0.0).alias("w"), F.lit(True).alias("asked")).distinct()
    )
    longest_first = Window.orderBy(F.col("at").desc(), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("sm", F.sum("w").over(longest_first)).where("asked").select(F.col("at").alias("read_len"), "sm")


def probability(form: str, pdf: Column, cdf: Column, sm: Column, iso_len: Column, read_len: Column) -> Column:
    """p of a read given an isoform. form_2: pdf / cdf (pdf where there is no cdf or support); form_1: also over sm; no_read_length: 1;
    no_isoform_specific: pdf. All are spread over the start places; what is infinite, negative or below 1e-100 is 0."""
    none = (cdf == 0) | (sm == 0)
    base = {"form_2": F.when(none, pdf).otherwise(pdf / cdf), "form_1": F.when(none, pdf).otherwise(pdf / cdf / sm), "no_read_length": F.lit(1.0), "no_isoform_specific": pdf}[form]
    places = iso_len - read_len + 1
    p = F.when(places == 0, 0.0).otherwise(F.try_divide(base, places))
    return F.when((p <= 1e-100) | p.isNull() | F.isnan(p) | (p == float("inf")), 0.0).otherwise(p)


def conditional_probabilities(read_isoform: DataFrame, isoforms: DataFrame, form: str = "form_2", theta_rule: str = "LR") -> DataFrame:
    """read_isoform with p. isoforms: isoform, iso_len. Length tables have a row for each distinct length; they are written first, so that their joins need not shuffle the reads."""
    r = read_isoform if "read_len" in read_isoform.columns else with_read_length(read_isoform)
    cdf = materialize(cumulative(length_histogram(r)), "lengths")
    at = materialize(cdf_at(isoforms, cdf), "cdf")
    sm = materialize(length_support(isoforms, initial_theta(read_isoform, theta_rule), cdf, cdf), "support") if form == "form_1" else None
    r = r.join(cdf.select("read_len", "pdf"), "read_len").join(at, "iso_len")
    if sm is not None:
        r = r.join(sm, "read_len")
    else:
        r = r.withColumn("sm", F.lit(1.0))
    p = probability(form, F.col("pdf"), F.col("cdf"), F.col("sm"), F.col("iso_len"), F.col("read_len"))
    return r.withColumn("p", p).drop("pdf", "cdf", "sm")
