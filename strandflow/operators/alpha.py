"""How much long reads should weigh in a community: errors of equally spaced weights where the truth is known, and a regression that predicts them from the community's features."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.config import EmSettings
from strandflow.operators.em import hybrid_em
from strandflow.operators.features import model_columns

ALPHAS = tuple(i / 20 for i in range(21))


def alpha_errors(long: DataFrame, short: DataFrame, isoforms: DataFrame, truth: DataFrame, alphas: tuple[float, ...] = ALPHAS, s: EmSettings = EmSettings()) -> DataFrame:
    """community, errors: for each weight the sum of |theta - truth| over the community's isoforms. truth: isoform, theta within its community; isoforms that it lacks are 0.

    long, short and isoforms are those of hybrid_em. All weights iterate in one run, each community once for each weight.
    """
    kind = isoforms.schema["community"].dataType
    each = F.explode(F.array(*[F.lit(i) for i in range(len(alphas))])).alias("__i")

    def copies(df: DataFrame) -> DataFrame:
        name = F.concat_ws("#", F.col("__i"), F.col("community").cast("string"))
        return df.select("*", each).withColumn("community", name).drop("__i")

    names = isoforms.select("community").distinct().select(F.col("community").alias("of"), each)
    weight = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("__i") + 1)
    names = names.select("of", F.col("__i"), F.concat_ws("#", F.col("__i"), F.col("of").cast("string")).alias("community"), weight.alias("alpha"))
    found = hybrid_em(copies(long), copies(short), copies(isoforms), names.select("community", "alpha"), s).select("community", "isoform", "theta")
    known = truth.select("isoform", F.col("theta").alias("true"))
    e = found.join(names, "community").join(known, "isoform", "left").groupBy("of", "__i").agg(F.sum(F.abs(F.col("theta") - F.coalesce("true", F.lit(0.0)))).alias("error"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__i", "error"))), lambda x: x["error"])
    out = e.groupBy(F.col("of").alias("community")).agg(listed.alias("errors"))
    return out.select(F.col("community").cast(kind), "errors")


@dataclass(frozen=True)
class AlphaModel:
    """Linear in the signed logarithms of the features, which are centred and scaled; features that are missing take their mean."""

    columns: list[str]
    means: list[float]
    scales: list[float]
    weights: list[list[float]]  # a row a feature and one for the constant, a column an error

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = np.sign(x) * np.log1p(np.abs(x))
        x = np.where(np.isfinite(x), x, self.means)
        return np.column_stack([(x - self.means) / self.scales, np.ones(len(x))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.prepared(x) @ np.array(self.weights), 0)


def _matrix(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)


def fit_alpha(table: DataFrame, ridge: float = 1.0) -> AlphaModel:
    """table: features by community, some null, and errors. Least squares with a penalty: tasks send sums of products, whose number is that of the features squared, however many communities there are. No rows: weights 0."""
    columns = model_columns(table.columns)
    n_errors = table.agg(F.max(F.size("errors"))).first()[0] or 0
    logs = [F.signum(F.col(f"`{c}`").cast("double")) * F.log1p(F.abs(F.col(f"`{c}`").cast("double"))) for c in columns]
    finite = [F.when(~F.isnan(x), x) for x in logs]
    stats = table.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(finite) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = [float(stats[f"m{i}"] or 0.0) for i in range(len(columns))]
    scales = [float(stats[f"s{i}"] or 0.0) or 1.0 for i in range(len(columns))]
    model = AlphaModel(columns, means, scales, [])
    d = len(columns) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + n_errors))
        for b in batches:
            if b.num_rows:
                x, y = model.prepared(_matrix(b, columns)), np.array(b.column("errors").to_pylist(), float)
                total += x.T @ np.column_stack([x, y])
        yield pa.record_batch([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], names=["at", "value"])

    sums = table.select("errors", *[f"`{c}`" for c in columns]).mapInArrow(products, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    both = np.zeros(d * (d + n_errors))
    for r in sums:
        both[r["at"]] = r["value"]
    both = both.reshape(d, d + n_errors)
    penalty = ridge * np.eye(d)
    penalty[-1, -1] = 1e-9  # the constant is free
    return AlphaModel(columns, means, scales, np.linalg.solve(both[:, :d] + penalty, both[:, d:]).tolist())


def write_model(spark: SparkSession, model: AlphaModel, path: str) -> None:
    """One row of JSON, in whatever store Spark writes to."""
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> AlphaModel:
    return AlphaModel(**json.loads(spark.read.text(path, wholetext=True).first()[0]))
