"""The weight of long reads: errors against single runs, and a fitted predictor against the best constant."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.config import EmSettings
from strandflow.operators import alpha
from strandflow.operators.em import hybrid_em
from strandflow.operators.features import predict_alpha


def communities(rng, n: int) -> tuple[list, list, list, list]:
    """Communities of which one kind of reads does not follow the truth: long ones in those of odd numbers, which are also cut off."""
    long, short, iso, truth = [], [], [], []
    for c in range(n):
        theta = rng.dirichlet(np.ones(3))
        for k in range(3):
            iso.append((f"c{c}", f"c{c}i{k}", 100.0))
            truth.append((f"c{c}i{k}", float(theta[k])))
        for side, m in (("L", 60), ("S", 60)):
            false = (side == "L") == bool(c % 2)
            for r, k in enumerate(rng.choice(3, m, p=rng.dirichlet(np.ones(3)) if false else theta)):
                rows = [(f"c{c}", f"{side}{c}.{r}", f"c{c}i{i}", 1.0 if i == k else 0.15) for i in range(3)]
                (long if side == "L" else short).extend(rows)
    return long, short, iso, truth


@pytest.fixture(scope="module")
def runs(spark):
    long, short, iso, truth = communities(np.random.default_rng(8), 80)
    return (
        spark.createDataFrame(long, "community string, read string, isoform string, p double"), spark.createDataFrame(short, "community string, fragment string, isoform string, ant double"),
        spark.createDataFrame(iso, "community string, isoform string, eff_len double"), spark.createDataFrame(truth, "isoform string, theta double"),
    )


S = EmSettings(iterations=15, tolerance=0.0)


def test_errors_are_those_of_single_runs(runs):
    long, short, iso, truth = runs
    got = {r["community"]: r["errors"] for r in alpha.alpha_errors(long, short, iso, truth, (0.0, 0.3, 1.0), S).collect()}
    want = dict(truth.collect())
    for i, a in enumerate((0.0, 0.3, 1.0)):
        for c, rows in hybrid_em(long, short, iso, a, S).toPandas().groupby("community"):
            assert got[c][i] == pytest.approx(sum(abs(t - want[n]) for n, t in zip(rows["isoform"], rows["theta"], strict=True)), abs=1e-9)


def test_predictor_beats_a_constant(runs, spark, tmp_path):
    """Fitted on half of the communities, held against the best single weight on the others; some features are missing."""
    long, short, iso, truth = runs
    errors = alpha.alpha_errors(long, short, iso, truth, tuple(i / 10 for i in range(11)), S)
    reads = [df.groupBy("community").agg(F.countDistinct(n).alias(c)) for df, n, c in ((long, "read", "n_unique_mapping_LRs"), (short, "fragment", "n_unique_mapping_SRs"))]
    number = F.substring("community", 2, 9).cast("int")
    f = reads[0].join(reads[1], "community").withColumn("mean_gene_length", F.when(number % 3 == 0, None).otherwise((number % 5) * 7.0)).withColumn("max_exon_lengths", F.lit(5.0))
    f = f.withColumn("mean_5_end_truncation", F.when(number % 10 == 9, None).otherwise(0.1 + number % 2 * 0.5 + number % 7 * 0.02))
    table = f.join(errors, "community").cache()
    model = alpha.fit_alpha(table.where(number % 4 < 2))
    alpha.write_model(spark, model, f"file://{tmp_path}/LR1M_SR2M.model")
    again = alpha.read_model(spark, f"file://{tmp_path}/LR1M_SR2M.model")
    assert again == model and set(model.columns) == {"n_unique_mapping_LRs", "n_unique_mapping_SRs", "mean_gene_length", "max_exon_lengths", "mean_5_end_truncation"}
    held = table.where(number % 4 >= 2)
    chosen = {r["community"]: r["alpha"] for r in predict_alpha(held, again).collect()}
    e = {r["community"]: r["errors"] for r in held.collect()}
    got = np.mean([e[c][round(a * 10)] for c, a in chosen.items()])
    constant = min(np.mean([x[i] for x in e.values()]) for i in range(11))
    assert len(chosen) == 40 and got < 0.8 * constant
    with pytest.raises(ValueError, match="too large"):
        predict_alpha(held, Large())


class Large:
    columns = ["n_unique_mapping_LRs"]

    def __init__(self):
        self.x = np.zeros(10 << 20)

    def __call__(self, x):
        return x
