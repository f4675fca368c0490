"""Kernel densities against plain ones, the programme's optimality conditions, and K-values of the regions that reads leave."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandflow.__main__ import main
from strandflow.operators import annotation, kde, programme
from strandflow.operators.kde import REACH, boxed
from strandflow.sources import tables
from tests.test_flow import GTF, READS


def test_density_is_a_plain_one(spark):
    """All pairs of points and samples, without bins or limits, agree to 1e-6 and far better."""
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 60, (400, 2)).tolist() + [[500, 7]]
    points = rng.integers(-5, 70, (150, 2)).tolist() + [[500, 7], [480, 7], [900, 900]]
    df = [spark.createDataFrame([tuple(map(int, x)) for x in t], "a long, b long") for t in (samples, points)]
    h = 3.7
    got = {(r["a"], r["b"]): r["density"] for r in kde.kernel_density(*df, ["a", "b"], h).collect()}
    s = np.array(samples)
    for x, y in {tuple(p) for p in map(tuple, points)}:
        want = np.exp(-((s[:, 0] - x) ** 2 + (s[:, 1] - y) ** 2) / (2 * h * h)).sum() / (2 * math.pi * h * h * len(s))
        assert got[x, y] == pytest.approx(want, abs=1e-12)
    none = kde.kernel_density(spark.createDataFrame([], "a long, b long"), df[1], ["a", "b"], h)
    assert none.agg(F.sum("density")).first()[0] == 0


def test_mass_in_a_box(spark):
    """Simpson's rule against the error function."""
    rows = spark.range(40).select((F.col("id") - 20).alias("s"), F.lit(3).alias("t"))
    k = boxed(2.0, lambda t: F.lit(2.5))
    for r in rows.withColumn("k", k(F.col("s"), F.col("t"))).collect():
        z = [(3 + e - r["s"]) / 2.0 / math.sqrt(2) for e in (-2.5, 2.5)]
        assert r["k"] == pytest.approx((math.erf(z[1]) - math.erf(z[0])) / 2, abs=1e-8)


def test_likelihoods(spark):
    """A read near its isoform's samples is likelier than one far off; lengths without samples fall back to the shares of read lengths."""
    samples = spark.createDataFrame([(200, a % 5, a % 3) for a in range(300)], "iso_len long, off5 long, off3 long")
    reads = spark.createDataFrame([("r1", 1, 200, 2, 1, 100), ("r2", 1, 200, 30, 40, 120), ("r3", 2, 5000, 2, 1, 100), ("r4", 2, 5000, 2, 1, 120)], "read string, isoform long, iso_len long, off5 long, off3 long, read_len long")
    p = {r["read"]: r["p"] for r in kde.sampled_probabilities(reads, samples, 1.0).collect()}
    assert p["r1"] > 0.03 and p["r2"] < 1e-12 and p["r3"] == p["r4"] == pytest.approx(0.5)
    iso = spark.createDataFrame([(1, 200), (2, 5000)], "isoform long, iso_len long")
    theta = spark.createDataFrame([(1, 0.25), (2, 0.75)], "isoform long, theta double")
    q = {r["read"]: r["p"] for r in kde.score_probabilities(reads, iso, theta, samples, 1.0).collect()}
    assert q["r1"] > 0.01 and q["r2"] == q["r3"] == 0


def test_region_weights_by_their_places(spark):
    """Each start place counts once: all reads of all lengths in a region are enumerated."""
    exons = spark.createDataFrame([("1", "+", "G", "T", 1, 7), ("1", "+", "G", "T", 20, 23), ("1", "+", "G", "T", 40, 49)], "chrom string, strand string, gene string, isoform string, start long, end long")
    regions = annotation.regions(annotation.gene_models(exons))
    iso = annotation.isoforms(exons).select("isoform", "iso_len")
    samples = spark.createDataFrame([(21, t) for t in range(1, 22) for _ in range(t % 4 + 1)], "iso_len long, read_len long")
    h = 1.2
    s = np.array([t for t in range(1, 22) for _ in range(t % 4 + 1)])
    f = {t: np.exp(-((s - t) ** 2) / (2 * h * h)).sum() / (2 * math.pi * h * h * len(s)) for t in range(1, 22)}
    got = {r["region"]: r["weight"] for r in kde.region_weights(regions, iso, samples, h).collect()}
    sizes = [7, 4, 10]
    want = {}
    for i in range(3):
        for j in range(i, 3):
            total = sum(sizes[i : j + 1])
            name = "-".join(f"P{2 * k}:P{2 * k + 1}" for k in range(i, j + 1))
            inner = sum(sizes[i + 1 : j])
            want[name] = sum(f[t] for t in range(1, total + 1) for a in range(total - t + 1) if i == j or (a < sizes[i] and a + t > sizes[i] + inner))
    assert got == pytest.approx(want, abs=1e-9)
    assert kde.weighted_design(kde.region_weights(regions, iso, samples, h)).agg(F.sum("value")).first()[0] == pytest.approx(1)


def genes(rng, n: int, side: str) -> list[tuple]:
    rows = []
    for g in range(n):
        isoforms = int(rng.integers(1, 7))
        for r in range(int(rng.integers(1, 9))):
            on = rng.choice(isoforms, int(rng.integers(1, isoforms + 1)), replace=False)
            b = float(rng.integers(0, 9))
            rows += [("1", f"g{g}", f"{side}{r}", f"t{i}", float(rng.random()) + 0.1, b) for i in on]
    return rows


@pytest.mark.parametrize(("alpha", "bounds"), [(1.0, False), (0.4, False), (0.4, True), (0.0, True)])
def test_programme_is_optimal(spark, alpha, bounds):
    """The conditions of an optimum hold for every gene: no negative x, no slope where x is free, none downwards where it is bound."""
    kind = "chrom string, gene string, region string, isoform string, value double, b double"
    rng = np.random.default_rng(11)
    long, short, beta = genes(rng, 80, "L"), genes(rng, 70, "S"), 1e-6
    x = {(r["gene"], r["isoform"]): r["x"] for r in programme.solve_genes(spark.createDataFrame(long, kind), spark.createDataFrame(short, kind), alpha, beta, bounds).collect()}
    assert {k for k in x} == {(r[1], r[3]) for r in long + short}
    for g in {k[0] for k in x}:
        names = sorted(i for h, i in x if h == g)
        v = np.array([x[g, i] for i in names])
        slope, low = 2 * beta * v, np.zeros(len(v))
        for rows, weight, share in ((long, alpha, False), (short, 1 - alpha, True)):
            own = [r for r in rows if r[1] == g]
            regions = sorted({r[2] for r in own})
            a, b = np.zeros((len(regions), len(names))), np.zeros(len(regions))
            for r in own:
                a[regions.index(r[2]), names.index(r[3])] = r[4]
                b[regions.index(r[2])] = r[5]
            b = b / b.sum() if share and b.sum() else b
            slope += 2 * weight * (a.T @ (a @ v - b))
            if bounds and weight:
                for i in range(len(regions)):
                    if (a[i] != 0).sum() == 1:
                        j = int(np.argmax(a[i]))
                        low[j] = max(low[j], b[i] / a[i, j])
        assert (v >= low - 1e-12).all() and (slope >= -1e-7).all() and (np.abs(slope[v > low + 1e-9]) < 1e-7).all()


@pytest.mark.parametrize("bounds", [False, True])
def test_many_genes_are_solved_together(bounds, monkeypatch):
    """Small genes as each alone, in few steps for all; a gene of many isoforms beside them."""
    rng = np.random.default_rng(3)
    rows = [("1", f"g{g:04}", "LS"[r % 2], f"r{r}", f"t{i:02}", float(rng.random()), float(rng.integers(0, 9))) for g in range(300) for r in range(6) for i in rng.choice(5, 3, False)]
    rows += [("1", "h", "L", f"r{r}", f"t{i:02}", float(rng.random()), float(rng.integers(0, 9))) for r in range(30) for i in range(20)]
    g = pd.DataFrame(rows, columns=["chrom", "gene", "side", "region", "isoform", "value", "b"])
    calls, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *x: calls.append(1) or solve(*x))
    got = programme._kernel(g, 0.4, 1e-6, bounds)
    assert len(calls) < 200
    alone = pd.concat([programme._kernel(h, 0.4, 1e-6, bounds) for _, h in g.groupby("gene")], ignore_index=True)
    pd.testing.assert_frame_equal(got, alone, rtol=1e-7, atol=1e-9)
    gram, target = np.stack([m.T @ m + 1e-6 * np.eye(5) for m in rng.normal(size=(200, 4, 5))]), rng.normal(size=(200, 5))
    assert programme.least_squares_of_many(gram, target) == pytest.approx(np.array([programme.least_squares(a, t) for a, t in zip(gram, target, strict=True)]), rel=1e-5, abs=1e-5)


def test_reads_dealt_again(spark):
    kind = "chrom string, gene string, region string, isoform string, value double, b double"
    d = spark.createDataFrame([("1", "g", "a", "t1", 0.5, 4.0), ("1", "g", "ab", "t1", 0.5, 6.0), ("1", "g", "ab", "t2", 1.0, 6.0), ("1", "h", "x", "u1", 1.0, 3.0), ("1", "h", "x", "u2", 0.5, 3.0)], kind)
    x = spark.createDataFrame([("1", "g", "t1", 0.5), ("1", "g", "t2", 0.25), ("1", "h", "u1", 0.0), ("1", "h", "u2", 0.0)], "chrom string, gene string, isoform string, x double")
    assert {r["isoform"]: r["count"] for r in programme.reassign(d, x).collect()} == pytest.approx({"t1": 7.0, "t2": 3.0, "u1": 2.0, "u2": 1.0})
    counts = programme.estimate(d)
    assert counts.groupBy("gene").agg(F.sum("count").alias("n")).orderBy("gene").collect() == [("g", pytest.approx(10.0)), ("h", pytest.approx(3.0))]
    linear = {r["isoform"]: r["count"] for r in programme.estimate(d, linear=True).collect()}
    assert linear["t1"] + linear["t2"] == pytest.approx(10) and linear["u1"] + linear["u2"] == pytest.approx(3)
    e = {r["isoform"]: r for r in programme.gene_expression(counts, spark.createDataFrame([("t1", 100.0)], "isoform string, tpm double"), 0.25).collect()}
    assert e["t1"]["tpm"] == pytest.approx(75 + 0.25 * e["t1"]["count"] / 13 * 1e6) and e["u1"]["short_tpm"] == 0


def test_k_values_of_reads(spark, tmp_path):
    sam = "@SQ\tSN:1\tLN:1000\n" + "".join(f"{n}\t{f}\t1\t{p}\t60\t{c}\t*\t0\t0\tA\tI\n" for n, f, p, c in READS)
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "r.sam").write_text(sam)
    main(["k-values", "--annotation", f"{tmp_path}/a.gtf", "--alignments", f"{tmp_path}/r.sam", "--output", f"{tmp_path}/k"])
    t = {r["gene"]: r for r in tables.read_table(spark, f"{tmp_path}/k/LR_singular_values.out").collect()}
    # Reads show one region of both isoforms and one of each: two isoforms, three regions, full rank.
    assert t["G1"]["n_regions"] == 3 and t["G1"]["n_isoforms"] == 2
    values = [float(x) for x in t["G1"]["singular_values"].split(",")]
    assert len(values) == 2 and values[0] > values[1] > 0
    k = {r["gene"]: r for r in tables.read_table(spark, f"{tmp_path}/k/LR_kvalues_gene.out").collect()}
    assert k["G1"]["k_value"] == pytest.approx((values[0] - values[1]) / values[0]) and REACH == 9
    whole = {r["gene"]: r["n_regions"] for r in tables.read_table(spark, f"{tmp_path}/k/kvalues_gene.out").collect()}
    assert whole["G1"] == 7
