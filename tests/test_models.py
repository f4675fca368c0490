"""Regions kept by rank, condition numbers, and models chosen by coverage: worked values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.config import KSettings
from strandflow.operators.annotation import gene_models
from strandflow.operators.features import model_columns, nearest_model, predict_alpha
from strandflow.operators.identifiability import condition, design_matrix
from strandflow.operators.readmap import candidates, map_to_genes
from strandflow.operators.regions import with_reads
from strandflow.plans import models

_REGION = "chrom string, gene string, region string, region_len long, n_atoms int, inner_len long, isoforms array<string>"


def test_regions_of_genes_that_reads_do_not_resolve(spark):
    rows = [("1", "g", "P0:P1", 100, 1, 0, ["a", "b"]), ("1", "g", "P2:P3", 50, 1, 0, ["b"]), ("1", "g", "P0:P1-P2:P3", 150, 2, 0, ["b"]), ("1", "h", "P0:P1", 100, 1, 0, ["c"])]
    regions = spark.createDataFrame(rows, _REGION)

    def kept(counts: list[tuple], short: bool = False) -> set:
        c = spark.createDataFrame(counts, "chrom string, gene string, region string, reads long")
        return {(r["gene"], r["region"]) for r in with_reads(regions, c, "nonfullrank", short).collect()}

    seen = {("g", "P0:P1"), ("h", "P0:P1")}
    poor = [("1", "g", "P0:P1", 3), ("1", "h", "P0:P1", 1)]
    assert kept(poor) == seen | {("g", "P0:P1-P2:P3")}  # one region for two isoforms: full-length ones are added
    assert kept(poor, True) == seen | {("g", "P2:P3")}  # of short reads: those without junctions
    assert kept([*poor, ("1", "g", "P2:P3", 1)]) == seen | {("g", "P2:P3")}
    assert kept([]) == {("g", "P0:P1"), ("g", "P0:P1-P2:P3"), ("h", "P0:P1")}


def test_condition_numbers():
    same = np.array([[0.5, 0.5], [0.5, 0.5]])
    assert condition(same) == pytest.approx((1.0, float("inf"), 1.0, 1.0))
    a = np.array([[1.0, 0.0], [0.0, 0.1]])
    assert condition(a) == pytest.approx((0.9, 10.0, 10.0, 0.1))
    assert condition(a, 0.5) == pytest.approx((0.9, 10.0, 1.0, 1.0))  # a tolerance drops small values, the rank stays full
    assert np.isnan(condition(np.zeros((2, 1)))).all()


def test_weights_by_inner_exons(spark):
    rows = [("1", "g", "P0:P1", 100, 1, 0, ["a"]), ("1", "g", "P0:P1-P2:P3-P4:P5", 300, 3, 49, ["a"])]
    m = design_matrix(spark.createDataFrame(rows, _REGION), KSettings(read_length=100, minus_inner=True))
    assert {r["region"]: round(r["value"], 6) for r in m.collect()} == {"P0:P1": round(1 / 1.5, 6), "P0:P1-P2:P3-P4:P5": round(0.5 / 1.5, 6)}


def test_models_by_coverage(spark):
    names = ["/m/LR1M_SR10M.pkl", "/m/LR5M_SR10M.pkl", "/m/LR5M_SR40M.pkl"]
    assert nearest_model(names, 35_000_000, 4_000_000) == names[2] and nearest_model(names, 9_000_000, 2_000_000) == names[0]
    f = spark.createDataFrame([(1, 2, 0.5, 9.0), (2, 0, None, 9.0)], "community long, n_x long, mean_x double, variance_x double")
    assert model_columns(f.columns) == ["n_x", "mean_x"]
    got = predict_alpha(f, lambda x: np.abs(np.arange(21) / 20 - x[:, :1] / 4)).orderBy("community").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.5), (2, 0.0, 0.0)]


def test_reads_of_one_gene_in_many_tasks(spark):
    """However the reads of a gene are dealt, each meets a copy of its model."""
    exons, reads = models._spaced(spark, "/root/testdata/sf0.001")
    m = gene_models(exons)
    pairs = candidates(reads.where(F.xxhash64("read") % 20 == 0), m)
    whole, dealt = (sorted((r["read"], r["gene"], r["region"], len(r["compatible"])) for r in map_to_genes(pairs, m, share=n).collect()) for n in (50_000, 2))
    assert whole == dealt and len({g for _, g, _, _ in whole}) > 1
