"""Worked values of FIXTURES.md: one gene with two isoforms, three reads, one cell."""

import pytest

from strandflow.config import MapSettings
from strandflow.operators.annotation import atoms, gene_models, regions
from strandflow.operators.em import unit_em
from strandflow.operators.identifiability import k_values
from strandflow.operators.matrix import apportion
from strandflow.operators.readmap import best_region

ATOMS = [(101, 200), (201, 250), (301, 400)]
RUNS = [[0, 2], [0, 1, 2]]


@pytest.fixture(scope="module")
def exons(spark):
    rows = [("T1", 101, 200), ("T1", 301, 400), ("T2", 101, 250), ("T2", 301, 400)]
    return spark.createDataFrame([("1", "+", "G1", *r) for r in rows], "chrom string, strand string, gene string, isoform string, start long, end long")


def test_atoms_and_regions(exons):
    assert [(r.start, r.end) for r in atoms(exons).orderBy("start").collect()] == ATOMS
    found = {r.region: (r.region_len, r.isoforms) for r in regions(gene_models(exons)).collect()}
    assert found == {
        "P0:P1": (100, ["T1", "T2"]), "P4:P5": (100, ["T1", "T2"]), "P2:P3": (50, ["T2"]), "P0:P1-P4:P5": (200, ["T1"]), "P0:P1-P2:P3": (150, ["T2"]),
        "P2:P3-P4:P5": (150, ["T2"]), "P0:P1-P2:P3-P4:P5": (250, ["T2"]),
    }


def test_k_values(exons):
    r = k_values(regions(gene_models(exons))).first()
    assert [r.k_value, r.condition, r.generalised, r.product] == pytest.approx([0.410159, 1.695373, 1.695373, 0.574371], abs=1e-6)


@pytest.mark.parametrize(
    ("blocks", "chain"), [([(101, 200), (301, 400)], [0, 2]), ([(101, 250), (301, 400)], [0, 1, 2]), ([(301, 400)], [2]), ([(301, 315)], None)]
)
def test_best_region(blocks, chain):
    found = best_region(blocks, ATOMS, RUNS, MapSettings())
    assert (found[0] if found else None) == chain


@pytest.mark.parametrize("batch", [2, 10000])
def test_cells(spark, batch):
    """Cells that end within batches, at their ends, and that span several; a repeated molecule; a cell without likelihood; equal remainders."""
    reads = [("U1", "T1", 0.25), ("U2", "T2", 0.1666667), ("U3", "T1", 0.00490196), ("U3", "T2", 0.00219298), ("U3", "T1", 0.00490196)]
    rows = [(0, c, *r) for c in ("C1", "C2", "C3") for r in reads] + [(0, "C4", "U1", "T1", 0.0), (0, "C4", "U1", "T2", 0.0), (0, None, "U1", "T2", 1.0)]
    cond = spark.createDataFrame(rows, "community int, barcode string, umi string, isoform string, p double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        counts = apportion(unit_em(cond), ["community", "barcode"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {(r.barcode, r.isoform): r["count"] for r in counts}
    assert found == {(c, i): n for c in ("C1", "C2", "C3") for i, n in (("T1", 2), ("T2", 1))} | {("C4", "T1"): 0, ("C4", "T2"): 1, (None, "T2"): 1}
