"""Regions of isoforms of the same atoms."""

import random

from strandflow.operators import annotation, features, store
from strandflow.operators.annotation import gene_models, regions


def test_runs_are_made_once_for_isoforms_of_the_same_atoms(spark):
    exons = [("1", "+", g, f"{g}{i:02}", a, a + 99) for g in "gh" for i in range(40) for a in ((1, 1001, 2001) if i % 2 else (1, 2001))]
    r = regions(gene_models(spark.createDataFrame(exons, "chrom string, strand string, gene string, isoform string, start long, end long")))
    # Runs are made above an aggregate by atoms.
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [chrom" in plan[plan.index("Generate explode(") :].split("Generate", 2)[1] and "atom_ids" in plan and "names" in plan
    got = {(x["gene"], x["region"]): x["isoforms"] for x in r.collect()}
    odd, even = ([f"{i:02}" for i in range(40) if i % 2 == k] for k in (1, 0))
    want = {"P0:P1": sorted(odd + even), "P4:P5": sorted(odd + even), "P2:P3": odd, "P0:P1-P2:P3": odd, "P2:P3-P4:P5": odd, "P0:P1-P2:P3-P4:P5": odd, "P0:P1-P4:P5": even}
    assert got == {(g, n): [g + i for i in x] for g in "gh" for n, x in want.items()}


def test_a_gene_is_spread_over_slices(spark, monkeypatch):
    """Exons within, across and at the ends of slices, and slices without any: as in one task; no window orders a whole gene's cuts."""
    monkeypatch.setattr(annotation, "SLICE", 10)
    rnd = random.Random(5)
    exons = [("1", g, a, a + rnd.choice([0, 1, 3, 9, 10, 44])) for g in "gh" for a in [rnd.randrange(-30, 400) for _ in range(40)] + [900, 910, 919]]
    e = spark.createDataFrame(exons, "chrom string, gene string, start long, end long")
    whole, spread = annotation.atoms(e), annotation.atoms(e, len(exons))
    assert sorted(spread.collect()) == sorted(whole.collect()) and spread.count() > 60
    assert "Window [row_number" not in spread._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_dealt_by_their_number(spark, monkeypatch):
    """Parts follow the hits and are not put together again; fragments of several isoforms, genes and lengths."""
    monkeypatch.setattr(store, "ROWS", 10)
    hits = spark.createDataFrame([(f"f{i}", i % 7, 30) for i in range(200)] + [("f0", 1, 60), ("f1", 99, 30), ("f2", 2, 90)], "frag string, isoform long, frag_len long")
    v = features.short_read_values(hits, spark.createDataFrame([(i, f"g{i % 3}") for i in range(7)], "isoform long, gene string"))
    assert v.rdd.getNumPartitions() == 21
    got = {}
    for r in v.collect():
        got[r["gene"], r["kind"], r["value"]] = got.get((r["gene"], r["kind"], r["value"]), 0) + 1
    want = {(f"g{k}", "unique_mapping_SRs", 30.0): sum(i % 7 % 3 == k for i in range(200)) for k in range(3)}
    want["g0", "unique_mapping_SRs", 30.0] -= 1
    want["g2", "unique_mapping_SRs", 30.0] -= 1
    assert got == want | {("g0", "multi_mapping_SRs", 30.0): 1, ("g1", "multi_mapping_SRs", 60.0): 1, ("g2", "multi_mapping_SRs", 90.0): 1}
