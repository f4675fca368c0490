"""Each query of the reference's operators against its SQL in DuckDB."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandflow.operators.assign import molecule_counts
from strandflow.plans import contract, estimators, models, outputs, readings, regional

QUERIES = contract.QUERIES | readings.QUERIES | models.QUERIES | estimators.QUERIES | regional.QUERIES | outputs.QUERIES
ORACLE_SQL = contract.ORACLE_SQL | readings.ORACLE_SQL | models.ORACLE_SQL | estimators.ORACLE_SQL | regional.ORACLE_SQL | outputs.ORACLE_SQL
SF = os.environ.get("CONTRACT_SF_DIR", "/root/testdata/sf0.001")


def rows(t: pd.DataFrame) -> list[tuple]:
    t = t[sorted(t.columns)]
    return sorted((tuple(None if pd.isna(x) else float(f"{x:.6g}") if isinstance(x, float) else x for x in r) for r in t.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def near(x: str, y: str, distance: int) -> bool:
    return (sum(a != b for a, b in zip(x, y, strict=True)) if len(x) == len(y) else max(len(x), len(y))) <= distance


def groups(names: list[str], distance: int) -> int:
    """The fold of the names in their order: a name joins the first group that has a member within the distance, and groups never merge."""
    found: list[set] = []
    for x in names:
        fit = [g for g in found if any(near(x, y, distance) for y in g)]
        fit[0].add(x) if fit else found.append({x})
    return len(found)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_molecules_of_similar_names(spark, distance):
    """The counts of the fold, for names of several lengths, shorter than the distance too, and a cell that has most of them."""
    rnd = random.Random(distance)
    names = ["".join(rnd.choice("ACGT") for _ in range(rnd.choice([1, 2, 3, 5, 6]))) for _ in range(700)]
    rows = [("hot" if i % 3 else f"c{i % 7}", "t", u, f"r{i}") for i, u in enumerate(names)]
    got = molecule_counts(spark.createDataFrame(rows, "barcode string, isoform string, umi string, read string"), distance)
    want = {b: groups(sorted({u for c, _, u, _ in rows if c == b}), distance) for b in {r[0] for r in rows}}
    assert {r["barcode"]: r["count"] for r in got.collect()} == want


def test_many_molecules_of_one_cell(spark):
    """A hundred thousand names of one cell and isoform: against an index of all names that one change makes."""
    rows = spark.range(100_000).select(F.lit("c").alias("barcode"), F.lit("t").alias("isoform"), F.translate(F.lpad(F.conv((F.col("id") * 7919 % 262144).cast("string"), 10, 4), 9, "0"), "0123", "ACGT").alias("umi"), F.lit("r").alias("read"))
    names = sorted({r["umi"] for r in rows.collect()})
    seen, want = set(), 0
    for x in names:
        want += not any(x[:i] + c + x[i + 1 :] in seen for i in range(9) for c in "ACGT")
        seen.add(x)
    assert molecule_counts(rows, 1).first()["count"] == want


def test_molecules_without_similar_names(spark):
    got = QUERIES["umi_hamming1"](spark, SF).toPandas()
    c = duckdb.sql(f"SELECT c_mktsegment AS b, c_custkey % 50 AS i, list(DISTINCT substr(c_name, -3) ORDER BY substr(c_name, -3)) AS names FROM '{SF}/customer.parquet' GROUP BY ALL").fetchall()
    assert {(b, i): n for b, i, n in got[["barcode", "isoform", "count"]].itertuples(index=False)} == {(b, i): groups(n, 1) for b, i, n in c}
    exact = molecule_counts(spark.createDataFrame([("c", "t", None, "r1"), ("c", "t", "u", "r2"), ("c", "t", "u", "r3"), (None, "t", "u", "r4")], "barcode string, isoform string, umi string, read string"))
    assert [tuple(r) for r in exact.collect()] == [("c", "t", 2)]
