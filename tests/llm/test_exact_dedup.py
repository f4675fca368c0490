"""Exact copies against a plain grouping: edges, hot groups, and trees of several rounds."""

import hashlib
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandflow.llm import exact_dedup
from tests.llm.test_edges import KINDS, LONG, ROWS

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows: list[tuple], largest: bool = True) -> list[tuple]:
    """(doc_id, keep_id, group_size, text_sha256) of each row."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("largest", [True, False])
def test_edges(spark, largest):
    """Nulls count as empty; of repeated rows one stays; rows without an id stay only where all equal ones lack it; clashing names pass."""
    more = [(11, LONG.upper(), "en", "c", 1), (12, "Äb", "en", "c", 2), (13, "äB", "en", "c", 2), (14, "ÄB", "en", "c", 2), (None, "LONE words", "en", "b", 10)]
    docs = spark.createDataFrame([(*r, 5, "s", "l", 6, "x", "t") for r in ROWS + more], KINDS).withColumnsRenamed({"block": "at", "low": "digest", "score": "n", "toxic": "best"})
    got = exact_dedup.copies(docs, largest=largest).drop("at")
    assert found(got) == plain([r[:2] for r in ROWS + more], largest)
    stays = got.where("kept").groupBy("text_sha256").count().toPandas()
    assert (stays["count"] == 1).all() and len(stays) == len({(r[1] or "").translate(LOWER) for r in ROWS + more})
    assert got.where("kept AND NOT doc_id <=> keep_id").count() == 0
    kept = exact_dedup.without_copies(docs, largest=largest)
    assert kept.columns == docs.columns and kept.count() == len(stays)


def test_empty(spark):
    none = spark.createDataFrame([], KINDS)
    assert exact_dedup.copies(none).count() == 0 and exact_dedup.without_copies(none).count() == 0


def test_hot_groups_in_many_rounds(spark, monkeypatch):
    """Runs of a few rows, merges of two: a third of the rows in one group, groups of every size, and no entry of a hot group in more than its run."""
    for name, value in (("FAN_LOG2", 1), ("RUN_ROWS", 50), ("CHUNK_LOG2", 2), ("SLICES_LOG2", 1)):
        monkeypatch.setattr(exact_dedup, name, value)
    ids = spark.range(6000).repartition(13)
    text = F.when(F.col("id") % 3 == 0, "Hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), F.floor(F.sqrt("id")))).otherwise(F.concat(F.lit("own "), "id"))
    docs = ids.select((F.col("id") * 7919 % 6007).alias("doc_id"), text.alias("text"))
    assert found(exact_dedup.copies(docs).drop("at")) == plain([tuple(r) for r in docs.collect()])


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.op12_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
