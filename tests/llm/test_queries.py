"""The corpus queries: against SQL where there is some, else against plain versions or invariants, on the smallest tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandflow.llm.packing import best_fit
from strandflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, coalesce(text, '') AS text, source FROM documents").df()


def words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def rows(t: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in t[sorted(t.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    want = duck.sql(ORACLE_SQL[name]).df()
    assert rows(QUERIES[name](spark, SF).select(*want.columns).toPandas()) == rows(want)


def test_html_extraction_drops_markup(spark, duck):
    t = QUERIES["op1_html_extraction"](spark, SF).toPandas()
    assert len(t) == duck.sql("SELECT count(*) FROM pages").fetchall()[0][0]
    assert (t["n_chars"] == t["text"].str.len()).all()
    assert not t["text"].str.contains("<script|</p>|</div>", regex=True).any()


def test_fingerprints(spark, docs):
    t = QUERIES["op4_imatch_fingerprints"](spark, SF).toPandas().sort_values("doc_id")
    d = docs.sort_values("doc_id")["text"].tolist()
    edited = [x[: len(x) - len(x) // 4] + y[: len(x) // 4] for x, y in zip(d, d[1:] + d[:1], strict=True)]
    assert t["edited_sha256"].tolist() == [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    assert t.assign(text=d).groupby("text")["fingerprint"].nunique().max() == 1
    assert t[["near_edited", "near_next"]].stack().between(0, 1).all()
    assert t["near_edited"].mean() > t["near_next"].mean()


def test_toxicity_on_held_out_rows(spark, duck):
    """On sf0.01: the smallest table has only five toxic rows that are held out."""
    t = QUERIES["op5_toxicity"](spark, SF.replace("sf0.001", "sf0.01")).toPandas()
    assert (t["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in t["doc_id"]]).all()
    assert t["score"].between(0, 1).all() and ((t["score"] >= 0.7) == (t["predicted"] == 1)).all()
    m = t[t["held_out"]].merge(duck.sql(f"SELECT doc_id, toxic FROM '{SF.replace('sf0.001', 'sf0.01')}/labels.parquet'").df(), on="doc_id")
    a, b = m[m["toxic"] == 1]["score"].to_numpy(), m[m["toxic"] == 0]["score"].to_numpy()
    if len(a) and len(b):
        assert (a[:, None] > b).mean() > 0.8


def test_language_model_base_score(spark, docs):
    t = QUERIES["op7_lm_scoring"](spark, SF).toPandas().set_index("doc_id")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*words(x.translate(fold)), None] for i, x in zip(docs["doc_id"], docs["text"], strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts: dict = {}
    for i, ts in tokens.items():
        for w in ts if not held[i] else ():
            counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    for i, ts in tokens.items():
        c = np.array([counts.get(w, 0) for w in ts])
        assert t.loc[i, "n_tokens"] == len(ts) and t.loc[i, "n_known"] == (c > 0).sum() and t.loc[i, "train_tokens"] == n
        assert np.isclose(t.loc[i, "base_score"], np.log10((c + 0.1) / (n + 0.1 * (len(counts) + 1))).sum(), rtol=1e-6)
    assert (t["score"] <= 0).all()


def test_packing_places_every_word_once(spark, docs):
    t = QUERIES["op9_best_fit_packing"](spark, SF).toPandas()
    size = t.groupby("doc_id")["piece_size"].sum()
    assert size.to_dict() == {i: len(words(x)) for i, x in zip(docs["doc_id"], docs["text"], strict=True)}
    binned = t[t["bin_id"].notna()].sort_values(["bin_id", "bin_start"])
    ends = binned["bin_start"] + binned["piece_size"]
    assert (ends <= binned["bin_length"]).all()
    same = binned["bin_id"].eq(binned["bin_id"].shift())
    assert (binned["bin_start"][same] == ends.shift()[same]).all()


def test_best_fit_ties_and_nothing():
    assert [len(x) for x in best_fit(np.zeros(0, np.int64))] == [0, 0, 0]
    b, start, length = best_fit(np.array([512, 512, 4096]), (512, 4096))
    assert len(set(b.tolist())) >= 2 and (start + [512, 512, 4096] <= length).all()


def test_mixing_meets_targets(spark, docs):
    t = QUERIES["op10_mixing_weights"](spark, SF).toPandas()
    assert t.set_index("doc_id")["size"].to_dict() == {i: len(words(x)) for i, x in zip(docs["doc_id"], docs["text"], strict=True)}
    assert (t["taken"] <= 2 * t["size"]).all()
    g = docs[["doc_id", "source"]].merge(t, on="doc_id").groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(g["taken"] - g["target"]) <= 1).all() and (g["target"] <= 2 * g["size"] + 1e-6).all()


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op3_ngram_jaccard", "op9_best_fit_packing", "op10_mixing_weights"])
def test_empty_null_and_repeated_rows(spark, tmp_path, name):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0
    some = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b " * 30, "en", "a", 120), (4, "a b " * 30, "en", None, 120), (4, "a b " * 30, "en", None, 120)]
    spark.createDataFrame(some, kinds).write.parquet(f"{tmp_path}/some/documents.parquet")
    assert QUERIES[name](spark, f"{tmp_path}/some").select("doc_id").distinct().count() == 4
