"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage; the pipeline against a plain one."""

import importlib.util
import zlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import fingerprints, lm_scoring, mixing, ngram_join, packing, substring_dedup, topk_search, toxicity, warc
from strandflow.llm._words import read_words

KINDS = "doc_id long, text string, lang string, source string, n_chars long, block int, size string, low string, __h int, score string, toxic string"
LONG = " ".join(f"w{i % 5000}" for i in range(400_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c " * 30, "en", "a", 180), (4, "a b c " * 30, "de", None, 180), (4, "a b c " * 30, "de", None, 180),
    (None, "lone words", "en", "b", 10), (None, None, None, None, None), (7, LONG, "en", "b", len(LONG)), (8, " \t\n", "en", "a", 3), (9, "only three words", "en", "a", 16),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 5, "s", "l", 6, "x", "t") for r in ROWS], KINDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def model(spark):
    texts = [(i, f"you are a {'vile rotten fool' if i % 2 else 'kind and gentle soul'} number {i % 7}", "en") for i in range(60)]
    return toxicity.fit_on(spark.createDataFrame(texts, "doc_id long, text string, lang string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))


def n_words(text) -> int:
    return len((text or "").split())


def test_substring_dedup(docs, none):
    t = substring_dedup.repeated_words(docs).toPandas()
    assert len(t) == 10 and sorted(t["n_words"]) == sorted(n_words(r[1]) for r in ROWS)
    by_id = t.dropna(subset="doc_id").groupby("doc_id")["n_removed"].max().to_dict()
    assert by_id == {1: 0, 2: 0, 3: 0, 4: 90, 7: 0, 8: 0, 9: 0}  # repeats within one document stay
    kept = substring_dedup.without_repeats(docs).collect()
    assert len(kept) == 10 and kept[0].__fields__ == docs.columns and sorted(r["text"] for r in kept if r["doc_id"] == 4) == ["", ""]
    assert substring_dedup.repeated_words(none).count() == 0 and substring_dedup.without_repeats(none).count() == 0


def test_jaccard_join(docs, none):
    t = ngram_join.jaccard_components(docs).toPandas()
    assert len(t) == 10 and t[t["doc_id"] == 4]["component_id"].tolist() == [3, 3] and t[t["doc_id"] == 9]["n_shingles"].tolist() == [1]
    assert sorted(t[t["n_shingles"] == 0]["component_id"].dropna()) == [1, 2, 8]
    kept = ngram_join.first_of_groups(docs)
    assert sorted(kept.select("doc_id").toPandas()["doc_id"].dropna()) == [1, 2, 3, 7, 8, 9] and kept.count() == 8 and kept.columns == docs.columns
    assert ngram_join.jaccard_components(none).count() == 0 and ngram_join.first_of_groups(none).count() == 0


def test_fingerprints(docs, none):
    t = fingerprints.compare_edited(docs).toPandas()
    assert len(t) == 10 and t[t["doc_id"].isin([3, 4])]["fingerprint"].nunique() == 1 and t[["near_edited", "near_next"]].stack().between(0, 1).all()
    assert sorted(t["n_chars"]) == sorted(len(r[1] or "") for r in ROWS) and fingerprints.compare_edited(none).count() == 0


def test_toxicity(spark, docs, none):
    m = model(spark)
    t = toxicity.score(docs, m).toPandas()
    assert len(t) == 10 and t["score"].between(0, 1).all() and t[t["doc_id"].isin([3, 4])]["score"].nunique() == 1 and t.columns.tolist() == [*[c for c in docs.columns if c != "score"], "score"]
    bad = spark.createDataFrame([(1, "a vile rotten fool", "en"), (2, "a kind and gentle soul", "xx"), (3, None, None)], "doc_id long, text string, lang string")
    assert sorted(r[0] for r in toxicity.without_toxic(bad, m).select("doc_id").collect()) == [2, 3]
    assert toxicity.without_toxic(docs, m).columns == docs.columns and toxicity.without_toxic(none, m).count() == 0
    blank = toxicity.fit_on(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.without_toxic(docs, blank).count() == 10


def test_language_model(docs, none):
    t = lm_scoring.score_texts(docs, F.col("doc_id") == 9).toPandas()
    assert len(t) == 10 and (t["score"] < 0).all() and sorted(t["n_tokens"]) == sorted(n_words(r[1]) + 1 for r in ROWS)
    assert t[t["doc_id"].isin([3, 4])]["score"].nunique() == 1 and t["train_tokens"].unique().tolist() == [sum(n_words(r[1]) + 1 for r in ROWS if r[0] not in (9, None))]
    assert lm_scoring.score_texts(none, F.lit(False)).count() == 0


def test_top_k(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, []), (4, None), (5, [None, 1.0]), (6, [0.25])]
    t = topk_search.top_k(topk_search.integer_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"), F.col("id") == 1, 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in t] == [(2, 32768), (2, 32768), (6, 8192)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk_search.top_k(topk_search.integer_rows(empty, "vec_id", "embedding"), F.lit(True), 3).count() == 0


def test_packing(docs, none):
    t = packing.pack(docs, mixing.word_count(F.col("text"))).toPandas()
    assert t["piece_size"].sum() == sum(n_words(r[1]) for r in ROWS) and t["bin_id"].isna().sum() == sum(n_words(r[1]) == 0 for r in ROWS)
    assert t["piece_size"].max() == 4096 and packing.pack(none, mixing.word_count(F.col("text"))).count() == 0


def test_packing_fills_its_bins():
    """Against a lower bound: no packing takes fewer words of bins than there are words of pieces."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1500, 5000)
    b, _, length = packing.best_fit(sizes)
    total = sum({int(x): int(n) for x, n in zip(b, length, strict=True)}.values())
    assert sizes.sum() <= total <= 1.02 * sizes.sum()


def test_mixing(docs, none):
    t = mixing.mix(docs).toPandas()
    assert len(t) == 10 and (t["taken"] <= 2 * t["size"]).all() and t["low"].tolist() == ["l"] * 10 and t["__h"].tolist() == [6] * 10
    m = mixing.mixed(docs)
    assert m.columns == docs.columns and m.where("size <> 's'").count() == 0 and m.count() == sum(len(p) for p in t["positions"] if p is not None)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_archives(spark):
    """The page of a result is the one that the record names; long payloads, pages without id, address or text, and pages of one address."""
    kinds = "page_id long, url string, html string, file string"
    page = "<p>" + "x" * 3_000_000 + "</p>"
    rows = [(1, None, None, "f"), (2, "u", "", "f"), (3, "http://a/b", page, "f"), (4, "http://a/b", page, "f"), (5, "http://a/b", "other " * 30, "f"), (5, "http://a/b", "other " * 30, "f"), (None, "x", page, "f")]
    t = warc.archive_round_trip(spark.createDataFrame(rows, kinds), payloads=True).toPandas()
    assert len(t) == 7 and t.dropna(subset="page_id").groupby("page_id")["record_type"].first().to_dict() == {1: "response", 2: "response", 3: "response", 4: "revisit", 5: "response"}
    assert t[t["page_id"] == 4]["refers_to"].tolist() == [3] and t[t["page_id"].isna()]["refers_to"].tolist() == [3]
    assert t[t["page_id"] == 3]["payload"].tolist() == [page.encode()] and t[t["page_id"] == 4]["payload_bytes"].tolist() == [len(page)]
    assert warc.archive_round_trip(spark.createDataFrame([], kinds)).count() == 0


def test_word_hashes_of_regular_words():
    """Words whose letters follow a pattern that cancels out in polynomials over powers of two."""
    import pyarrow as pa

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    (t,) = read_words(pa.chunked_array([[f"{a} {b} {a[:1024]} {b[:1024]}"]]))
    assert len(set(t.hashes.tolist())) == 4


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_against_plain_stages(spark, tmp_path):
    """More partitions than documents, nulls and repeated rows: what each stage keeps is what a plain version of it keeps."""
    import corpus_pipeline as p

    rng = np.random.default_rng(5)
    word = [f"v{i}" for i in range(300)]
    texts = [" ".join(rng.choice(word, 80)) for _ in range(14)]
    texts[3] = texts[1]
    texts[5] = texts[2] + " more"
    passage = " ".join(f"p{i}" for i in range(60))
    texts[7], texts[8] = f"{texts[7]} {passage} end", f"{passage} {texts[8]}"
    toxic = [f"you vile rotten fool number {i}" for i in range(30)]
    calm = [f"you kind and gentle soul number {i} " + " ".join(rng.choice(word, 8)) for i in range(30)]
    rows = [(i, x, "en", "ab"[i % 2], len(x)) for i, x in enumerate([*texts, *toxic, *calm])]
    rows += [rows[1], (200, None, None, None, None), (201, "", "en", "a", 0), (None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(14 <= i < 44)) for i in range(74)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        kept = []
        for name, stage in p.STAGES:
            docs = p.materialize(stage(spark, docs, str(tmp_path)), name)
            kept.append(docs.toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    clean, single, cut, mix, packed = kept
    ids = set(clean["doc_id"].dropna())
    learned = {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    assert not ids & set(range(14, 44)) & learned and set(range(14)) <= ids and {200, 201} <= ids

    def shingles(x) -> frozenset:
        w = (x or "").lower().split()
        return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {(i, x): shingles(x) for i, x in clean[["doc_id", "text"]].itertuples(index=False)}
    names = sorted(sets, key=lambda k: (k[0] != k[0], k[0] if k[0] == k[0] else 0, k[1] or ""))
    root = {k: k for k in names}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                root[find(b)] = find(a)
    want = sorted(k[0] for k in names if find(k) == k and sets[k])
    assert sorted(single[single["text"].fillna("").str.strip() != ""]["doc_id"]) == want
    assert len(single[single["text"].fillna("").str.strip() == ""]) == len(clean[clean["text"].fillna("").str.strip() == ""])
    assert cut.set_index("doc_id").loc[8, "text"] == texts[8].removeprefix(passage + " ") and cut.set_index("doc_id").loc[7, "text"] == texts[7]
    size = {i: n_words(x) for i, x in cut[["doc_id", "text"]].dropna().itertuples(index=False)}
    assert (cut["n_chars"].fillna(0) == cut["text"].fillna("").str.len()).all()
    words = mix.groupby("doc_id")["text"].apply(lambda x: sum(map(n_words, x)))
    assert all(words[i] <= 2 * size[i] for i in words.index) and abs(words.sum() - 1.5 * sum(size.values())) <= 3
    packed = packed.sort_values(["bin_id", "bin_start"])
    assert packed["piece_size"].sum() == words.sum()
    for (_, a), (_, b) in pairwise(packed.iterrows()):
        assert a["bin_id"] != b["bin_id"] or a["bin_start"] + a["piece_size"] == b["bin_start"]


def test_packing_of_rows_without_ids(spark):
    """Sixty thousand rows without an id share as many shards as rows with ids do."""
    kept = packing.pack(spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 50 + 1).alias("n")), F.col("n"))
    shards = kept.groupBy(F.split_part("bin_id", F.lit(":"), F.lit(1))).count().toPandas()["count"]
    assert len(shards) == 3 and shards.sum() == 60_000 and shards.max() < 25_000
