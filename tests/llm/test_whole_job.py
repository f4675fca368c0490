"""Cases that operators once left out: each against a plain version or a worked value."""

from functools import cache
from math import floor, inf, isfinite, log, log10, nan

import numpy as np
from pyspark.sql import functions as F

from strandflow.llm.fingerprints import compare_edited, fingerprint
from strandflow.llm.lm_scoring import log_kt, score_texts
from strandflow.llm.mixing import mix
from strandflow.llm.topk_search import integer_rows, top_k

CONTEXT = 7


def plain_scores(texts: list[bytes], learn: list[bool]) -> list[float]:
    """Context-tree weighting by dictionaries: nodes are (last bytes, nearest first; bits of the byte so far)."""

    def steps(text: bytes):
        b = bytes(CONTEXT) + text.lower() + b"\0"
        for i in range(CONTEXT, len(b)):
            yield b[i - CONTEXT : i][::-1], f"{b[i]:08b}"

    counts: dict = {}
    children: dict = {}
    for text in (t for t, known in zip(texts, learn, strict=True) if known):
        for context, bits in steps(text):
            for k in range(8):
                for d in range(CONTEXT + 1):
                    counts.setdefault((context[:d], bits[:k]), [0, 0])[int(bits[k])] += 1
                    if d:
                        children.setdefault((context[: d - 1], bits[:k]), set()).add((context[:d], bits[:k]))

    def own(node) -> float:
        n = counts.get(node, [0, 0])
        return float(log_kt(np.array([n[0]]), np.array([n[1]]))[0])

    @cache
    def below(node) -> float:
        return sum(weighted(c) for c in children.get(node, ()))

    @cache
    def weighted(node) -> float:
        return own(node) if len(node[0]) == CONTEXT else float(np.logaddexp(own(node), below(node))) - log(2)

    def code(context: bytes, bits: str, k: int) -> float:
        for d in range(CONTEXT, -1, -1):
            node = (context[:d], bits[:k])
            n = counts.get(node, [0, 0])
            kt = (n[int(bits[k])] + 0.5) / (sum(n) + 1)
            w = 1.0 if d == CONTEXT else 1 / (1 + np.exp(np.clip(below(node) - own(node), -700, 700)))
            q = kt if d == CONTEXT else w * kt + (1 - w) * q
        return log10(q)

    return [sum(code(c, bits, k) for c, bits in steps(t) for k in range(8)) for t in texts]


def test_language_model_has_seven_bytes_of_context(spark):
    """Held-out texts whose last byte hangs on the seventh byte before; characters of several bytes set keys' first bits."""
    texts = ["a123456x b123456y " * 4, "Die Stra\u00dfe \u4e16\u754c \u4e16\u754c", "b123456y a123456x", None, "a123456x", "a123456y", "\u4e16\u754c Stra\u00dfe"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = score_texts(docs, F.col("doc_id") >= 4).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(t["score"], plain_scores([(x or "").encode() for x in texts], [i < 4 for i in range(7)]), rtol=1e-5)
    assert t.loc[4, "score"] > t.loc[5, "score"] + 0.5


def test_top_k_keeps_every_finite_vector(spark):
    """Large and huge components, sums that pass 2^63 on the way and come back, -0.5 and zeros; null, NaN and infinite ones take no part."""
    big = [[70000.0, 1.0], [1e5, -1e5], [65537.0, 65537.0], [1e12, -1e12], [1e12, 1e12], [-1e12, 3.0], [3e38, 1.0], [-3e38, 2.0], [1e300, 0.0], [2e300, -5.0]]
    small = [[0.25, -0.5], [0.0, 0.0], [1.0, 1.0], [0.001, -0.001], [5.0]]
    out = [[nan, 1.0], [inf, 0.0], [-inf, 1.0], [None, 2.0], None]
    vectors = list(enumerate(big + small + out))
    found = top_k(integer_rows(spark.createDataFrame(vectors, "v long, e array<double>"), "v", "e"), F.col("id") >= 0, 4).collect()
    whole = {i: [floor(x * 256.0) for x in v] for i, v in vectors if v is not None and all(x is not None and isfinite(x) for x in v)}
    want = {}
    for i, q in whole.items():
        best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole.items() if j != i)[:4]
        want |= {(i, r): (j, -s if -(2**63) <= -s < 2**63 else None) for r, (s, j) in enumerate(best, 1)}
    assert len(whole) == 15
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in found} == want


def test_fingerprints_of_long_texts(spark):
    """Thirty thousand distinct terms each, all in the lexicon, and the last quarter replaced: some of the sparsest subsets still agree, of other texts none."""
    terms = [[f"{c}{i}" for i in range(30000)] for c in "vw"]
    texts = [" ".join(x) for x in (terms[0], terms[1], terms[0][::-1], terms[1][::-1])]
    t = compare_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").sort_index()
    assert t.loc[0, "fingerprint"] == t.loc[2, "fingerprint"] and t.loc[1, "fingerprint"] == t.loc[3, "fingerprint"]
    assert (t["near_edited"] > 0.2).all() and (t["near_next"] == 0).all()


def test_fingerprint_bits_differ_between_chains(spark):
    """However many halvings: no two chains share all their subsets."""
    d = spark.createDataFrame([(" ".join(f"x{i}" for i in range(200)),)], "text string")
    f = d.select(fingerprint(F.col("text"), F.array_repeat(F.lit(-1).cast("long"), 64), 12, 20).alias("f")).first()["f"]
    chains = [tuple(f[1 + 20 * c : 21 + 20 * c]) for c in range(12)]
    assert len(f) == 241 and len(set(chains)) == 12 and all(x[0] is not None and x[19] is None for x in chains)


def test_mixing_targets_by_plain_sharing(spark):
    """150 % of all sizes, shared 5, 2, 1 by the order of sources; what is above twice a source is shared again, until nothing is."""
    rows = [(i, "w " * (1 + i % 7), None if i % 9 == 8 else f"s{min(i % 9, 6)}") for i in range(400)] + [(1000, "w " * 9000, "s1"), (1001, None, "empty")]
    t = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    size: dict = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, going = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set(names)
    while going:
        level = left / sum(weight[s] for s in going)
        full = {s for s in going if level * weight[s] > 2 * size[s]}
        for s in full or going:
            target[s] = 2.0 * size[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        going = going - full if full else set()
    for s, g in t.groupby(t["source"].fillna("none")):
        name = None if s == "none" else s
        assert np.isclose(g["target"], target[name]).all() and abs(g["taken"].sum() - target[name]) <= 1 and (g["source_size"] == size[name]).all()
