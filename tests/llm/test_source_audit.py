"""Divergence of sources against a plain computation in Python's integers."""

import re
from collections import Counter, defaultdict

from strandflow.llm import source_audit
from tests.llm.test_edges import KINDS, LONG, ROWS

UNIT = 10**9


def plain(rows: list[tuple], least: int = 3, top: int = 200) -> set[tuple]:
    """rows: text, lang, source."""
    found = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")] for text, _, _ in rows]
    homes = [(lang or "", source or "") for _, lang, source in rows]
    held, count = defaultdict(Counter), defaultdict(Counter)
    for words, (lang, source) in zip(found, homes, strict=True):
        held[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang in {x for x, _ in homes}:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=str.encode)
        sources = sorted({s for x, s in homes if x == lang}, key=str.encode)

        def shares(c: Counter, kept=kept) -> list[int]:
            total = sum(c[t] for t in kept) + len(kept)
            return [1 + UNIT * (c[t] + 1) // total for t in kept]

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(a, b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            terms = [(-f(a, b), t.encode()) for a, b, t in zip(p[s], q, kept, strict=True) if count[lang, s][t] and a > b]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def got(df) -> set[tuple]:
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_edges(spark):
    """Nulls are '', repeated rows count each, groups without terms and languages without kept terms have their pairs, clashing names are not read."""
    more = [(20 + i, t, lang, s, 0) for i, (t, lang, s) in enumerate([
        ("Été été ÉTÉ x\0y a1b_c", "fr", "a"), ("été X y", "fr", "b"), ("x été c", "fr", "b"), ("", "fr", "c"), (None, "fr", "d"), ("été", "fr", None), ("one two", "xx", "p"), ("three", "xx", "q"), ("only", "yy", "p"), ("a B c", None, "b"), ("a b", "", "z"), ("A b", "", "z"),
    ])]
    docs = spark.createDataFrame([(*r, 5, "s", "l", 6, "x", "t") for r in ROWS + more], KINDS).withColumnsRenamed({"block": "term", "low": "shard", "score": "n", "toxic": "item"})
    want = plain([(r[1], r[2], r[3]) for r in ROWS + more])
    assert {("xx", "p", "pair", "q", 0, 1), ("xx", "q", "pair", "p", 0, 1)} <= want
    assert got(source_audit.audit(docs)) == want
    assert got(source_audit.audit(docs, least_docs=1, top=2)) == plain([(r[1], r[2], r[3]) for r in ROWS + more], 1, 2)
    assert source_audit.audit(spark.createDataFrame([], KINDS)).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    """Terms are neither cut nor counted twice as documents where a text is read in pieces and counts are sent on in between."""
    text = "".join(f"{'wort' * (i % 5)}é{i % 7} \n" for i in range(3000)) + "z" * 5000
    assert "".join(source_audit.pieces(text, 64)) == text and "".join(source_audit.pieces(LONG, 1000)) == LONG
    for name, value in (("READ_BYTES", 512), ("FLUSH_BYTES", 4096), ("SHARD_BYTES", 1 << 14)):
        monkeypatch.setattr(source_audit, name, value)
    rows = [(text, "de", "a"), (text[:9000], "de", "b"), ("é wortZ wort é", "de", "c"), ("wortz", "de", "a"), ("wortz", "de", "c"), (text[5000:], "de", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    list_of = list(source_audit._count(iter(docs.toArrow().to_batches())))  # in this process, with the small sizes
    docs_of = Counter()
    for b in list_of:
        for t, n in zip(b["term"].to_pylist(), b["docs"].to_pylist(), strict=True):
            docs_of[t] += n
    assert docs_of["wortz"] == 3 and docs_of["é"] == 4 and docs_of["wortwort" + "é"] == 3
    assert got(source_audit.audit(docs)) == plain(rows)
