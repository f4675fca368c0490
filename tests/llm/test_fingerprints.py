"""Fingerprints and likenesses against a plain version with the hashes of Spark's functions written out."""

import re
from collections import Counter

import numpy as np
import xxhash

from strandflow.llm import fingerprints as f

MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1


def xx(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64(data, seed=seed & MASK64).intdigest()


def murmur(terms: list[int]) -> int:
    """Spark's hash of an array of longs: each is two words of 32 bits, and the seed of the next."""
    h = 42
    for t in terms:
        for k in (t & MASK32, t >> 32):
            k = k * 0xCC9E2D51 & MASK32
            k = (k << 15 | k >> 17) & MASK32
            h ^= k * 0x1B873593 & MASK32
            h = (h << 13 | h >> 19) & MASK32
            h = h * 5 + 0xE6546B64 & MASK32
        h ^= 8
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> shift) * factor & MASK32
    return h - (1 << 32) if h >> 31 else h


def signed(t: int) -> int:
    return t - (1 << 64) if t >> 63 else t


class Plain:
    def __init__(self, texts: list[str]):
        n = len(texts)
        df = Counter(t for x in texts for t in self.terms(x))
        chosen = [t for t, c in df.items() if max(2.0, f.BAND[0] * n) <= c <= max(2.0, f.BAND[1] * n)]
        self.log2 = min(f.MOST_LOG2, max(12, (max(1, len(chosen)) * f.BITS_PER_TERM - 1).bit_length()))
        self.bits = {t >> (64 - self.log2) for t in chosen}
        self.depth = max(f.HALVINGS, ((max(map(len, texts)) + 1) // 2).bit_length())

    @staticmethod
    def terms(text: str) -> list[int]:
        return list({xx(w.encode()) for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w})

    def fingerprint(self, text: str) -> list[int | None]:
        every = self.terms(text)
        own = [t for t in every if t >> (64 - self.log2) in self.bits]
        terms = sorted(own if len(own) >= f.LEAST_TERMS else every, key=signed)
        out = [murmur(terms) if terms else None]
        for c in range(f.CHAINS):
            kept = terms if c < f.HALF else [xx(t.to_bytes(8, "little")) for t in terms]
            for d in range(f.HALVINGS):
                kept = [t for t in kept if not t >> (f.HALVINGS * (c % f.HALF) + d) & 1]
                out.append(murmur(kept) if kept else None)
            for d in range(self.depth - f.HALVINGS):
                far = [t for t in kept if not xx(c.to_bytes(4, "little"), xx(t.to_bytes(8, "little"))) & (2 << d) - 1]
                out.append(murmur(far) if far else None)
        return out

    def tips(self, found: list[int | None]) -> list:
        chains = [found[1 + c * self.depth : 1 + (c + 1) * self.depth] for c in range(f.CHAINS)]
        return [max(((d, x) for d, x in enumerate(chain, 1) if x is not None), default=(0, found[0])) for chain in chains]

    def likeness(self, a: list[int | None], b: list[int | None]) -> float:
        return sum(x == y for x, y in zip(self.tips(a), self.tips(b), strict=True)) / f.CHAINS


def test_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    words = [f"Word{i}" for i in range(120)] + ["ein", "Straße", "世界"]
    texts = [" ".join(rng.choice(words, n)) for n in (3, 8, 40, 90, 200, 40, 60, 5000, 12, 30)] + ["", "one", "a\tb\n\x0bc  d", "only here"]
    texts.append(texts[3])
    rows = list(enumerate(texts))
    t = f.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").sort_index()
    plain = Plain(texts)
    own = [plain.fingerprint(x) for x in texts]
    assert plain.depth > f.HALVINGS and t["fingerprint"].tolist() == [".".join("-" if h is None else str(h) for h in x) for x in own]
    for i, text in rows:
        after = (i + 1) % len(texts)
        edited = plain.fingerprint(text[: len(text) - len(text) // 4] + texts[after][: len(text) // 4])
        assert np.isclose(t.loc[i, "near_next"], plain.likeness(own[i], own[after])) and np.isclose(t.loc[i, "near_edited"], plain.likeness(own[i], edited))
