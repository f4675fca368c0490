"""Removal of repeated passages: difference-cover anchors, then extension to whole windows.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller doc_id. To find shared windows, only shorter anchors are compared, and only at positions that lie,
modulo a period, in a difference cover: for any two positions there is a shift below the period that
brings both into the cover, so two equal windows share an anchor at the same place within them. Windows around anchors
that occur in one document alone are not shared; the others are compared as wholes, by 64-bit hashes of their words and places: two different
ones among n windows that hold a shared anchor agree with a chance of at most n^2 / 2^65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandflow.llm._exchange import ASK, all_bits, answered, bits, by_block, in_blocks, merged, questions
from strandflow.llm._words import Texts, read_words, window_hashes, windows_inside

U = np.uint64
LAST = np.iinfo(np.int64).max
#: Perfect difference sets, period to cover. Every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least about half the window (and seven words, if the window has as many)."""
    fit = [p for p in COVERS if window - p + 1 >= max(min(7, window), window // 3)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _anchors(t: Texts, width: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of words in t) and hashes of the anchors."""
    inside = windows_inside(t.words, width, len(t.hashes))
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, U)
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True
    place = np.arange(len(t.hashes)) - np.repeat(t.words[:-1], np.diff(t.words))
    at = np.flatnonzero(inside & chosen[place[: len(inside)] % period])
    return at, window_hashes(t.hashes, width, 1)[at]


def _distinct(keys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the least rank of each, and whether it has several ranks."""
    if not len(keys):
        return keys, rank, np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k, r = keys[order], rank[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    low, high = np.minimum.reduceat(r, first), np.maximum.reduceat(r, first)
    return k[first], low, low != high


class _Plan:
    """The passes over a block. They agree on its keys, for these are sorted and do not depend on the order of rows."""

    def __init__(self, window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.period, self.cover = cover_for(window)
        self.width = window - self.period + 1

    def ranks(self, rows: pa.Table) -> np.ndarray:
        """Documents by id; one without an id comes after all others."""
        return rows["doc_id"].combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)

    def anchors(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
        rank, texts, keys, ranks = self.ranks(rows), [], [], []
        for t in read_words(rows["text"]):
            at, h = _anchors(t, self.width, self.period, self.cover)
            texts.append((t, at, h))
            keys.append(h)
            ranks.append(rank[t.first + t.row_of_word()[at]] if len(at) else np.zeros(0, np.int64))
        keys, _, several = _distinct(np.concatenate(keys), np.concatenate(ranks))
        return keys, several, texts

    def ask_anchors(self, block: int, rows: pa.Table, _):
        keys, several, _ = self.anchors(rows)
        yield questions(block, keys, self.buckets, several.view(np.uint8), width=4)

    @staticmethod
    def shared_anchors(bodies: list[bytes]) -> list[bytes]:
        at, (keys, several) = merged(bodies, np.uint32, np.uint8)
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = (np.bincount(inverse, several, len(count)) + count > 1)[inverse]
        return [bits(shared[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]

    def windows(self, rows: pa.Table, reply: pa.Table):
        """The windows around shared anchors: sorted distinct hashes with ranks, and for each text its windows' first words, hashes and ranks."""
        keys, _, texts = self.anchors(rows)
        shared = keys[all_bits(reply, 0)]
        rank, found = self.ranks(rows), []
        for t, at, h in texts:
            hit = np.zeros(len(t.hashes) + 1, np.int64)
            if len(shared):
                hit[at[shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h]] = 1
            inside = windows_inside(t.words, self.window, len(t.hashes))
            # A window holds anchors that start in its first `period` words.
            total = np.append(0, np.cumsum(hit))
            n = len(inside)
            first = np.flatnonzero(inside & (total[np.minimum(np.arange(n) + self.period, len(total) - 1)] > total[:n])) if n else np.zeros(0, np.int64)
            whole = window_hashes(t.hashes, self.window, 2)[first] if n else np.zeros(0, U)
            found.append((t, first, whole, rank[t.first + t.row_of_word()[first]] if len(first) else np.zeros(0, np.int64)))
        return *_distinct(np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])), found

    def ask_windows(self, block: int, rows: pa.Table, reply: pa.Table):
        keys, low, _, _ = self.windows(rows, reply)
        yield questions(block, keys, self.buckets, low)

    @staticmethod
    def earlier_windows(bodies: list[bytes]) -> list[bytes]:
        """Whether a window occurs elsewhere in a document before all those of the block."""
        at, (keys, low) = merged(bodies, U, np.int64)
        _, inverse = np.unique(keys, return_inverse=True)
        least = np.full(int(inverse.max(initial=-1)) + 1, LAST)
        np.minimum.at(least, inverse, low)
        earlier = least[inverse] < low
        return [bits(earlier[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]

    def covered(self, rows: pa.Table, reply: pa.Table):
        """For each text: a flag a word, whether it goes."""
        keys, low, _, found = self.windows(rows, reply)
        earlier = all_bits(reply, 1)
        for t, first, whole, rank in found:
            at = np.searchsorted(keys, whole)
            gone = first[earlier[at] | (low[at] < rank)] if len(first) else first
            edge = np.zeros(len(t.hashes) + self.window + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + self.window, -1)
            yield t, np.cumsum(edge)[: len(t.hashes)] > 0


def _rounds(docs: DataFrame, window: int, columns: list[str]):
    """Blocks of documents, and all answers to them."""
    blocks, n = in_blocks(docs, *columns)
    plan = _Plan(window, n)
    first = answered(by_block(blocks, None, plan.ask_anchors, ASK), 0, plan.shared_anchors)
    second = answered(by_block(blocks, first, plan.ask_windows, ASK), 1, plan.earlier_windows)
    return blocks, plan, first.unionByName(second)


def repeated_words(docs: DataFrame, window: int = 13) -> DataFrame:
    """A row a document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Null and empty texts have no words. A document without an id counts as later than every other; two such documents are not
    before each other. Rows with the same id count as one document when windows are compared, each keeps its own text and row.
    A text of fewer words than a window keeps all. An empty table gives an empty result; other columns are ignored.
    """
    blocks, plan, told = _rounds(docs, window, ["doc_id", "text"])

    def digest(_, rows, reply):
        n_words, n_removed, sha = [], [], []
        for t, gone in plan.covered(rows, reply):
            for i in range(len(t)):
                g = gone[t.words[i] : t.words[i + 1]]
                n_words.append(len(g))
                n_removed.append(int(g.sum()))
                sha.append(hashlib.sha256(t.kept_text(i, ~g if n_removed[-1] else None)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [rows["doc_id"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return by_block(blocks, told, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs (doc_id, text, and any other columns) with repeated passages cut out of text.

    White space around what is kept stays as it is in the text: only removed words go, with the white space after them. Texts
    without a removed word are unchanged, null stays null; n_chars, if there is such a column, follows the new text. See
    ``repeated_words`` for null ids, repeated rows and short texts.
    """
    columns = docs.columns
    blocks, plan, told = _rounds(docs, window, columns)

    def cut(_, rows, reply):
        out = []
        for t, gone in plan.covered(rows, reply):
            for i in range(len(t)):
                lo, hi = t.words[i], t.words[i + 1]
                g = gone[lo:hi]
                if not g.any():
                    out.append(None)
                    continue
                a, b = t.offsets[i], t.offsets[i + 1]
                begin, end = t.starts[lo:hi], np.append(t.starts[lo + 1 : hi], b)
                edge = np.flatnonzero(np.diff(np.concatenate(([1], g.view(np.int8), [1]))))
                kept = [t.buf[begin[x] : end[y - 1]].tobytes() for x, y in zip(edge[::2], edge[1::2], strict=True)]
                out.append((t.buf[a : begin[0]].tobytes() if kept and not g[0] else b"") + b"".join(kept))
        texts = rows["text"].to_pylist()
        new = pa.array([x if y is None else y.decode() for x, y in zip(texts, out, strict=True)], rows["text"].type)
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", new)
        if "n_chars" in columns:
            import pyarrow.compute as pc

            changed = pa.array([y is not None for y in out])
            n = pc.if_else(changed, pc.utf8_length(new).cast(rows["n_chars"].type), rows["n_chars"])
            rows = rows.set_column(rows.schema.get_field_index("n_chars"), "n_chars", n)
        yield from rows.to_batches()

    return by_block(blocks, told, cut, docs.schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: DuckDB: every window as a list of words, its first document, and the words that a window of an earlier document covers.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM d WHERE len(ws) >= 13
), h AS (
  SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS win FROM w
), f AS (
  SELECT win, min(doc_id) AS first_doc FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT h.doc_id, h.p + o AS pos FROM h JOIN f USING (win), range(0, 13) AS r(o) WHERE f.first_doc < h.doc_id
), g AS (
  SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws
    ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
