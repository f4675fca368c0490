"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions. For each context of the last 0 to DEPTH bytes and each place in a byte, a node counts zeros and
ones over the training texts; its Krichevsky-Trofimov estimate is weighted against the product of its children's (contexts one byte longer), so all
depths are mixed. Texts are scored with the final counts and weights.

The tree is cut below its second level: the nodes of contexts that end in the same two bytes lie in one bucket. What lies above, 65,535 nodes
at most, is summed from all buckets and sent back to them. Blocks of documents send each distinct context and byte once, and get its code length, to
16 significant bits. Word counts for the unigram base travel in the same way. A bucket's part of the model is one row that also holds what the bucket was
asked, so that scoring needs no second shuffle of the questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from strandflow.llm._exchange import ANSWER, answers, by_block, in_blocks, merged, questions
from strandflow.llm._store import give_back, new_dir, write
from strandflow.llm._words import PIECE, byte_rows, distinct, mix64, numbered, read_words

U = np.uint64
DEPTH = 7  # a key fills 64 bits: two bytes spread, DEPTH - 2 older ones, the byte itself
#: Bytes of text of a block, about. Half as large blocks ask about a third more keys in all.
BLOCK_BYTES = 8 << 20
END = mix64(np.array([0xE0D], U))[0]  # the end of a text, as a word
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The last two bytes of a context are spread over the buckets by multiplication with an odd number.
_SPREAD, _GATHER = 40503, pow(40503, -1, 1 << 16)
_PLACE = U(8 * (DEPTH - 1))  # of the two last bytes in a key


def _keys(text: np.ndarray) -> np.ndarray:
    """Keys of all bytes of text but its first DEPTH: the spread last two bytes, older ones, the byte itself."""
    b = text.astype(U)
    n = len(b) - DEPTH
    recent = (b[DEPTH - 1 : DEPTH - 1 + n] << U(8)) | b[DEPTH - 2 : DEPTH - 2 + n]
    key = (recent * U(_SPREAD)) & U(0xFFFF)
    for k in range(3, DEPTH + 1):
        key = (key << U(8)) | b[DEPTH - k : DEPTH - k + n]
    return (key << U(8)) | b[DEPTH:]


#: The key of an empty text. Every block asks about it, for rows without text have no fixed block.
EMPTY = _keys(np.zeros(DEPTH + 1, np.uint8))


def byte_keys(column: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, keys, where each row's keys begin and end) some rows or a piece of a long row at a time. A text is
    preceded by DEPTH and ended by one zero byte; A-Z count as a-z."""
    buf, offsets = byte_rows(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        length = np.diff(offsets[i : j + 1])
        if j == i + 1 and length[0] > PIECE:
            for at in range(0, int(length[0]) + 1, PIECE):
                lo, hi = offsets[i] + max(0, at - DEPTH), offsets[i] + min(at + PIECE, int(length[0]) + 1)
                part = _FOLD[buf[lo : min(hi, offsets[i + 1])]]
                text = np.concatenate([np.zeros(max(0, DEPTH - at), np.uint8), part, np.zeros(int(hi > offsets[i + 1]), np.uint8)])
                yield i, _keys(text), np.array([0, len(text) - DEPTH])
        else:
            begin = np.cumsum(length + DEPTH + 1) - length - 1
            text = np.zeros(int((length + DEPTH + 1).sum()), np.uint8)
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
            text[at] = _FOLD[buf[offsets[i] : offsets[j]]]
            keys = _keys(text)
            own = np.ones(len(keys), bool)
            # A key stands DEPTH before its byte in text; the zeros before later rows have keys that belong to none.
            own[(begin[1:, None] - 2 * DEPTH + np.arange(DEPTH)).ravel()] = False
            yield i, keys[own], np.append(0, np.cumsum(length + 1))
        i = j


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    k = np.concatenate([p[0] for p in parts] or [np.zeros(0, U)])
    c = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c, first)


def packed(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted distinct keys, with counts or without, as a tree: of each key only the bytes from the first one on that differs from the key before, level by level, with a bit that
    tells where a new parent begins; counts byte by byte. All compressed."""
    differ = keys[1:] ^ keys[:-1]
    levels, bits, above = [], [], None
    for d in range(8):
        new = np.append(True, (differ >> U(8 * (7 - d))) != 0) if len(keys) else np.zeros(0, bool)
        levels.append((keys[new] >> U(8 * (7 - d))).astype(np.uint8))
        if above is not None:
            bits.append(np.packbits(above[new]))
        above = new
    planes = np.zeros((0, len(keys)), np.uint8)
    if counts is not None:
        kind = np.uint32 if counts.max(initial=0) < 1 << 32 else U
        planes = counts.astype(kind).view(np.uint8).reshape(len(keys), kind().itemsize).T
    head = np.array([planes.shape[0], *map(len, levels)], np.int64)
    raw = b"".join(x.tobytes() for x in (head, *levels, *bits, planes))
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    raw = np.frombuffer(_plain(body), np.uint8)
    width, *sizes = raw[:72].view(np.int64).tolist()
    at, keys, levels = 72, np.zeros(1, U), []
    for n in sizes:
        levels.append(raw[at : at + n])
        at += n
    for d, n in enumerate(sizes):
        if d:
            size = (n + 7) // 8
            keys = keys[np.cumsum(np.unpackbits(raw[at : at + size], count=n)) - 1] if n else np.zeros(0, U)
            at += size
        keys = (keys << U(8)) | levels[d] if d else levels[0].astype(U)
    planes = raw[at : at + width * sizes[-1]].reshape(width, sizes[-1])
    if not width:
        return keys, None
    return keys, np.ascontiguousarray(planes.T).view(np.uint32 if width == 4 else U).ravel()


def _plain(body: bytes) -> bytes:
    return pa.decompress(memoryview(body)[8:], int(np.frombuffer(body, np.int64, 1)[0]), "zstd", asbytes=True)


def _packed_codes(code: np.ndarray) -> bytes:
    """Numbers of 32 bits, rounded to 16 significant ones, byte by byte and compressed."""
    rounded = (code.view(np.uint32) + np.uint32(128)) >> np.uint32(8)
    raw = rounded.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _codes(reply: pa.Table) -> np.ndarray:
    """A block's code lengths in the order of its keys."""
    t = reply.select(["bucket", "kind", "body"]).to_pydict()
    found = sorted((b, x) for b, k, x in zip(t["bucket"], t["kind"], t["body"], strict=True) if k == 1)
    return np.concatenate([_opened_codes(x) for _, x in found])


def _opened_codes(body: bytes) -> np.ndarray:
    planes = np.frombuffer(_plain(body), np.uint8).reshape(3, -1)
    raw = np.zeros((planes.shape[1], 4), np.uint8)
    raw[:, 1:] = planes.T
    return raw.view(np.float32).ravel()


def _key_questions(block: int, keys: np.ndarray, n: int, counts: np.ndarray) -> pa.RecordBatch:
    edges = np.array([-(-(b << 16) // n) for b in range(n)], U) << _PLACE
    cut = np.append(np.searchsorted(keys, edges), len(keys))
    rows = [b for b in range(n) if cut[b] < cut[b + 1]]
    bodies = [packed(keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]) for b in rows]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "block", "body"])


#: Kinds of rows: of questions the first two, of what buckets learn all: answers about words; sums over words; sums for depth 1; parts of the model with what was asked.
WORDS, KEYS, TOTALS, NODES = range(4)
_ASKED = "kind int, bucket int, block int, body binary"
_LEARNED = "kind int, bucket int, block int, node int, n0 double, n1 double, below double, body binary, blocks array<int>, bodies array<binary>"
_TYPES = {
    "kind": pa.int32(), "bucket": pa.int32(), "block": pa.int32(), "node": pa.int32(), "n0": pa.float64(), "n1": pa.float64(), "below": pa.float64(), "body": pa.binary(),
    "blocks": pa.list_(pa.int32()), "bodies": pa.list_(pa.binary()),
}


def _of_kind(kind: int, asked: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(asked.num_rows, kind, np.int32)), *asked.columns], names=["kind", *asked.schema.names])


def _learned(kind: int, bucket: int, n: int, **columns) -> pa.Table:
    columns |= {"kind": np.full(n, kind, np.int32), "bucket": np.full(n, bucket, np.int32)}
    return pa.Table.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()], names=list(_TYPES))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift to x + 8; exact to about 1e-13."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k) if k else x.astype(float)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


#: Log-gamma at k + 1/2 and k + 1 for counts k below this.
_SMALL = 1 << 12
_HALVES, _WHOLES = (_log_gamma(np.arange(_SMALL) + x) for x in (0.5, 1.0))


def _of_count(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    large = np.flatnonzero(n >= _SMALL)
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    if len(large):
        out[large] = _log_gamma(n[large] + more)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any order of a zeros and b ones (whole numbers)."""
    return _of_count(a, _HALVES, 0.5) + _of_count(b, _HALVES, 0.5) - _of_count(a + b, _WHOLES, 1.0) - 1.1447298858494002


def _mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior weight of nodes' own estimates against their children's, and the log of the even mixture of both."""
    e = np.exp(-np.abs(own - below))
    return np.where(own >= below, 1.0, e) / (1 + e), np.maximum(own, below) + np.log1p(e) - 0.6931471805599453


def _subtrees(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each place in a byte: rows' order, first bytes of contexts, nodes, bits, probabilities of depth 2 and more; and the sums for depth 1.

    keys: all contexts that end in the same two bytes, or in none of them.
    """
    symbol = (keys & U(255)).astype(np.int64)
    context = keys >> U(8)
    last = ((context >> U(8 * (DEPTH - 2))) * U(_GATHER) & U(0xFFFF)).astype(np.int64) >> 8
    for place in range(8):
        prefix = (symbol >> (8 - place)).astype(np.uint8)
        order = np.argsort(prefix, kind="stable")
        p, c, ctx = prefix[order], counts[order].astype(float), context[order]
        bit = (symbol[order] >> (7 - place)) & 1 == 1
        # Up the tree: nodes of each depth from those below it. Rows are in the order of prefix and context.
        new = np.append(True, (p[1:] != p[:-1]) | (ctx[1:] != ctx[:-1]))
        first = np.flatnonzero(new)
        row_node = np.cumsum(new) - 1
        n1 = np.add.reduceat(np.where(bit, c, 0.0), first)
        n0 = np.add.reduceat(c, first) - n1
        p, ctx = p[first], ctx[first]
        weighted = log_kt(n0, n1)
        levels = [(None, (n1 + 0.5) / (n0 + n1 + 1), None)]  # weight, probability of a one, and the parent of each node below
        for d in range(DEPTH - 1, 1, -1):
            part = ctx >> U(8 * (DEPTH - d))
            new = np.append(True, (p[1:] != p[:-1]) | (part[1:] != part[:-1]))
            first = np.flatnonzero(new)
            n0, n1, below = np.add.reduceat(n0, first), np.add.reduceat(n1, first), np.add.reduceat(weighted, first)
            weight, weighted = _mixed(log_kt(n0, n1), below)
            levels.append((weight, (n1 + 0.5) / (n0 + n1 + 1), np.cumsum(new) - 1))
            p, ctx = p[first], ctx[first]
        # Down again: what stops above a node gives so much to a one, and leaves so much to the node.
        one, left = 0.0, 1.0
        for w, kt, parent in levels[:0:-1]:
            one, left = (one + left * w * kt)[parent], (left * (1 - w))[parent]
        one = one + left * levels[0][1]
        q = np.where(bit, one[row_node], 1 - one[row_node])
        node = (1 << place) + prefix[order].astype(np.int64)
        top = (1 << place) + p.astype(np.int64)
        last2 = ((ctx >> U(8 * (DEPTH - 2))) * U(_GATHER) & U(0xFFFF)).astype(np.int64) >> 8
        yield order, last[order], node, bit, q, (last2 * 256 + top, n0, n1, weighted)


class _Top:
    """Depths 0 and 1: for each last byte and node, the weight and estimates of depth 1; for each node those of depth 0."""

    def __init__(self, rows: list):
        n0, n1, below = (np.zeros(65536) for _ in range(3))
        if rows:
            at = np.array([r[0] for r in rows])
            n0[at], n1[at], below[at] = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
        self.weight1, weighted = _mixed(log_kt(n0, n1), below)
        self.one1 = (n1 + 0.5) / (n0 + n1 + 1)
        n0, n1, below = (x.reshape(256, 256).sum(0) for x in (n0, n1, weighted))
        self.weight0, _ = _mixed(log_kt(n0, n1), below)
        self.one0 = (n1 + 0.5) / (n0 + n1 + 1)

    def log10(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for order, last, node, bit, q, _ in _subtrees(keys, counts):
            at = last * 256 + node
            one = np.where(bit, self.one1[at], 1 - self.one1[at])
            q = self.weight1[at] * one + (1 - self.weight1[at]) * q
            one = np.where(bit, self.one0[node], 1 - self.one0[node])
            out[order] += np.log10(self.weight0[node] * one + (1 - self.weight0[node]) * q)
        return out


#: Keys of a bucket that are worked on at once, about.
SLICE = 400_000


def _slices(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (from, to) of ranges of the sorted keys, cut where the contexts' last two bytes change."""
    place = keys >> _PLACE
    new = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    at = 0
    while at < len(keys):
        to = int(new[max(np.searchsorted(new, at + SLICE, "right") - 1, np.searchsorted(new, at, "right"))])
        yield keys[at], at, to
        at = to


def _grow(bucket: int, blocks: list[int], bodies: list[bytes]) -> Iterator[pa.Table]:
    """A bucket's part of the model, its keys with their counts in training texts, next to the keys of all questions; and its sums for depth 1."""
    parts, asked = [], []
    for body in bodies:
        keys, counts = unpacked(body)
        asked.append(packed(keys))
        seen = counts > 0
        parts.append((keys[seen], counts[seen].astype(np.int64)))
        if len(parts) > 16:
            parts = [_counted(parts)]
    keys, counts = _counted(parts)
    del parts
    sums = []
    for _, i, j in _slices(keys):
        found = [x for *_, x in _subtrees(keys[i:j], counts[i:j])]
        node, *values = (np.concatenate([x[k] for x in found]) for k in range(4))
        at, inverse = np.unique(node, return_inverse=True)
        sums.append((at, *(np.bincount(inverse, x, len(at)) for x in values)))
    at, n0, n1, below = (np.concatenate([x[k] for x in sums] or [np.zeros(0)]) for k in range(4))
    yield _learned(NODES, bucket, len(at), node=at.astype(np.int32), n0=n0, n1=n1, below=below)
    yield _learned(KEYS, bucket, 1, body=[packed(keys, counts)], blocks=[blocks], bodies=[asked])


def _scored(top: _Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                known, counts = unpacked(b["body"][row].as_py())
                wanted = [unpacked(x)[0] for x in b["bodies"][row].as_py()]
                keys = distinct(np.concatenate([known, *wanted]))
                n = np.zeros(len(keys))
                n[np.searchsorted(keys, known)] = counts
                value = np.zeros(len(keys), np.float32)
                for _, i, j in _slices(keys):
                    value[i:j] = top.log10(keys[i:j], n[i:j])
                bodies = [_packed_codes(value[np.searchsorted(keys, k)]) for k in wanted]
                del known, counts, wanted, keys, n, value
                give_back()
                m = len(bodies)
                columns = [pa.array(b["blocks"][row].as_py(), pa.int32()), pa.array([b["bucket"][row].as_py()] * m, pa.int32()), pa.array([1] * m, pa.int32()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "kind", "body"])

    return run


def _word_keys(rows: pa.Table, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a block (and the end) with their counts in training texts."""
    parts = [(np.array([END]), np.array([int(learn.sum())]))]
    for t in read_words(rows["text"], fold=True):
        trained = learn[t.first + t.row_of_word()]
        keys, inverse = np.unique(t.hashes, return_inverse=True)
        parts.append((keys, np.bincount(inverse, trained, len(keys)).astype(np.int64)))
    return _counted(parts)


def _word_totals(bucket: int, blocks: list[int], bodies: list[bytes]) -> Iterator[pa.Table]:
    """Answers with words' training counts, and the bucket's sums: words in training texts, distinct ones."""
    at, (keys, n) = merged(bodies, U, np.uint32)
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, n)
    c = total[inverse].astype(np.int64)
    yield _learned(WORDS, bucket, len(blocks), block=blocks, body=[c[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)])
    yield _learned(TOTALS, bucket, 1, body=[np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()])


def _bucket(table: pa.Table) -> pa.Table:
    """All that a bucket learns from the questions that reach it."""
    bucket, kind, out = table["bucket"][0].as_py(), table["kind"].to_numpy(), []
    for k, learn in ((WORDS, _word_totals), (KEYS, _grow)):
        own = table.take(pa.array(np.flatnonzero(kind == k)))
        if own.num_rows:
            out += learn(bucket, own["block"].to_pylist(), own["body"].to_pylist())
    give_back()
    return pa.concat_tables(out)


def _learn(rows: pa.Table) -> np.ndarray:
    return ~rows["held_out"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    held_out: a Column, true for documents that are not learned from (null counts as true). Null texts are empty: one end, which is a token.
    Any bytes are scored, also zeros. Repeated rows are rows of their own and count as often as they are there. An empty table gives an empty
    result. Without any training text all tokens are unknown and every bit costs one bit. Other columns are ignored.
    """
    d = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    blocks, n = in_blocks(d, "doc_id", "text", "held_out", sent=3.0, size=BLOCK_BYTES)

    def ask(block: int, rows: pa.Table, _):
        """Every word and every key of the block with its count in training texts."""
        learn = _learn(rows)
        keys, counts = _word_keys(rows, learn)
        yield _of_kind(WORDS, questions(block, keys, n, counts.astype(np.uint32)))
        parts = [(EMPTY, np.zeros(1, np.int64))]
        for first, keys, at in byte_keys(rows["text"]):
            own, number = numbered(keys)
            parts.append((own, np.bincount(number, np.repeat(learn[first : first + len(at) - 1], np.diff(at)), len(own)).astype(np.int64)))
            if len(parts) > 4:
                parts = [_counted(parts)]
        keys, counts = _counted(parts)
        del parts
        yield _of_kind(KEYS, _key_questions(block, keys, n, counts))

    spark, path = docs.sparkSession, new_dir(docs.sparkSession, "model")
    write(by_block(blocks, None, ask, _ASKED).groupBy("bucket").applyInArrow(_bucket, _LEARNED), path, "kind")
    model = spark.read.schema(_LEARNED).parquet(path)
    stats = model.where(F.col("kind") == TOTALS).select("body").toArrow()["body"].to_pylist()
    train_tokens, train_words = (int(x) for x in np.sum([np.frombuffer(b, np.int64) for b in stats] or [[0, 0]], axis=0))
    rows = model.where(F.col("kind") == NODES).groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect()
    top = _Top(rows)
    told = model.where(F.col("kind") == WORDS).select("block", "bucket", F.lit(0).alias("kind"), "body")
    told = told.unionByName(model.where(F.col("kind") == KEYS).select("bucket", "body", "blocks", "bodies").mapInArrow(_scored(top), ANSWER))
    floor = np.log10(train_tokens + 0.1 * (train_words + 1)) if train_tokens else np.log10(0.1)

    def tell(_, rows: pa.Table, reply: pa.Table):
        m = rows.num_rows
        known = np.frombuffer(answers(reply, 0), np.int64)
        keys = _word_keys(rows, np.zeros(m, bool))[0]
        value = np.log10(known + 0.1) - floor
        end = int(np.searchsorted(keys, END))
        base, n_known, n_tokens = np.full(m, value[end]), np.full(m, int(known[end] > 0)), np.ones(m, np.int64)
        for t in read_words(rows["text"], fold=True):
            own, at = numbered(t.hashes)
            at, row = np.searchsorted(keys, own)[at], t.first + t.row_of_word()
            base += np.bincount(row, value[at], m)
            n_known += np.bincount(row, known[at] > 0, m).astype(np.int64)
            n_tokens += np.bincount(row, minlength=m)
        pieces = [(first, *numbered(k), at) for first, k, at in byte_keys(rows["text"])]
        keys = distinct(np.concatenate([EMPTY, *(own for _, own, _, _ in pieces)]))
        code = _codes(reply)
        score, size = np.zeros(m), np.zeros(m, np.int64)
        for first, own, number, at in pieces:
            total = np.add.reduceat(code[np.searchsorted(keys, own)][number].astype(float), at[:-1])
            score[first : first + len(total)] += total
            size[first : first + len(total)] += np.diff(at)
        yield pa.RecordBatch.from_arrays(
            [rows["doc_id"].combine_chunks(), rows["held_out"].combine_chunks(), *(pa.array(x) for x in (n_tokens, n_known, np.full(m, train_tokens), base, score, size - 1, -score / np.log10(2) / size))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
        )

    return by_block(
        blocks, told, tell,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double",
    )


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
