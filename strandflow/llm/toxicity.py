"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows that its hash and the hashes of its first bytes choose from one table. Filters of
several widths run over the words; their largest responses over the whole text feed a logistic output. The table starts from each
row's shrunk log-odds among training texts, so that a few hundred labelled texts suffice. Logits of held-out folds calibrate
the score, and a decision threshold for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm._exchange import free_name
from strandflow.llm._words import Texts, hash_spans, mix64, read_words

U = np.uint64
ROWS_LOG2, DIM, FILTERS, WIDTHS = 17, 8, 8, (1, 2, 3)
STEMS = (4, 6, 8)  # first bytes of a word that are hashed besides the whole word
#: The classifier is fitted on at most so many labelled rows (those with the smallest hashes of their ids); its size is bounded, too.
FIT_ROWS = 8000
#: ... and on at most so many bytes of their texts, which go through the driver.
FIT_BYTES = 64 << 20
FOLDS, EPOCHS, BATCH, RATE = 3, 4, 32, 0.01


def word_rows(t: Texts) -> np.ndarray:
    """For each word the table rows of its whole and its stems."""
    spans = [t.ends, *(np.minimum(t.ends, t.starts + n) for n in STEMS)]
    out = np.empty((len(t.starts), len(spans)), np.int32)
    for i, ends in enumerate(spans):
        h = t.hashes if i == 0 else hash_spans(t.buf, t.starts, ends, True)
        out[:, i] = (mix64(h + U(i * 0x51ED270B + 1)) >> U(64 - ROWS_LOG2)).astype(np.int32)
    return out


def rows_of_texts(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, table rows of its and following texts' words, where each text's words begin)"""
    for t in read_words(column, fold=True):
        yield t.first, word_rows(t), t.words


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS each
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def responses(self, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filters' responses at every word, with the padded embeddings and the words' places in them."""
        gap = max(WIDTHS) - 1
        place = np.arange(len(rows)) + gap * np.repeat(np.arange(len(words) - 1), np.diff(words))
        x = np.zeros((len(rows) + gap * len(words), DIM), np.float32)
        x[place] = self.table[rows].sum(1)
        parts = []
        for f in self.filters:
            r = x[: len(x) - gap] @ f[0]
            for k in range(1, len(f)):
                r += x[k : len(x) - gap + k] @ f[k]
            parts.append(r[place])
        return np.concatenate(parts, 1) + self.bias, x, place

    def pooled(self, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Each text's largest responses, at least 0."""
        out = np.zeros((len(words) - 1, len(self.bias)), np.float32)
        filled = np.flatnonzero(np.diff(words))
        if len(filled):
            r, _, _ = self.responses(rows, words)
            out[filled] = np.maximum(np.maximum.reduceat(r, words[:-1][filled]), 0)
        return out

    def logits(self, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self.pooled(rows, words) @ self.out + self.out_bias

    def logits_of(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of many texts, some at a time."""
        out = [self.logits(*_packed(texts[i : i + BATCH])) for i in range(0, len(texts), BATCH)]
        return np.concatenate(out or [np.zeros(0)])

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


def _start(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Model:
    """A table of shrunk log-odds and small random numbers; the first filter of each width passes the log-odds on."""
    n = np.zeros((2, 1 << ROWS_LOG2), np.float32)
    for t, y in zip(texts, labels, strict=True):
        n[int(y), np.unique(t)] += 1
    of = np.bincount(labels.astype(int), minlength=2)
    odds = np.log((n[1] + 0.5) / (of[1] + 1)) - np.log((n[0] + 0.5) / (of[0] + 1))
    table = rng.normal(0, 0.02, (1 << ROWS_LOG2, DIM)).astype(np.float32)
    table[:, 0] = np.clip(odds, 0, 6) * (n[1] / (n[1] + 3)) / 4
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, 0] = 1
    out = rng.normal(0, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
    out[::FILTERS] = 1
    return Model(table, filters, np.zeros(len(out), np.float32), out, -2.0)


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Model:
    """texts: table rows of each text's words. Adam over mini-batches of the logistic loss, both classes weighted alike to a square root."""
    rng = np.random.default_rng(seed)
    m = _start(texts, labels, rng)
    share = max(labels.mean(), 1e-3) if len(labels) else 0.5
    weight = np.where(labels == 1, np.sqrt((1 - share) / share), 1.0)
    dense = [*m.filters, m.bias, m.out, np.array([m.out_bias], np.float32)]
    first, second, step = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], 0
    squares = np.full(1 << ROWS_LOG2, 0.1, np.float32)
    for _ in range(EPOCHS if len(labels) else 0):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = [i for i in order[at : at + BATCH] if len(texts[i])]
            if not pick:
                continue
            rows = np.concatenate([texts[i] for i in pick])
            words = np.cumsum([0, *(len(texts[i]) for i in pick)])
            r, x, place = m.responses(rows, words)
            top = np.stack([r[a:b].argmax(0) + a for a, b in zip(words[:-1], words[1:], strict=True)])
            value = np.take_along_axis(r, top, 0)
            z = np.maximum(value, 0) @ m.out + m.out_bias
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            back = np.where(value > 0, g[:, None] * m.out, 0)
            grads, dx, touched = [], [], []
            for i, f in enumerate(m.filters):
                b, t = back[:, i * FILTERS : (i + 1) * FILTERS], top[:, i * FILTERS : (i + 1) * FILTERS]
                gf = np.zeros_like(f)
                for k in range(len(f)):
                    seen = x[place[t] + k]
                    gf[k] = np.einsum("tfd,tf->df", seen, b)
                    inside = t + k < words[1:, None]
                    dx.append((b[:, :, None] * f[k].T[None])[inside])
                    touched.append((t + k)[inside])
                grads.append(gf)
            grads += [back.sum(0), np.maximum(value, 0).T @ g + 1e-4 * m.out, np.array([g.sum()], np.float32)]
            step += 1
            for p, gp, a, b in zip(dense, grads, first, second, strict=True):
                a += 0.1 * (gp - a)
                b += 0.001 * (gp * gp - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            m.out_bias = float(dense[-1][0])
            dx, touched = np.concatenate(dx), np.concatenate(touched)
            used = rows[touched].ravel()
            step_rows = np.repeat(dx, rows.shape[1], 0)
            np.add.at(squares, used, (step_rows**2).sum(1))
            np.add.at(m.table, used, -0.3 * RATE * step_rows / np.sqrt(squares[used])[:, None])
    return m


def _packed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts or [np.zeros((0, 1 + len(STEMS)), np.int32)]), np.cumsum([0, *(len(t) for t in texts)])


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit of labels on logits, by Newton steps, drawn to (1, 0) by a weak prior."""
    a = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a[0] * z + a[1], -40, 40)))
        x = np.stack([z, np.ones_like(z)])
        w = p * (1 - p)
        grad = x @ (p - y) + 0.5 * (a - [1.0, 0.0])
        a = a - np.linalg.solve((x * w) @ x.T + 0.5 * np.eye(2), grad)
        a[0] = max(a[0], 0.05)
    return float(a[0]), float(a[1])


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is best: midway in the gap there, between 0.5 and 0.9."""
    s = np.unique(score)
    cuts = (s[1:] + s[:-1]) / 2
    if not len(cuts) or not y.any():
        return 0.5
    f1 = [2 * ((score >= c) & (y == 1)).sum() / ((score >= c).sum() + y.sum()) for c in cuts]
    return float(np.clip(cuts[int(np.argmax(f1))], 0.5, 0.9))


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list, seed: int = 3) -> Model:
    """A model of all texts, calibrated on logits of FOLDS models that had not seen the text. Languages serve the thresholds alone.

    A language of fewer than 20 texts or 5 toxic ones has the common threshold. Without any toxic (or other) text the score stays low (or high).
    """
    y = np.asarray(labels, float)
    model = fit(texts, y, seed)
    if len(np.unique(y)) < 2:
        return model
    fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS
    z = np.zeros(len(y))
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own) and len(rest):
            z[own] = fit([texts[i] for i in rest], y[rest], seed + k + 1).logits_of([texts[i] for i in own])
    model.scale, model.shift = _calibrated(z, y)
    s = model.scores(z)
    model.threshold = _threshold(s, y)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if own.sum() >= 20 and y[own].sum() >= 5:
            model.thresholds[lang] = _threshold(s[own], y[own])
    return model


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Fit on docs (doc_id, text, lang) with labels (doc_id, toxic 0 or 1; others are not used), on at most ``rows`` labels: those with the smallest hashes.

    That bound also bounds what is broadcast to the documents. Their texts reach the driver, in the order of the hashes, up to ``size`` bytes in all. Only ids
    decide which labels are drawn. Rows of docs that share an id are learned from each, up to twice the bound; null texts are empty ones. Other columns are not
    read, whatever their names. Without documents or labels the model scores every text low.
    """
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    t = own.join(F.broadcast(chosen.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("toxic")]
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = t.orderBy(*order).limit(2 * rows).withColumn("so_far", so_far).where(F.col("so_far") <= size).select("text", "lang", "toxic").toArrow()
    texts: list[np.ndarray] = []
    for _, r, words in rows_of_texts(t["text"]):
        texts += [r[a:b] for a, b in zip(words[:-1], words[1:], strict=True)]
    return train(texts, t["toxic"].to_numpy(), t["lang"].to_pylist())


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column for the score in (0, 1) of each whole text (null: empty). One pass, no shuffle; a column of that name is replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the table's size, 4 MB
    d = docs.drop(name)
    schema = d.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for first, rows, words in rows_of_texts(b.column(b.schema.get_field_index(text))):
                out[first : first + len(words) - 1] = m.scores(m.logits(rows, words).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, name])

    return d.mapInArrow(run, schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels to learn from: those but for crc32(doc_id as text) mod 3 = 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs that are not rejected: those scored below the threshold of their language (the common one where it has none or no language).

    All columns stay as they are, whatever their names. Null texts are scored as empty ones; equal texts of a language go or stay together; an empty table stays empty.
    """
    cuts = [x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(v))]
    common = F.lit(model.threshold)
    cut = F.coalesce(F.try_element_at(F.create_map(*cuts), F.col("lang")), common) if cuts else common
    name = free_name(docs.columns, "score")
    return score(docs, model, name=name).where(F.col(name) < cut).drop(name)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_on(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    s = score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return s.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
