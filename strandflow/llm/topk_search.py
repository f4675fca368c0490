"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows: component x counts as floor(scale * x), zeros are left out. Candidates are dealt into blocks that keep, for every
term (dimension), the list of rows with their weights. A block of queries meets every block of candidates: term by term, each query's weight
times the term's list is added to a dense array of scores, from which a partition selection takes k. Partial results are merged by query.

Sums of longs are exact up to 2^63. A pair of vectors whose products could sum to more is summed in Python's integers, which have no bound.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm._store import materialize

#: Rows of a block of candidates and of queries: a task holds their product in scores (8 MB) besides the rows.
CANDIDATES, QUERIES = 4096, 256
#: Sums of products below this are exact in longs, with room for rounding of the bound itself.
EXACT = float(1 << 62)
#: Bytes of a score beyond 64 bits as a number that sorts: products of two doubles of scale 2^8, and many of them.
WIDE = 280


def integer_rows(vectors: DataFrame, id_column: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(id, weights array<double>): floor(scale * component) in double precision, whole numbers of any size.

    Vectors that are null or hold a null or non-finite component (also after scaling) are left out, and so are ids that are null.
    """

    def whole(x: Column) -> Column:
        # floor() gives a long: NaN would become 0. Doubles from 2^52 on are whole numbers.
        return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)

    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") * scale).alias("w"))
    fine = F.coalesce(F.forall("w", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    return v.where(F.col("id").isNotNull() & F.col("w").isNotNull()).where(fine).select("id", F.transform("w", whole).alias("weights"))


def _postings(rows: list, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the positions of the rows that hold it, and their weights."""
    out = []
    dense = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        dense[i, : len(r)] = r
    for t in range(dims):
        at = np.flatnonzero(dense[:, t])
        out.append((at, dense[at, t]))
    return out


def best_of_block(query_ids: np.ndarray, queries: list, ids: np.ndarray, rows: list, k: int) -> list[tuple[int, int, int]]:
    """(query's position, id, score) of each query's k best rows, ties to smaller ids; a row with the query's own id is left out."""
    dims = min(max(map(len, queries), default=0), max(map(len, rows), default=0))
    rows = [r[:dims] for r in rows]
    largest = np.array([max(map(abs, r), default=0) for r in rows], float)
    # Rows that do not fit a long are wide for every query but one of zeros only, whose scores are 0.
    lists = _postings([r if m < EXACT else [] for r, m in zip(rows, largest, strict=True)], dims)
    found = []
    score = np.empty(len(rows), np.int64)
    for i, q in enumerate(queries):
        q = [int(w) for w in q[:dims]]
        wide = np.flatnonzero(float(min(sum(map(abs, q)), 1 << 1000)) * np.minimum(largest, 1e6 * EXACT) >= EXACT)
        score[:] = 0
        for t, w in enumerate(q):
            if w and len(wide) < len(rows):
                at, weights = lists[t]
                w = w if abs(w) < EXACT else 0  # all rows with weights are wide then
                if len(at) == len(score):
                    score += w * weights
                else:
                    score[at] += w * weights
        own = np.flatnonzero(ids != query_ids[i])
        if len(wide):
            exact = score.tolist()
            for j in wide:
                exact[j] = sum(w * int(x) for w, x in zip(q, rows[j]))
            found += [(i, x, -s) for s, x in heapq.nsmallest(k, ((-exact[j], int(ids[j])) for j in own))]
            continue
        s = score[own]
        if len(s) > k:
            # All rows that reach the k-th score, so that ties are broken by id and not by the selection.
            own = own[s >= np.partition(s, len(s) - k)[len(s) - k]]
            s = score[own]
        best = np.lexsort((ids[own], -s))[:k]
        found += [(i, int(ids[own[j]]), int(s[j])) for j in best]
    return found


def _dense(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights (doubles, shorter vectors filled with zeros) of a block's rows, straight from its buffers."""
    lists = block.field("weights")
    at = lists.offsets.to_numpy()
    n = np.diff(at)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = lists.values.to_numpy()[at[0] : at[-1]] if len(n) else []
    return block.field("id").to_numpy(), out


class _Block:
    """A block of candidates: their ids and, made once for all blocks of queries that meet it, for each term the positions of the rows that hold it and their weights."""

    def __init__(self, rows: pa.StructArray):
        self.rows = rows
        self.ids, dense = _dense(rows)
        self.largest = float(np.abs(dense).max(initial=0))
        self.lists = []
        if self.largest < EXACT:
            whole = dense.astype(np.int64)
            for t in range(whole.shape[1]):
                at = np.flatnonzero(whole[:, t])
                self.lists.append((None if len(at) == len(whole) else at, whole[at, t]))

    def best(self, rows: pa.StructArray, k: int) -> list[tuple[int, int, int]]:
        """What best_of_block finds, with arrays where all sums fit a long."""
        query_ids, dense = _dense(rows)
        reach = np.abs(dense).sum(1).max(initial=0)
        if not max(reach, 1.0) * max(self.largest, 1.0) < EXACT:
            q, c = rows.to_pylist(), self.rows.to_pylist()
            return best_of_block(query_ids, [x["weights"] for x in q], self.ids, [x["weights"] for x in c], k)
        found = []
        for i, q in enumerate(dense.astype(np.int64)):
            score = np.zeros(len(self.ids), np.int64)
            for t in np.flatnonzero(q[: len(self.lists)]):
                at, weights = self.lists[t]
                if at is None:
                    score += q[t] * weights
                else:
                    score[at] += q[t] * weights
            own = np.flatnonzero(self.ids != query_ids[i])
            s = score[own]
            if len(s) > k:
                # All rows that reach the k-th score, so that ties are broken by id and not by the selection.
                own = own[s >= np.partition(s, len(s) - k)[len(s) - k]]
                s = score[own]
            best = np.lexsort((self.ids[own], -s))[:k]
            found += zip([i] * len(best), self.ids[own[best]].tolist(), s[best].tolist(), strict=True)
        return found


def _wide(score: int) -> bytes | None:
    """A score that is no long, as bytes in its order; None for a long."""
    return None if -(1 << 63) <= score < 1 << 63 else (score + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big")


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """rows: (id long, weights array of whole numbers) -> (query_id, rank, vec_id, score), the k best rows of each query against all others.

    Ranks are exact for all sizes; a score beyond 64 bits, which no long can hold, is null in its row.
    Shorter vectors count as if filled with zeros; an empty vector scores 0 with all. A row that repeats is a candidate each time, but not of queries
    with its id; a repeated query has a result each time. Ties go to smaller ids. No rows or no queries give an empty result.
    """
    rows = materialize(rows.withColumn("h", F.xxhash64("id", "weights")), "vectors")
    n_rows, n_queries = (int(x or 0) for x in rows.agg(F.count("*"), F.count_if(is_query)).first())
    parts, groups = max(1, -(-n_rows // CANDIDATES)), max(1, -(-n_queries // QUERIES))

    def packed(df: DataFrame, column: str, number: int) -> DataFrame:
        """One row a block, with the vectors in an array, in an order of their own."""
        block = F.pmod(F.col("h"), F.lit(number)).cast("int").alias(column)
        one = F.struct("id", "weights")
        return df.groupBy(block).agg(F.array_sort(F.collect_list(one)).alias(column + "_rows"))

    candidates = packed(rows, "part", parts)
    # The stated query set against all rows: each block of queries goes to every block of candidates.
    queries = packed(rows.where(is_query), "group", groups).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = queries.join(candidates.hint("shuffle_hash"), "part")

    def run(batches):
        part, block = None, None
        for b in batches:
            t = {"group": [], "query": [], "query_id": [], "vec_id": [], "score": [], "side": [], "wide": []}
            parts = b.column("part").to_pylist()
            for row in range(b.num_rows):
                if part != parts[row]:
                    part, block = parts[row], _Block(b.column("part_rows").slice(row, 1).flatten())
                asked = b.column("group_rows").slice(row, 1).flatten()
                query_ids = asked.field("id").to_numpy()
                found = block.best(asked, k)
                t["group"] += [b.column("group")[row].as_py()] * len(found)
                t["query"] += [i for i, _, _ in found]
                t["query_id"] += [int(query_ids[i]) for i, _, _ in found]
                t["vec_id"] += [x for _, x, _ in found]
                wide = [_wide(x) for _, _, x in found]
                t["score"] += [x if w is None else None for (_, _, x), w in zip(found, wide, strict=True)]
                t["side"] += [0 if w is None else 1 if x > 0 else -1 for (_, _, x), w in zip(found, wide, strict=True)]
                t["wide"] += wide
            yield pa.RecordBatch.from_pydict(t, schema=out)

    out = pa.schema([("group", pa.int32()), ("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("side", pa.int32()), ("wide", pa.binary())])
    partial = met.mapInArrow(run, "group int, query int, query_id long, vec_id long, score long, side int, wide binary")
    by_query = Window.partitionBy("group", "query").orderBy(F.col("side").desc(), F.col("wide").desc(), F.col("score").desc(), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = integer_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(rows, F.col("id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
