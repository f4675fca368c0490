"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. A piece goes to the open bin that it leaves least room in; if none has room, a bin of the length with
the least modelled cost opens: its expected waste for pieces of this size plus a fixed cost a sequence. At the end each bin shrinks to the shortest
permitted length that holds its contents. Documents longer than the longest sequence are first cut into pieces of that length and a rest.

Packing is sequential, so documents are dealt into shards of a bounded number of pieces, each packed on its own: the loss is some bins a shard that stay
unfilled. The number of shards follows the number of pieces. Only ids and sizes move.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm._store import materialize
from strandflow.llm.mixing import word_count

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces of a shard, about: some MB of ids and sizes in one task.
SHARD = 20_000
#: Cost of a further sequence, in words of waste.
OVERHEAD = 16


def opening_costs(sizes: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length, the expected cost a word of opening a bin of it for a piece of each size from 0 to that length.

    What is left is filled greedily from the shard's own sizes: the filler of a room is the largest size that fits, so a room's waste
    is the distance to sums of such sizes; then the bin shrinks to the shortest length that holds what it has.
    """
    top = max(lengths)
    largest = np.zeros(top + 1, np.int64)  # the largest size of the shard that fits a room
    for s in np.unique(sizes):
        largest[int(s) :] = s
    waste = np.arange(top + 1)
    for room in range(1, top + 1):
        if largest[room]:
            waste[room] = waste[room - largest[room]]
    order = np.array(sorted(lengths))
    costs = {}
    for n in lengths:
        used = n - waste[n - np.arange(n + 1)]
        shrunk = order[np.searchsorted(order, used)]
        costs[n] = (shrunk - used + OVERHEAD) / np.maximum(used, 1)
    return costs


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece (0 < size <= longest length), in descending order of size: bin, start in it, and the bin's final length."""
    order = np.argsort(-sizes, kind="stable")
    costs = opening_costs(sizes, lengths)
    pick = np.full(max(lengths) + 1, max(lengths), np.int64)
    best = np.full(max(lengths) + 1, np.inf)
    for n in sorted(lengths):
        better = costs[n] < best[: n + 1]
        pick[: n + 1][better], best[: n + 1][better] = n, costs[n][better]
    bin_of, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    capacity: list[int] = []
    filled: list[int] = []
    for i in order.tolist():
        s = int(sizes[i])
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b, room = len(capacity), int(pick[s])
            capacity.append(room)
            filled.append(0)
        bin_of[i], start[i] = b, filled[b]
        filled[b] += s
        if room > s:
            insort(rooms, (room - s, b))
    order = np.array(sorted(lengths))
    final = order[np.searchsorted(order, np.array(filled, np.int64))] if filled else np.zeros(0, np.int64)
    return bin_of, start, final[bin_of]


def pack(docs: DataFrame, size: Column, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """A row a piece: doc_id, piece (from 0), piece_start, piece_size, bin_id, bin_start, bin_length (a permitted length).

    size: a Column of words a document. A document of size 0 (null or empty text) has one piece of size 0, in no bin: bin_id, bin_start and
    bin_length are null. Repeated rows are packed each. Bins are named shard:number; which rows share a shard follows from their ids and pieces,
    so reruns agree; rows without an id are spread by their place in the table, so that they do not share one. Very long documents are cut at the longest length. Further columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    top = max(lengths)
    # Sizes are written once: texts are read and counted a single time, although shards need the number of pieces first.
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    d = materialize(docs.select("doc_id", size.cast("long").alias("size"), place.alias("place")), "sizes")
    pieces = d.agg(F.sum(F.ceil(F.col("size") / top))).first()[0] or 0
    shards = max(1, -(-int(pieces) // SHARD))
    p = d.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / top) - 1, F.lit(0)))))
    p = p.select(
        "doc_id", "place", "piece", (F.col("piece") * top).alias("piece_start"), F.least(F.lit(top), F.col("size") - F.col("piece") * top).alias("piece_size"),
    )
    # The pieces of a very long document spread, too.
    p = p.withColumn("shard", F.pmod(F.xxhash64("doc_id", "place", "piece"), F.lit(shards)).cast("long"))
    kept = ["doc_id", "piece", "piece_start", "piece_size"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece_size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        b, start, length = best_fit(table["piece_size"].to_numpy(), lengths)
        names = pa.array([f"{table['shard'][0].as_py()}:{x}" for x in b.tolist()])
        return table.select(kept).append_column("bin_id", names).append_column("bin_start", pa.array(start)).append_column("bin_length", pa.array(length))

    out = "doc_id long, piece long, piece_start long, piece_size long, bin_id string, bin_start long, bin_length long"
    packed = p.where("piece_size > 0").groupBy("shard").applyInArrow(run, out)
    return packed.unionByName(p.where("piece_size = 0").select(*kept), allowMissingColumns=True)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, word_count(F.col("text")))
