"""Questions from blocks of documents to buckets of keys, and answers back.

Documents are dealt once into blocks of some megabytes. A block asks about each distinct key once, however
often the key occurs in it: so a key that a third of all documents hold reaches its bucket once a block. The bucket
answers in the order of the question, so an answer needs no keys. Both ways carry packed arrays in a few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from strandflow.llm._store import give_back, shuffle_partitions

U = np.uint64
ASK = "bucket int, block int, body binary"
ANSWER = "block int, bucket int, kind int, body binary"


#: Bytes of text of a block, and of questions of a bucket, about.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 24 << 20


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_blocks(docs: DataFrame, *columns: str, sent: float = 1.0, size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """docs (columns) after a block number, and the number of buckets. sent: bytes of questions for a byte of text, size: bytes of a block, about.

    Blocks and buckets are as many as the bytes of all texts ask for, so that either fits a task whatever the number of shuffle partitions, and at least two
    blocks (half a bucket) for each of these. The block number comes from the row's id and text, so that neither null ids nor one id's rows gather in a block; rows
    without text, which have no keys to ask about, go anywhere. Rows that agree in id and text share a block. A question has a row for
    each block and bucket. The number's column is the first one, under a name that docs does not use.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * partitions, -(-total // size))
    buckets = max(-(-partitions // 2), int(sent * total / BUCKET_BYTES))
    place = F.when(F.octet_length("text") > 0, F.lit(0)).otherwise(F.monotonically_increasing_id())
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), place), F.lit(blocks)).cast("int")
    return docs.select(block.alias(free_name(docs.columns, "block")), *[f"`{c}`" for c in columns]), buckets


def bucket_bounds(n: int) -> np.ndarray:
    """The smallest key of each of n buckets: keys are uniform 64-bit numbers."""
    return np.array([(i << 64) // n for i in range(n)], U)


def questions(block: int, keys: np.ndarray, n: int, *values: np.ndarray, width: int = 8) -> pa.RecordBatch:
    """One row a bucket that has any of the sorted distinct keys. width: bytes of a key that are sent, 8 or 4.

    With 4, keys that agree in their bucket and in their last 32 bits are one key to the bucket.
    """
    cut = np.append(np.searchsorted(keys, bucket_bounds(n)), len(keys))
    sent = keys if width == 8 else keys.astype(np.uint32)
    rows = [b for b in range(n) if cut[b] < cut[b + 1]]
    bodies = [np.int64(cut[b + 1] - cut[b]).tobytes() + b"".join(x[cut[b] : cut[b + 1]].tobytes() for x in (sent, *values)) for b in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "block", "body"]
    )


def opened(body: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(body, k, n, at))
        at += out[-1].nbytes
    return out


def answered(asked: DataFrame, kind: int, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """answer: gets the bodies that reached one bucket, returns one for each."""

    def bucket(table: pa.Table) -> pa.Table:
        bodies = answer(table["body"].to_pylist())
        give_back()
        return pa.table(
            {"block": table["block"], "bucket": table["bucket"], "kind": pa.array([kind] * len(bodies), pa.int32()), "body": pa.array(bodies, pa.binary())}
        )

    return asked.groupBy("bucket").applyInArrow(bucket, ANSWER)


def answers(table: pa.Table, kind: int) -> bytes:
    """A block's answers of one kind, in the order of its keys."""
    t = table.select(["bucket", "kind", "body"]).to_pydict()
    found = sorted((b, x) for b, k, x in zip(t["bucket"], t["kind"], t["body"], strict=True) if k == kind)
    return b"".join(x for _, x in found)


def bits(flags: np.ndarray) -> bytes:
    """Flags as bytes, eight in one, after the number of them."""
    return np.int64(len(flags)).tobytes() + np.packbits(flags).tobytes()


def all_bits(table: pa.Table, kind: int) -> np.ndarray:
    t = table.select(["bucket", "kind", "body"]).to_pydict()
    found = sorted((b, x) for b, k, x in zip(t["bucket"], t["kind"], t["body"], strict=True) if k == kind)
    parts = [np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int(np.frombuffer(x, np.int64, 1)[0])).view(bool) for _, x in found]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def merged(bodies: list[bytes], *kinds: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """The arrays of all bodies one after the other, and where each body begins."""
    parts = [opened(x, *kinds) for x in bodies]
    return np.cumsum([0, *(len(p[0]) for p in parts)]), [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def by_block(blocks: DataFrame, told: DataFrame | None, f: Callable[[int, pa.Table, pa.Table | None], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply f(block, rows without their block, answers) to every block that has rows."""
    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)
    name = blocks.columns[0]

    def run(rows: pa.Table, reply: pa.Table | None) -> pa.Table:
        if not rows.num_rows:
            return arrow.empty_table()
        out = list(f(rows.column(0)[0].as_py(), rows.remove_column(0), reply))
        give_back()
        return pa.Table.from_batches(out).cast(arrow) if out else arrow.empty_table()

    if told is None:
        return blocks.groupBy(name).applyInArrow(lambda rows: run(rows, None), schema)
    return blocks.groupBy(name).cogroup(told.groupBy("block")).applyInArrow(run, schema)
