"""Exact duplicates by a tree of sorted digest runs, in DataFrame operations only.

Rows are dealt, in chunks of neighbours, to runs of some ten thousand rows. Within a run, rows of equal digest become one entry: the best identifier and a
count. Runs are then merged in binomial rounds. In each round FAN runs meet, and so that a merge does not grow with the tree, its partners
exchange slices: one task gets one slice of digests of FAN neighbouring runs, sorts what arrives and merges equal entries. After the last round every
digest has one entry. The answer goes back down the same tree, so that a text that a third of all rows hold is looked up by run,
and no task and no join key ever has more than a run's rows of it.

Entries are one only if SHA-256, a second hash and the length in bytes all agree.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm._exchange import free_name
from strandflow.llm._store import materialize, shuffle_partitions

#: Runs that meet in a merge, as a power of two; rows of a run, about; neighbouring rows that are dealt to a run together, as a power of two; slices of a run before the first merge, as a power of two.
FAN_LOG2, RUN_ROWS, CHUNK_LOG2, SLICES_LOG2 = 4, 1 << 16, 10, 6
_SAME = ["digest", "second", "size"]


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes. Where all characters are single bytes, Spark's lower does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _slice(bits: int) -> Column:
    """The first bits of the second hash, as a number."""
    return F.shiftrightunsigned("second", 64 - bits) if bits else F.lit(0).cast("long")


def _merged(entries: DataFrame, keys: list[str], largest: bool) -> DataFrame:
    """Equal entries as one. Rows arrive sorted, or are sorted by the grouping itself: max and min of structs are taken in their order, not in a hash table."""
    best = F.max("best") if largest else F.min("best")
    return entries.groupBy(*keys, *_SAME).agg(best.alias("best"), F.sum("n").alias("n"))


def copies(docs: DataFrame, text: Column | None = None, largest: bool = True, at: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> at, doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    text: what is compared, by default the column text with A-Z lower-cased; null counts as empty. Of equal texts the row of the largest (or smallest) doc_id stays, of
    several such rows one; rows without a doc_id stay only where all equal ones lack it. at: a column that numbers the rows, else they are numbered here. Whole texts are hashed, however long; further
    columns are not read, whatever their names. No rows: no rows.
    """
    spark = docs.sparkSession
    t = F.coalesce(ascii_lower(F.col("text")) if text is None else text, F.lit(""))
    number = F.col(f"`{at}`") if at else F.monotonically_increasing_id()
    rows = docs.select("doc_id", t.alias("t"), number.alias("at"))
    rows = rows.select("at", "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("second"), F.octet_length("t").alias("size"))
    rows = materialize(rows, "digests")
    runs = max(shuffle_partitions(spark), -(-rows.count() // RUN_ROWS))
    rows = rows.withColumn("run", F.pmod(F.xxhash64(F.shiftright("at", CHUNK_LOG2)), F.lit(runs)))

    known = F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()
    first = rows.select("run", *_SAME, F.struct(known.alias("known"), "doc_id", "at").alias("best"), F.lit(1).cast("long").alias("n"))
    levels = [materialize(_merged(first, ["run"], largest), "run")]
    rounds = math.ceil(math.log2(runs) / FAN_LOG2)
    for r in range(1, rounds + 1):
        e = levels[-1].withColumn("run", F.shiftright("run", FAN_LOG2)).withColumn("slice", _slice(SLICES_LOG2 + r * FAN_LOG2))
        e = e.repartition("run", "slice").sortWithinPartitions("run", "slice", *_SAME)
        merged = _merged(e, ["run", "slice"], largest).drop("slice")
        levels.append(materialize(merged, "run") if r < rounds else merged)

    answer = levels[-1].where("n > 1").select("run", *_SAME, F.col("best").alias("keep"), F.col("n").alias("group_size"))
    for below in reversed(levels[:-1]):
        asked = below.select(F.col("run").alias("own"), F.shiftright("run", FAN_LOG2).alias("run"), *_SAME)
        answer = asked.join(answer, ["run", *_SAME]).drop("run").withColumnRenamed("own", "run")
    found = rows.join(answer, ["run", *_SAME], "left")
    alone = F.col("keep").isNull()
    return found.select(
        "at",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.at") == F.col("at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, text: Column | None = None, largest: bool = True) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are named; one of each group of equal texts."""
    at = free_name(docs.columns, "at")
    numbered = materialize(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    stays = copies(numbered, text, largest, at).where("kept").select(F.col("at").alias(at))
    return numbered.join(stays, at, "left_semi").drop(at)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its copies: equal but for the case of A-Z."""
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("at")


OP12_SQL = f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM t"""
