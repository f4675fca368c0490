"""The prefix trie of conversations by an external mergesort that knows longest common prefixes.

A conversation is the string of its turns, a turn its digest. Spark deals the strings over ranges of their order (and of conv_id, so that thousands of
equal conversations spread). Within a range a task sorts portions into runs that carry each string's longest common prefix (LCP) with
the one before, and merges the runs by a tree of losers: two strings whose LCPs with the last one given out differ are not compared at all, others only from there on.
The merged stream brings the LCP of each conversation with the one before: nodes deeper than that are finished and leave the stack of the open path, the turns beyond it open new ones.

Nodes that reach a range's edge, prefixes of its first or last conversation, come out once a range, as sums. What ranges share is known from their first and last
strings alone: a node that goes on from the range before was counted as new, its bytes were not saved and its parent got one child too many, and the last node of a range is no leaf if the next range goes on from it. These corrections follow
the path, so they are linear in its length.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm._store import give_back, materialize, shuffle_partitions

#: Bytes of a turn's digest (of SHA-256).
TURN = 16
#: Turns that a conversation takes from the first of its family of conversations, below this; conversations of a family.
SHARED, FAMILY = 9, 5
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NUMBERS = ("pid", "no", "parent_no", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "at_depth", "bytes")
_FLAGS = ("asked", "on_first", "on_last")
_ROW = "kind string, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", " + ", ".join(f"{c} boolean" for c in _FLAGS) + ", ends_sha256 string, node binary, parent_node binary, body binary, sizes binary, last binary"


def strings(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, turns: digests and bytes of text, in their order.

    Null roles and texts are empty. Turns without a number come first; those of equal number are ordered by their digests. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text), 256)), 1, TURN)
    t = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", digest.alias("d"), F.octet_length(text).alias("b")).alias("x"))
    in_order = F.sort_array(F.collect_list("x"))
    return t.groupBy("conv_id").agg(F.transform(in_order, lambda x: F.struct(x["d"].alias("d"), x["b"].alias("b"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that begin with the first h turns of the first of their family, h from the conversation's number, and go on with their own turns after as many."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, SHARED).alias("__head"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    both = own.withColumn("__base", base).join(heads, "__base", "left").withColumn("__h", h)
    none = F.expr("slice(turns, 1, 0)")
    head = F.when(F.col("__head").isNotNull(), F.slice("__head", F.lit(1), F.col("__h"))).otherwise(none)
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("__h") + 1, F.size("turns"))).alias("turns"))


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Bytes of the whole turns that two strings have in common, known to be at or more."""
    end = min(len(a), len(b))
    step = 64 * TURN
    while at < end and a[at : at + step] == b[at : at + step]:
        at = min(end, at + step)
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at


@dataclass(frozen=True)
class Limits:
    """Bytes of a run's strings, of a range's, of a portion of members' numbers, about; finished nodes that wait for their parent's smallest member before they are sent on without it."""

    run_bytes: int = 8 << 20
    range_bytes: int = 24 << 20
    ends_bytes: int = 1 << 20
    waiting: int = 100_000


Item = tuple[bytes, int, bytes, int]  # string, conv_id, bytes of texts, LCP with the one before


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, bytes]]:
    for b in batches:
        turns = b.column("turns")
        inner = turns.flatten()
        at = turns.offsets.to_numpy() - turns.offsets[0].as_py() if len(turns) else []
        d, n = b"".join(inner.field("d").to_pylist()), inner.field("b").cast(pa.int64()).to_numpy(zero_copy_only=False)
        for i, c in enumerate(b.column("conv_id").to_pylist()):
            yield d[at[i] * TURN : at[i + 1] * TURN], c, n[at[i] : at[i + 1]].tobytes()


def _run(portion: list[tuple[bytes, int, bytes]]) -> Iterator[Item]:
    """A sorted run with its LCPs."""
    portion.sort(key=lambda x: x[:2])
    before = b""
    for s, c, n in portion:
        yield s, c, n, shared(before, s)
        before = s


_SPOOL = pa.schema([("s", pa.binary()), ("c", pa.int64()), ("n", pa.binary()), ("l", pa.int64())])


def _spooled(run: Iterator[Item], path: str) -> Iterator[Item]:
    """The run by way of a file of the task's own, read again as the merge needs it."""
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, _SPOOL) as out:
        rows: list[Item] = []
        size = 0
        for x in run:
            rows.append(x)
            size += len(x[0]) * 2
            if size > 1 << 18:
                out.write_batch(pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _SPOOL.types, strict=True)], schema=_SPOOL))
                rows, size = [], 0
        if rows:
            out.write_batch(pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _SPOOL.types, strict=True)], schema=_SPOOL))

    def again() -> Iterator[Item]:
        with pa.OSFile(path) as f, pa.ipc.open_stream(f) as batches:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    return again()


def merged(runs: list[Iterator[Item]]) -> Iterator[Item]:
    """All runs as one, by a tree of losers.

    Everyone on the tree knows its LCP with the string that was given out last. Of two the one that shares more of it comes first; only if both share as much are they compared, beyond that.
    """
    width = 1 << max(0, (len(runs) - 1).bit_length())
    head: list[Item | None] = [next(r, None) for r in runs] + [None] * (width - len(runs))
    lcp = [0] * width

    def winner(a: int, b: int) -> tuple[int, int]:
        """First and second of two; the second then knows its LCP with the first."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        at = shared(x[0], y[0], lcp[a])
        p, q = x[0][at : at + TURN], y[0][at : at + TURN]
        first, second = (a, b) if (p, x[1]) < (q, y[1]) else (b, a)
        lcp[second] = at
        return first, second

    loser = [0] * width
    level = list(range(width))
    at = width
    while len(level) > 1:
        at //= 2
        up = []
        for i in range(at):
            w, loser[at + i] = winner(level[2 * i], level[2 * i + 1])
            up.append(w)
        level = up
    top = level[0]
    while head[top] is not None:
        s, c, n, _ = head[top]
        yield s, c, n, lcp[top]
        head[top] = follows = next(runs[top], None)
        lcp[top] = follows[3] if follows else 0
        node, w = (top + width) // 2, top
        while node:
            w, loser[node] = winner(w, loser[node])
            node //= 2
        top = w


def in_order(rows: Iterator[tuple[bytes, int, bytes]], folder: str, run_bytes: int) -> Iterator[Item]:
    """Rows sorted, each with its LCP with the one before. All runs but the last are in files until they are merged."""
    runs: list[Iterator[Item]] = []
    portion: list[tuple[bytes, int, bytes]] = []
    size = 0
    for x in rows:
        if size > run_bytes:
            runs.append(_spooled(_run(portion), os.path.join(folder, str(len(runs)))))
            portion, size = [], 0
        portion.append(x)
        size += 2 * len(x[0]) + 200
    runs.append(_run(portion))
    yield from merged(runs)


class _Node:
    """An open node: what is known of it so far."""

    __slots__ = ("asked", "bytes", "children", "conv", "depth", "ends", "first", "kids", "leaves", "members", "no", "saved", "touching")

    def __init__(self, no: int, depth: int, size: int, first: bool):
        self.no, self.depth, self.bytes, self.first = no, depth, size, first
        self.conv: int | None = None
        self.members = self.children = self.leaves = self.saved = 0
        self.ends = None  # the hash of its members that end here
        self.kids: list[tuple] = []  # finished children that wait for conv
        self.asked = self.touching = False


class _Path:
    """The stack of the open path, and the rows that leave it."""

    def __init__(self, pid: int, limits: Limits):
        self.pid, self.limits, self.next, self.waiting = pid, limits, 1, 0
        self.stack = [_Node(0, 0, 0, True)]
        self.stack[0].touching = True
        self.out: list[dict] = []
        self.first: tuple[bytes, bytes] | None = None
        self.last = b""
        self.ends: list[str] = []  # numbers of members that equal the first one, not sent yet
        self.ends_from, self.ends_size = 0, 0

    def row(self, kind: str, **columns) -> None:
        self.out.append({"kind": kind, "pid": self.pid, **columns})

    def values(self, x: _Node) -> dict:
        leaf = x.children == 0
        saved = x.saved + (x.members - 1) * x.bytes
        sha = x.ends.hexdigest() if x.ends is not None and not x.touching else None
        return {"no": x.no, "depth": x.depth, "conv_id": x.conv, "n_convs": x.members, "n_children": x.children, "n_leaves": x.leaves + leaf, "saved_tokens": saved, "asked": x.asked, "ends_sha256": sha}

    def close(self) -> None:
        """The deepest node is finished: all of its members have been seen, unless it lies on the first conversation's path."""
        x = self.stack.pop()
        v, parent = self.values(x), self.stack[-1]
        parent.members += x.members
        parent.conv = x.conv if parent.conv is None else min(parent.conv, x.conv)
        parent.leaves += v["n_leaves"]
        parent.saved += v["saved_tokens"]
        if x.first:
            self.edge(x, v, parent, False)
        else:
            self.settle(x)
            v["ends_sha256"] = v["ends_sha256"] or NO_ENDS
            parent.kids.append(v)
            self.waiting += 1
            if self.waiting >= self.limits.waiting:
                self.send_on()

    def settle(self, x: _Node) -> None:
        """Its children now know their parent."""
        for k in x.kids:
            self.row("node", parent_no=x.no, parent_conv_id=x.conv, **k)
        self.waiting -= len(x.kids)

    def send_on(self) -> None:
        """Finished nodes go without their parent's smallest member, which is joined later."""
        for x in self.stack:
            x.asked |= bool(x.kids)
            for k in x.kids:
                self.row("node", parent_no=x.no, **k)
            x.kids = []
        self.waiting = 0

    def edge(self, x: _Node, v: dict, parent: _Node | None, last: bool) -> None:
        """A node that may reach into other ranges. Its finished children ask for its smallest member later."""
        for k in x.kids:
            self.row("node", parent_no=x.no, **k)
        self.waiting -= len(x.kids)
        path = self.last if last else self.first[0]
        name = [hashlib.sha256(path[: TURN * d]).digest()[:TURN] for d in (x.depth, x.depth - 1) if d >= 0]
        sizes = np.frombuffer(self.first[1], np.int64)
        so_far = int(sizes[: x.depth].sum()) if x.first else None
        self.row("edge", **v, node=name[0], parent_node=name[1] if parent else None, on_first=x.first, on_last=last, at_depth=so_far, bytes=x.bytes)

    def add(self, s: bytes, c: int, n: bytes, lcp: int) -> None:
        new = self.first is None
        if new:
            self.first = (s, n)
        depth = lcp // TURN
        while self.stack[-1].depth > depth:
            self.flush_ends()
            self.close()
        sizes = np.frombuffer(n, np.int64)
        for d in range(depth + 1, len(sizes) + 1):
            self.stack[-1].children += 1
            self.stack.append(_Node(self.next, d, int(sizes[d - 1]), new))
            self.next += 1
        x = self.stack[-1]
        x.members += 1
        x.conv = c if x.conv is None else min(x.conv, c)
        if x.first and s == self.first[0]:
            x.touching = True  # members that end here may have equals in the range before
        if x.touching and x.first:
            self.hold(c)
        if x.ends is None:
            x.ends = hashlib.sha256(str(c).encode())
        else:
            x.ends.update(b",%d" % c)
        self.last = s

    def hold(self, c: int) -> None:
        """Numbers of members that end at the range's edge travel as text."""
        if not self.ends:
            self.ends_from = c
        self.ends.append(str(c))
        self.ends_size += len(self.ends[-1]) + 1
        if self.ends_size > self.limits.ends_bytes:
            self.flush_ends()

    def flush_ends(self) -> None:
        if self.ends:
            node = hashlib.sha256(self.first[0]).digest()[:TURN]
            self.row("ends", node=node, conv_id=self.ends_from, body=",".join(self.ends).encode())
            self.ends, self.ends_size = [], 0

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            names = _SCHEMA.names
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in self.out], _SCHEMA.field(c).type) for c in names], schema=_SCHEMA)
            self.out = []


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in _ROW.split(", "))])


def _nodes(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """One range: its finished nodes, its nodes at the edges, its first and last strings."""
    path = _Path(TaskContext.get().partitionId(), limits)
    with tempfile.TemporaryDirectory(prefix="runs-") as folder:
        # Which group of equal conversations is the last one is only known at the end: the numbers of the current one are kept.
        tail = _Tail(os.path.join(folder, "tail"), limits.ends_bytes)
        for s, c, n, lcp in in_order(_read(batches), folder, limits.run_bytes):
            tail.add(s, c)
            path.add(s, c, n, lcp)
            if len(path.out) >= 10_000:
                yield from path.taken()
        if path.first is not None:
            path.flush_ends()
            end = path.stack[-1]
            if not end.touching:  # else its numbers have been sent
                end.touching = True
                for first, body in tail.portions():
                    path.row("ends", node=hashlib.sha256(path.last).digest()[:TURN], conv_id=first, body=body)
                    yield from path.taken()
            path.row("span", body=path.first[0], sizes=path.first[1], last=path.last)
            while path.stack:
                x = path.stack.pop()
                v, parent = path.values(x), path.stack[-1] if path.stack else None
                if parent:
                    parent.members += x.members
                    parent.conv = x.conv if parent.conv is None else min(parent.conv, x.conv)
                    parent.leaves += v["n_leaves"]
                    parent.saved += v["saved_tokens"]
                path.edge(x, v, parent, True)
                if len(path.out) >= 10_000:
                    yield from path.taken()
        yield from path.taken()
    give_back()


class _Tail:
    """Numbers of the conversations that equal the latest one, in memory up to a portion and beyond that in a file."""

    def __init__(self, path: str, portion: int):
        self.path, self.portion, self.key, self.now, self.size, self.filed = path, portion, None, [], 0, []

    def add(self, s: bytes, c: int) -> None:
        if s != self.key:
            self.key, self.now, self.size = s, [], 0
            if self.filed:
                self.filed = []
                os.truncate(self.path, 0)
        self.now.append(c)
        self.size += len(str(c)) + 1
        if self.size > self.portion:
            body = ",".join(map(str, self.now)).encode()
            with open(self.path, "ab") as f:
                f.write(body)
            self.filed.append((self.now[0], len(body)))
            self.now, self.size = [], 0

    def portions(self) -> Iterator[tuple[int, bytes]]:
        if self.filed:
            with open(self.path, "rb") as f:
                for first, n in self.filed:
                    yield first, f.read(n)
        if self.now:
            yield self.now[0], ",".join(map(str, self.now)).encode()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id, body) sorted by both: the hash of each node's numbers. Holds one row at a time, however large a group is."""
    node, h = None, None
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for x, body in zip(b.column("node"), b.column("body"), strict=True):
            x, body = x.as_py(), body.as_py()
            if x == node:
                h.update(b"," + body)
            else:
                if h is not None:
                    done.append((node, h.hexdigest()))
                node, h = x, hashlib.sha256(body)
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["node", "ends"])
    if h is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], names=["node", "ends"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pid, before, last, body, sizes): turns that a range's first string shares with the last one before, the bytes of their texts, and whether that one ends there."""
    for b in batches:
        found = []
        for pid, before, last, body, sizes in zip(*(b.column(c).to_pylist() for c in ("pid", "before", "last", "body", "sizes")), strict=True):
            n = shared(last, body) // TURN
            found.append((pid, before, n, int(np.frombuffer(sizes, np.int64)[:n].sum()), n * TURN == len(last)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.record_batch([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["pid", "before", "common", "common_bytes", "goes_on"])


OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _range(limits: Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _nodes(batches, limits)


def trie(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """members (conv_id, turns: array of struct d, b; each conv_id once) -> a row a node, as OUT lists.

    A node is a distinct sequence of first turns; the root, of no turns, is there as soon as there is a member. A conversation without turns ends at the root.
    A task holds a run, the open path and at most limits.waiting finished nodes; a conversation, TURN + 8 bytes a turn, is one row. No members: no rows.
    """
    spark = members.sparkSession
    m = materialize(members.select("conv_id", "turns"), "strings")
    turns = m.agg(F.sum(F.size("turns"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), int(turns * (TURN + 8) // limits.range_bytes))
    by = F.transform("turns", lambda x: x["d"])
    out = materialize(m.withColumn("key", by).repartitionByRange(ranges, "key", "conv_id").drop("key").mapInArrow(_range(limits), _ROW), "nodes")

    spans = out.where("kind = 'span'")
    before = spans.select("pid", F.lag("pid").over(Window.orderBy("pid")).alias("before")).where("before IS NOT NULL")  # a number a range
    meet = before.join(spans.select("pid", "body", "sizes"), "pid").join(spans.select(F.col("pid").alias("before"), "last"), "before")
    meet = materialize(meet.select("pid", "before", "last", "body", "sizes").mapInArrow(_meeting, "pid long, before long, common long, common_bytes long, goes_on boolean"), "meeting")

    edges = out.where("kind = 'edge'").join(meet.select("pid", "common", "common_bytes"), "pid", "left").join(meet.select(F.col("before").alias("pid"), "goes_on"), "pid", "left")
    again = F.col("on_first") & F.col("common").isNotNull() & (F.col("depth") <= F.col("common"))

    def corrected(c: str, by: Column, where: Column) -> Column:
        return F.sum(F.col(c) + F.when(where, by).otherwise(0)).alias(c)

    whole = edges.groupBy("node", "depth", "parent_node").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        corrected("n_children", F.lit(-1), again & (F.col("depth") < F.col("common"))),
        corrected("n_leaves", F.lit(-1), F.col("on_last") & F.coalesce("goes_on", F.lit(False))),
        corrected("saved_tokens", F.col("common_bytes") - F.col("at_depth") + F.col("bytes"), again),
        F.max("ends_sha256").alias("sha"),
    )
    ends = out.where("kind = 'ends'").select("node", "conv_id", "body").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hash_ends, "node binary, ends string")
    whole = materialize(whole.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends", "sha", F.lit(NO_ENDS))).drop("ends", "sha"), "edges")
    parents = whole.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    result = whole.join(parents, "parent_node", "left").select(*OUT)

    nodes = out.where("kind = 'node'")
    done = nodes.where("parent_conv_id IS NOT NULL").select(*OUT)
    known = nodes.where("asked").select("pid", F.col("no").alias("parent_no"), F.col("conv_id").alias("parent_conv_id"))
    at_edges = out.where("kind = 'edge'").select("pid", F.col("no").alias("parent_no"), "node").join(whole.select("node", F.col("conv_id").alias("parent_conv_id")), "node").drop("node")
    asking = nodes.where("parent_conv_id IS NULL").drop("parent_conv_id").join(known.unionByName(at_edges), ["pid", "parent_no"])
    return result.unionByName(done).unionByName(asking.select(*OUT))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rebuilt by families."""
    return trie(rebuilt(strings(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
OP13_SQL = f"""WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s, {_CRC} % {SHARED} AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT o.conv_id, list_concat(list_slice(coalesce(f.s, []), 1, o.h), list_slice(o.s, o.h + 1, len(o.s))) AS s FROM o LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % {FAMILY}),
p AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s FROM b),
q AS (SELECT conv_id, depth, sha256(CAST(list_transform(list_slice(s, 1, depth), lambda x: [len(x.r)::VARCHAR, x.r, x.t]) AS VARCHAR)) AS node, CASE WHEN depth > 0 THEN sha256(CAST(list_transform(list_slice(s, 1, depth - 1), lambda x: [len(x.r)::VARCHAR, x.r, x.t]) AS VARCHAR)) END AS up,
  len(s) = depth AS ends, CASE WHEN depth > 0 THEN strlen(s[depth].t) ELSE 0 END AS n FROM p),
n AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY node, depth),
k AS (SELECT up AS node, count(*) AS k FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT n.node, x.node AS top FROM n JOIN q y ON y.node = n.node AND y.conv_id = n.conv_id JOIN q x ON x.conv_id = n.conv_id AND x.depth <= n.depth),
s AS (SELECT top, sum(n.saved) AS saved_tokens, count(*) FILTER (k IS NULL) AS n_leaves FROM a JOIN n USING (node) LEFT JOIN k USING (node) GROUP BY top)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n u ON u.node = n.up LEFT JOIN k ON k.node = n.node JOIN s ON s.top = n.node"""
