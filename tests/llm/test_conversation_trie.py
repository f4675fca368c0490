"""The prefix trie against a plain one, and the merge against a plain sort."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from strandflow.llm import conversation_trie as ct

KINDS = "conv_id long, turn long, role string, text string, d string, b long, x string, turns int, node string"


def plain_trie(members: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    of, ends = defaultdict(list), defaultdict(list)
    for c, s in members.items():
        for d in range(len(s) + 1):
            of[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in of:
        if n:
            children[n[:-1]] += 1
    for n in of:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(of[n]) - 1) * len(n[-1][1].encode()) if n else 0
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
    return {(min(of[n]), len(n), min(of[n[:-1]]) if n else None, len(of[n]), children[n], leaves[n], saved[n], sha(n)) for n in of}


def plain_rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + s[h:]
    return out


def got(df) -> set[tuple]:
    rows = [tuple(r[c] for c in ct.OUT) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "x", 2, "n") for r in rows], KINDS)


def test_edges(spark):
    """Null turns come first, null roles and texts are empty, rows without conv_id are left out, ids may be negative, first conversations of a family absent; long texts, clashing names."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{(c % 3) * (t > 1)} {t} é") for c in range(-12, 40) if c % 15 for t in range((c * 7) % 12)]
    rows += [(100, None, None, None), (100, 2, "user", None), (100, 1, None, "x"), (None, 1, "user", "lost"), (101, 1, "user", "y " * 200_000), (102, 1, "u", "a"), (102, 2, "ua", "")]
    want = plain_trie(plain_rebuilt(rows))
    assert got(ct.trie(ct.rebuilt(ct.strings(frame(spark, rows))))) == want
    assert ct.trie(ct.rebuilt(ct.strings(frame(spark, [])))).count() == 0
    # Repeated rows and equal numbers of turns: an order of their own, each a turn.
    t = ct.trie(ct.strings(frame(spark, [(1, 1, "u", "a"), (1, 1, "u", "a"), (1, 1, "u", "b"), (2, 1, "u", "b"), (2, 1, "u", "a"), (2, 1, "u", "a")]))).toPandas()
    assert t.sort_values("depth")[["depth", "n_convs", "n_leaves"]].values.tolist() == [[d, 2, 1] for d in range(4)]


@pytest.mark.parametrize("limits", [ct.Limits(), ct.Limits(run_bytes=600, range_bytes=2000, ends_bytes=30, waiting=3)])
def test_hot_prefixes_in_many_ranges(spark, limits):
    """A third of all conversations are equal, others go on from them or end before; ranges of a few conversations, runs of fewer, nodes that are sent on at once."""
    rnd = random.Random(7)
    hot = [("system", "be kind"), ("user", "hello"), ("assistant", "hello to you"), ("user", "bye")]
    members = {}
    for c in rnd.sample(range(10_000), 900):
        k = rnd.random()
        s = hot[:]
        if k < 0.2:
            s = hot[: rnd.randrange(5)]
        elif k < 0.5:
            s = hot[: rnd.randrange(1, 5)] + [("user", str(rnd.randrange(4))) for _ in range(rnd.randrange(1, 6))]
        elif k < 0.65:
            s = [("user", f"own {c} {i}") for i in range(rnd.randrange(1, 4))]
        members[c] = s
    rows = [(c, i, *t) for c, s in members.items() for i, t in enumerate(s)]
    empty = spark.createDataFrame([(c,) for c, s in members.items() if not s], "conv_id long")
    m = ct.strings(frame(spark, rows))
    m = m.unionByName(empty.withColumn("turns", F.array().cast(m.schema["turns"].dataType)))
    assert got(ct.trie(m.repartition(5), limits)) == plain_trie(members)


def test_merge(tmp_path):
    """The merge gives a plain sort's order, with the prefixes that neighbours share; equal strings by number."""
    rnd = random.Random(3)
    turns = [bytes([i]) * ct.TURN for i in range(3)]
    items = [(b"".join(rnd.choice(turns) for _ in range(rnd.randrange(90 if i % 50 == 0 else 6))), i, b"") for i in range(500)]
    rnd.shuffle(items)
    found = list(ct.in_order(iter(items), str(tmp_path), 3000))
    assert [x[:3] for x in found] == sorted(items, key=lambda x: x[:2]) and len(list(tmp_path.iterdir())) > 10
    assert [x[3] for x in found[1:]] == [ct.shared(a[0], b[0]) for a, b in pairwise(found)] and found[0][3] == 0
    assert list(ct.merged([iter([])])) == [] and list(ct.merged([iter([]), iter([(b"", 4, b"", 0)]), iter([])])) == [(b"", 4, b"", 0)]
