"""Near-duplicate groups by the Jaccard similarity of word n-grams: a size-aware heavy-light join.

Candidates. A document's shingles are put in one global order, rare ones first. Two sets that link share the first m of their
common shingles within short prefixes of both. Small (light) sets therefore meet at every 2-subset of their prefixes: many keys, each selective.
Large (heavy) sets have too many subsets; they meet in the inverted lists of their prefixes' single shingles. The boundary between
them is where the modelled cost (keys written, list entries read) is least. Sets just below it do both, so that pairs across it meet too.

Links. Sets that share a key are candidates; sets that are equal are one node. Candidate clusters (components of the lists' stars) are
verified exactly on whole sets: small ones in one place; of large ones, blocks against a few pivots and themselves first, and then only the
blocks that still hold nodes outside the cluster's main group. Verified links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm._exchange import ANSWER, ASK, answered, answers, by_block, in_blocks, merged, questions
from strandflow.llm._store import give_back, materialize, shuffle_partitions
from strandflow.llm._words import mix64, read_words, window_hashes, windows_inside
from strandflow.operators.graph import Forest, stars

U = np.uint64
#: Nodes of a candidate cluster that are verified in one place; larger clusters are cut in blocks of this size.
BLOCK = 256
PIVOTS = 4
#: Nodes of a cluster that one row of what is known of the cluster is joined to.
SHARE = 4096
STATS = -1  # as a block's number: rows that are not for a block


class _Sets:
    """The distinct shingles of the rows of a block: row i has hashes[offsets[i]:offsets[i + 1]], sorted."""

    def __init__(self, rows: pa.Table, k: int):
        parts, owner = [], []
        for t in read_words(rows["text"], fold=True):
            inside = windows_inside(t.words, k, len(t.hashes))
            at = np.flatnonzero(inside)
            row = t.row_of_word()
            parts.append(window_hashes(t.hashes, k)[at] if len(at) else np.zeros(0, U))
            owner.append(t.first + row[at])
            n = np.diff(t.words)
            for i in np.flatnonzero((n > 0) & (n < k)):
                parts.append(window_hashes(t.hashes[t.words[i] : t.words[i + 1]], int(n[i]), 100 + int(n[i])))
                owner.append(np.array([t.first + i]))
        h = np.concatenate(parts or [np.zeros(0, U)])
        o = np.concatenate(owner or [np.zeros(0, np.int64)])
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        self.hashes, self.owner = h[new], o[new]
        self.offsets = np.searchsorted(self.owner, np.arange(rows.num_rows + 1))
        self.sizes = np.diff(self.offsets)
        total = np.append(U(0), np.cumsum(mix64(self.hashes)))
        self.node = mix64((total[self.offsets[1:]] - total[self.offsets[:-1]]) ^ (self.sizes.astype(U) * U(0x9E3779B97F4A7C15)))

    def distinct(self) -> np.ndarray:
        """One row for each distinct non-empty set."""
        filled = np.flatnonzero(self.sizes)
        return filled[np.unique(self.node[filled], return_index=True)[1]]

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes of all elements of these rows, and which of the rows each belongs to."""
        n = self.sizes[rows]
        which = np.repeat(np.arange(len(rows)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offsets[rows], n), which


def _ask_frequency(k: int, buckets: int):
    def ask(block: int, rows: pa.Table, _):
        s = _Sets(rows, k)
        at, _ = s.taken(s.distinct())
        keys, n = np.unique(s.hashes[at], return_counts=True)
        yield questions(block, keys, buckets, np.minimum(n, 255).astype(np.uint8), width=4)

    return ask


def _frequency(bodies: list[bytes]) -> list[bytes]:
    """Of each key, a quarter-octave class of the number of sets that hold it. It only orders keys, so rounding does no harm."""
    at, (keys, n) = merged(bodies, np.uint32, np.uint8)
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, n)
    code = np.minimum(np.floor(4 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)[inverse]
    return [code[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


def _prefix(n: np.ndarray, num: int, den: int, m: int) -> np.ndarray:
    """Length of the prefix that holds the first m common elements of a set of n and any set that it links with."""
    return n - -(-num * n // den) + m


def boundary(sizes: list[tuple[int, int]], num: int, den: int, list_length: float) -> int:
    """The set size from which sets are heavy. sizes: (size, number of sets) pairs.

    Modelled cost: one for a key written, list_length for the entries read with it in a list of single shingles, one with a pair's list.
    """
    if not sizes:
        return 2
    n, count = (np.array(x, np.int64) for x in zip(*sorted(sizes), strict=True))
    p = _prefix(n, num, den, 2)
    light = np.append(0, np.cumsum(count * 2.0 * (p * (p - 1) // 2)))
    heavy = np.append(np.cumsum((count * (1 + list_length) * _prefix(n, num, den, 1))[::-1])[::-1], 0)
    cuts = np.append(n, n[-1] + 1)
    also = np.searchsorted(n, -(-num * cuts // den))
    return int(cuts[np.argmin(light + heavy[also])])


def _post(k: int, num: int, den: int, cut: int, buckets: int):
    def post(block: int, rows: pa.Table, reply: pa.Table):
        s = _Sets(rows, k)
        reps = s.distinct()
        at, which = s.taken(reps)
        h = s.hashes[at]
        keys, inverse = np.unique(h, return_inverse=True)
        code = np.frombuffer(answers(reply, 0), np.uint8)
        order = np.lexsort((h, code[inverse], which)) if len(h) else np.zeros(0, np.int64)
        h, which = h[order], which[order]
        n = s.sizes[reps]
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        # Sets that may link by one common shingle alone have no pair to meet at.
        single = ((n >= -(-num * cut // den)) | (-(-num * n // den) < 2))[which] & (place < _prefix(n, num, den, 1)[which])
        out, of = [h[single]], [which[single]]
        p2 = np.where(n < cut, np.minimum(_prefix(n, num, den, 2), n), 0)
        start = np.cumsum(n) - n
        for length in np.unique(p2[p2 > 1]):
            of_length = np.flatnonzero(p2 == length)
            t = h[start[of_length][:, None] + np.arange(length)]
            i, j = np.triu_indices(int(length), 1)
            # Both sets of a pair have the same order, so the subset's elements come in the same order.
            out.append(mix64(t[:, i] * U(0xD6E8FEB86659FD93) + t[:, j]).ravel())
            of.append(np.repeat(of_length, len(i)))
        out, of = np.concatenate(out), np.concatenate(of)
        order = np.argsort(out, kind="stable")
        of = reps[of[order]]
        yield questions(block, out[order], buckets, s.node[of], s.sizes[of].astype(np.int32))

    return post


def _lists(num: int, den: int):
    """Of the lists of a bucket: stars of candidate edges, and for each block the nodes of its that are in any.

    A list in the order of sizes falls apart where sizes differ too much for a link: no pair across such a gap can have one.
    """

    def run(table: pa.Table) -> pa.Table:
        bodies = table["body"].to_pylist()
        at, (keys, node, size) = merged(bodies, U, U, np.int32)
        order = np.lexsort((node, size, keys))
        k, v, n = keys[order], node[order], size[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (den * n[:-1] < num * n[1:]))) if len(k) else np.zeros(0, np.int64)
        hub = np.repeat(v[first], np.diff(np.append(first, len(k))))
        far = hub != v
        edges = np.unique(np.stack([v[far], hub[far]], 1), axis=0) if far.any() else np.zeros((0, 2), U)
        inside = np.unique(edges)
        found = []
        for i, j in zip(at[:-1], at[1:], strict=True):
            own = np.unique(node[i:j])
            found.append(own[np.isin(own, inside, assume_unique=True)].tobytes())
        blocks = [*table["block"].to_pylist(), STATS]
        return pa.table(
            {
                "block": pa.array(blocks, pa.int32()),
                "bucket": pa.array([table["bucket"][0].as_py()] * len(blocks), pa.int32()),
                "kind": pa.array([1] * len(blocks), pa.int32()),
                "body": pa.array([*found, edges.tobytes()], pa.binary()),
            }
        )

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column("body").to_pylist():
            e = np.frombuffer(body, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])


def _involved(k: int):
    def pick(_, rows: pa.Table, reply: pa.Table):
        wanted = np.unique(np.frombuffer(answers(reply, 1), U))
        s = _Sets(rows, k)
        reps = s.distinct()
        reps = reps[np.isin(s.node[reps], wanted)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.node[reps].view(np.int64)), pa.array([s.hashes[s.offsets[i] : s.offsets[i + 1]].tobytes() for i in reps], pa.binary())], names=["node", "elements"]
        )

    return pick


def links_among(sets: list[np.ndarray], num: int, den: int, first: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (with first: only between the first ones and the others)."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    start = np.searchsorted(token[order], np.arange(token.max(initial=-1) + 2))
    posted, forest, found, at = owner[order], Forest(len(sets)), [], np.cumsum(n) - n
    for i in range(len(sets) if first is None else first):
        own = token[at[i] : at[i] + n[i]]
        lo, length = start[own], start[own + 1] - start[own]
        shared = np.bincount(posted[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(lo, length)], minlength=len(sets))
        linked = den * shared >= num * (n + n[i] - shared)
        linked[: i + 1 if first is None else first] = False
        found += [(i, int(j)) for j in np.flatnonzero(linked) if forest.union(i, int(j))]
    return found


def _pairs(nodes: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    e = nodes[np.array(found, np.int64).reshape(-1, 2)]
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in table["elements"].to_pylist()]


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verify(num: int, den: int):
    """Verified links within each cluster of a group of rows (cluster, node, elements, side)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("side", "ascending"), ("node", "ascending")])
        cluster, side, nodes, sets = table["cluster"].to_numpy(), table["side"].to_numpy(), table["node"].to_numpy(), _sets_of(table)
        cut = np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), len(cluster))
        out = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            first = int((side[i:j] == 0).sum())
            # side 0 and 1: blocks to compare with each other; side 2: nodes to compare among themselves.
            out.append(_pairs(nodes[i:j], links_among(sets[i:j], num, den, first or None)))
        give_back()
        return pa.Table.from_batches(out, _EDGE)

    return run


def _large_cluster_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links within clusters of more than BLOCK nodes: members (cluster, n, node, elements)."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("long")
    members = materialize(members.withColumn("part", part), "members")
    ranked = [F.min_by(F.struct("node", "elements"), F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    heads = members.groupBy("cluster").agg(F.max("n").alias("n"), *ranked)
    heads = heads.withColumn("p", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}") for i in range(PIVOTS)]))))
    heads = heads.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)).alias("part"), "p.node", "p.elements")
    near = members.select("cluster", "part", "node", "elements").unionByName(heads).dropDuplicates(["cluster", "part", "node"])
    near = near.select(F.xxhash64("cluster", "part").alias("cluster"), "node", "elements", F.lit(2).alias("side"))
    first = materialize(near.groupBy("cluster").applyInArrow(_verify(num, den), "u long, v long"), "links")

    # The main group of a cluster needs no more comparisons within itself; the nodes outside it meet all other nodes, block by block. A cluster may
    # hold most of all nodes: what is known of it is joined to them by cluster and share, and a meeting of blocks has a key of its own.
    found = stars(first)
    share = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / SHARE))
    state = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).select("cluster", "n", "node", "elements", "root", share.alias("share"))
    sizes = state.groupBy("cluster", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("k"))
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("all") / SHARE) - 1)).alias("share")
    main = main.where(F.col("all") > F.col("k")).select("cluster", shares, "main", F.ceil((F.col("all") - F.col("k")) / BLOCK).alias("outer"), F.ceil(F.col("all") / BLOCK).alias("parts"))
    state = materialize(state.join(main, ["cluster", "share"]).withColumn("inner", F.col("root") == F.col("main")), "state")
    i = F.pmod(F.xxhash64("node", F.lit(1)), F.col("outer")).cast("long")
    j = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("long")
    outer = state.where("NOT inner").select("cluster", i.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), "node", "elements", F.lit(0).alias("side"))
    other = state.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)).alias("i"), j.alias("j"), "node", "elements", F.lit(1).alias("side"))
    meeting = F.xxhash64("cluster", "i", "j").alias("cluster")
    second = outer.unionByName(other).select(meeting, "node", "elements", "side").groupBy("cluster").applyInArrow(_verify(num, den), "u long, v long")
    return first.unionByName(second)


def nodes_and_components(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(block, doc_id, n_shingles, node) a row of docs, and (node, root) for the nodes that link with others."""
    blocks, n = in_blocks(docs, "doc_id", "text", sent=3.0)

    def name(block, rows, __):
        s = _Sets(rows, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows.num_rows, block, np.int32)), rows["doc_id"].combine_chunks(), pa.array(s.sizes.astype(np.int64)), pa.array(s.node.view(np.int64))],
            names=["block", "doc_id", "n_shingles", "node"],
        )

    frequency = materialize(answered_frequency(blocks, k, n), "frequency")
    nodes = materialize(by_block(blocks, None, name, "block int, doc_id long, n_shingles long, node long"), "nodes")
    sizes = nodes.where("n_shingles > 0").groupBy("n_shingles").agg(F.approx_count_distinct("node").alias("c"))
    sizes = [(r[0], r[1]) for r in sizes.where("n_shingles <= 4096").collect()]
    stats = frequency.agg(F.sum(F.octet_length("body")).alias("asked")).first()
    total = sum(a * c for a, c in sizes)
    cut = boundary(sizes, num, den, max(1.0, total / max(1, stats["asked"] or 1)))

    posted = by_block(blocks, frequency, _post(k, num, den, cut, n), ASK)
    lists = materialize(posted.groupBy("bucket").applyInArrow(_lists(num, den), ANSWER), "lists")
    edges = lists.where(F.col("block") == STATS).mapInArrow(_edges, "u long, v long")
    clusters = stars(edges)
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    counts = clusters.groupBy("root").agg(F.count("*").alias("n"))
    clusters = materialize(clusters.join(counts, "root").select("node", F.col("root").alias("cluster"), "n"), "clusters")

    sets = by_block(blocks, lists.where(F.col("block") != STATS), _involved(k), "node long, elements binary").dropDuplicates(["node"])
    members = materialize(sets.join(clusters, "node").select("cluster", "n", "node", "elements"), "sets")
    group = F.pmod(F.xxhash64("cluster"), F.lit(2 * shuffle_partitions(docs.sparkSession))).alias("group")
    links = members.where(F.col("n") <= BLOCK).select(group, "cluster", "node", "elements", F.lit(2).alias("side"))
    links = links.groupBy("group").applyInArrow(_verify(num, den), "u long, v long")
    large = members.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        links = links.unionByName(_large_cluster_links(large, num, den))
    return nodes, stars(links)


def answered_frequency(blocks: DataFrame, k: int, n: int) -> DataFrame:
    return answered(by_block(blocks, None, _ask_frequency(k, n), ASK), 0, _frequency)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard >= num / den).

    A-Z count as a-z. A text of fewer than k words is one shingle; null texts and texts without words have none, link with nothing and are
    their own component. Equal sets link whatever their texts. Rows that repeat an id are rows of their own. A null id takes part, but never names
    a component unless all ids of the component are null. An empty table gives an empty result; other columns are ignored.
    Nodes are 64-bit hashes of whole sets: two different sets among n fall together with a chance of n^2 / 2^65.
    """
    nodes, found = nodes_and_components(docs, k, num, den)
    d = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    salts = 16
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    least = d.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1")
    least = least.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "least")
    d = d.select("doc_id", "n_shingles", "root", salt).join(least, ["root", "salt"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return d.select("doc_id", "n_shingles", own.alias("component_id"))


def first_of_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near-duplicates: of each component the document with the smallest id stays, once, with all its columns.

    Documents without shingles (null texts, texts without words) all stay. Of a component in which no document has an id, one document stays.
    """
    nodes, found = nodes_and_components(docs, k, num, den)
    d = nodes.where("n_shingles > 0").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "block", "node")
    kept = d.groupBy("root").agg(F.min(order).alias("kept")).select("kept.block", "kept.doc_id", "kept.node")
    blocks, _ = in_blocks(docs, *docs.columns)

    def pick(_, rows: pa.Table, kept: pa.Table):
        s = _Sets(rows, k)
        wanted = set(zip(kept["doc_id"].to_pylist(), kept["node"].to_pylist(), strict=True))
        names = list(zip(rows["doc_id"].to_pylist(), s.node.view(np.int64).tolist(), strict=True))
        texts = rows["text"].to_pylist()
        first: dict = {}
        for i, x in enumerate(names):
            if s.sizes[i] and x in wanted and (x not in first or texts[i] < texts[first[x]]):
                first[x] = i
        stay = sorted([*np.flatnonzero(s.sizes == 0).tolist(), *first.values()])
        yield from rows.take(pa.array(stay, pa.int64())).to_batches()

    return by_block(blocks, kept, pick, docs.schema)


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 4, 85, 100)


#: DuckDB: all pairs that share a shingle, their exact similarity, and a recursive walk along the links.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS p FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * i >= 85 * (nx.k + ny.k - i)
), e AS (
  SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l
), reach(doc_id, t) AS (
  SELECT u, u FROM (SELECT DISTINCT u FROM e) UNION SELECT r.doc_id, e.v FROM reach r JOIN e ON r.t = e.u
), c AS (
  SELECT doc_id, min(t) AS low FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
