"""How far the sources of each language differ in their words: DuckDB counts within shards, Spark merges sums and rankings.

Tasks count the terms of their documents with DuckDB and deal the partial counts over shards by language and term. A shard, again in DuckDB, adds the counts up and keeps the
terms of enough documents. When Spark has the totals of all groups, the shards compute their part of every sum: for two sources only the terms
that both have, as the difference from what they would give if either count were zero. What zero counts give depends on a count alone, not on its term, so it is summed
over a table of how many terms of a group have which count. The largest values of terms are ranked within shards first. All arithmetic is in integers.
"""

from __future__ import annotations

import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm._store import give_back, materialize, shuffle_partitions

#: Bytes of text that DuckDB reads at a time, that a task counts before it sends counts on, and whose counts are a shard's, about.
READ_BYTES, FLUSH_BYTES, SHARD_BYTES = 8 << 20, 32 << 20, 24 << 20
#: Memory of one DuckDB; what needs more goes to the task's own temporary folder.
MEMORY = "300MB"
#: Documents of a language that a kept term occurs in, unit of probabilities, ranks of terms that are reported.
LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_NO_TERM = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COUNTS = "lang string, source string, term string, n long, docs long"
_KEPT = "shard int, lang string, source string, term string, n long, first int"
_SUMS = "part string, lang string, source string, item string, a long, b long"


@contextmanager
def _duck() -> Iterator[duckdb.DuckDBPyConnection]:
    folder = tempfile.mkdtemp(prefix="duck-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)
        give_back()


def _p(n: str, total: str) -> str:
    """A probability in SQL, in units, of a count among total (terms included)."""
    return f"CAST(1 + ({UNIT}::HUGEINT * ({n} + 1)) // ({total}) AS BIGINT)"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) // {q}"


def pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about size characters, cut where no term is cut."""
    at = 0
    while at < len(text):
        gap = _NO_TERM.search(text, at + size)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.Table]]:
    """Bytes of texts, whether more of the same document follows, and a table (doc, lang, source, text): some documents of about READ_BYTES together, or a piece of a longer one."""
    for b in batches:
        t = pa.Table.from_batches([b]).append_column("doc", pa.array(range(len(b)), pa.int64()))
        size = pc.binary_length(t["text"]).to_numpy()
        i = 0
        while i < len(size):
            j, n = i + 1, int(size[i])
            while j < len(size) and n + size[j] <= READ_BYTES:
                n += int(size[j])
                j += 1
            if n <= READ_BYTES:
                yield n, False, t.slice(i, j - i)
            else:
                doc = t.slice(i, 1)
                for x in pieces(doc["text"][0].as_py(), READ_BYTES):
                    yield READ_BYTES, True, doc.set_column(doc.schema.get_field_index("text"), "text", pa.array([x]))
                yield 0, False, doc.set_column(doc.schema.get_field_index("text"), "text", pa.array([""]))
            i = j


_TERMS = f"SELECT doc, lang, source, unnest(regexp_extract_all({_LOWER.format('text')}, '{TERM}')) AS term FROM portion"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms, and of the documents that hold them, by language and source. Counts of a document that is read in pieces meet before it is counted as one."""
    per_doc = f"SELECT doc, lang, source, term, count(*) AS n FROM ({_TERMS}) GROUP BY ALL"
    merged = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM seen GROUP BY ALL"
    with _duck() as con:
        con.execute("CREATE TABLE seen (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        con.execute("CREATE TABLE part (doc BIGINT, lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
        so_far, in_parts = 0, False
        for n, more, portion in _portions(batches):
            so_far += n
            con.register("portion", portion)
            if more or in_parts:
                con.execute(f"INSERT INTO part {per_doc}")
                in_parts = more
                if not more:
                    con.execute("INSERT INTO seen SELECT lang, source, term, sum(n), 1 FROM part GROUP BY ALL")
                    con.execute("TRUNCATE part")
            else:
                con.execute(f"INSERT INTO seen SELECT lang, source, term, sum(n), count(*) FROM ({per_doc}) GROUP BY ALL")
            con.unregister("portion")
            if so_far > FLUSH_BYTES and not in_parts:
                yield from con.sql(merged).to_arrow_table().to_batches()
                con.execute("TRUNCATE seen")
                so_far = 0
        yield from con.sql(merged).to_arrow_table().to_batches()


def _in_shard(sql: str, types: str) -> Callable[[pa.Table], pa.Table]:
    """What sql makes of a shard's rows, the table shard."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in types.split(", "))])

    def run(shard: pa.Table) -> pa.Table:
        with _duck() as con:
            con.register("given", shard)
            return con.sql(sql).to_arrow_table().cast(schema)

    return run


_KEEP = f"""WITH c AS (SELECT shard, lang, source, term, sum(n) AS n, sum(docs) AS docs FROM given GROUP BY ALL),
  k AS (SELECT *, sum(docs) OVER w AS held FROM c WINDOW w AS (PARTITION BY lang, term))
SELECT shard, lang, source, term, n, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS INT) AS first FROM k WHERE held >= {{least}}"""

_PARTS = f"""WITH r AS (SELECT *, {_p("n", "total + v")} AS p, {_p("0", "total + v")} AS z, {_p("sum(n) OVER (PARTITION BY lang, term)", "lang_total + v")} AS q FROM given)
SELECT 'pair' AS part, x.lang, x.source, y.source AS item, CAST(sum({_f("x.p", "y.p")} - {_f("x.p", "y.z")} - {_f("x.z", "y.p")} + {_f("x.z", "y.z")}) AS BIGINT) AS a, NULL AS b
  FROM r x JOIN r y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
UNION ALL SELECT 'count', lang, source, NULL, n, count(*) FROM r GROUP BY ALL
UNION ALL (SELECT 'term', lang, source, term, {_f("p", "q")}, NULL FROM r WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_f("p", "q")} DESC, term) <= {{top}})"""


def _prob(n: Column, total: Column) -> Column:
    """The same in Spark."""
    x = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", x, total.cast("decimal(20,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """docs (text, lang, source) -> lang, source, part, item, value, rank.

    part pair: how far the source is from each other source of its language; part term: the terms by which it is most above its language, to rank top. Null text, lang and source are ''.
    Every row is a document of its own, repeated ones too. Equal values rank by item. Sources without kept terms have pairs, with all counts 0; languages
    without kept terms have pairs of value 0. Very long texts are counted in pieces. Further columns are not read, whatever their names. No rows: no rows.
    """
    spark = docs.sparkSession
    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partitions = shuffle_partitions(spark)
    shards = max(partitions, int((d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    counts = d.mapInArrow(_count, _COUNTS).withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    kept = materialize(counts.groupBy("shard").applyInArrow(_in_shard(_KEEP.format(least=least_docs), _KEPT), _KEPT), "kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    terms = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "held", "v", "lang_total"])
    groups = materialize(groups, "groups")
    # A group may have a third of all rows, a language more: they meet their totals by salt.
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))))

    def salt(*by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(partitions)).cast("int").alias("salt")

    rows = kept.select("shard", "lang", "source", "term", "n", salt("term")).join(salted.drop("held"), ["lang", "source", "salt"]).drop("salt")
    sums = materialize(rows.groupBy("shard").applyInArrow(_in_shard(_PARTS.format(top=top), _SUMS), _SUMS), "sums")

    other = salted.select("lang", "salt", F.col("source").alias("item"), F.col("held").alias("other_held"), F.col("total").alias("other_total"))
    zero = _prob(F.lit(0), F.col("other_total") + F.col("v"))
    by_count = sums.where("part = 'count'").groupBy("lang", "source", "a").agg(F.sum("b").alias("b"))
    by_count = by_count.withColumn("salt", salt("source", "a")).join(salted.select("lang", "source", "total", "v", "salt"), ["lang", "source", "salt"])
    one = by_count.join(other, ["lang", "salt"]).where("source <> item").withColumn("z", zero).withColumn("p", _prob(F.col("a"), F.col("total") + F.col("v")))
    both = F.explode(F.array(F.struct("source", "item", (F.col("b") * _apart(F.col("p"), F.col("z"))).alias("x")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("b") * _apart(F.col("z"), F.col("p"))).alias("x"))))
    one = one.select("lang", both.alias("s")).select("lang", "s.source", "s.item", "s.x")
    none = groups.withColumn("salt", salt("source")).join(other, ["lang", "salt"]).where("source <> item")
    own = _prob(F.lit(0), F.col("total") + F.col("v"))
    x = F.when(F.col("v") > 0, (F.col("v") - F.col("held") - F.col("other_held")) * _apart(own, zero)).otherwise(0)
    none = none.select("lang", "source", "item", x.alias("x"))
    pairs = sums.where("part = 'pair'").select("lang", "source", "item", F.col("a").alias("x")).unionByName(one).unionByName(none)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("x").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = sums.where("part = 'term'").select("lang", "source", "part", "item", F.col("a").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(best.select("*", rank).where(F.col("rank") <= top))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages of documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc, lang, source, {_LOWER.format("term")} AS term FROM (SELECT doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d)),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
e AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + ({UNIT}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM e JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum({_f("x.p", "y.p")}) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST({_f("p", "q")} AS BIGINT) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INT) AS rank FROM r WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= {TOP}"""
