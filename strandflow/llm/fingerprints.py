"""I-Match document fingerprints with randomised lexicons. DataFrame functions only.

The lexicon is the set of terms whose document frequency lies in a band. A document's distinct lexicon terms are sorted and hashed once for
each of several randomised subsets of the lexicon. Subsets come in chains, each member keeping half of the terms of the one before, so that
for short and for long documents alike some of them hold a few terms: there are as many halvings as the longest text can need. The likeness of two fingerprints is the share of chains in which the
sparsest subset that still holds a term of either has equal hashes.

The lexicon reaches the documents as a bit set. Its size does not follow the number of documents: each document has, on average, so many
distinct terms, hence at most that average divided by the band's lower edge of terms can be as frequent as the edge. A false positive of the
bit set puts one more term into the lexicon, the same one for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm._store import materialize, shuffle_partitions

#: Share of the documents in which a lexicon term occurs: at least, at most.
BAND = (0.0005, 0.1)
#: Texts with fewer lexicon terms are taken with all their terms.
LEAST_TERMS = 6
#: Halvings at least; see halvings().
CHAINS, HALVINGS = 12, 10
HALF = CHAINS // 2
BITS_PER_TERM = 64
#: log2 of the bits that the set may have (32 MB): a lexicon of over 4 million terms, eight times what texts of 300 distinct terms can have, has fewer bits a term.
MOST_LOG2 = 28


def terms(text: Column) -> Column:
    """Hashes of the text's distinct words, A-Z as a-z; empty for null and for texts without words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\x20\x09-\x0D]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(h, df): the terms in the band of document frequency over all docs. At least two documents hold a lexicon term."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return materialize(df.where((F.col("df") >= max(2.0, band[0] * n)) & (F.col("df") <= max(2.0, band[1] * n))), "lexicon")


def bit_set(lexicon: DataFrame) -> tuple[DataFrame, int]:
    """One row with the lexicon as an array of longs, and the log2 of its number of bits. A term's bit is given by its leading bits."""
    log2 = min(MOST_LOG2, max(12, (max(1, lexicon.count()) * BITS_PER_TERM - 1).bit_length()))
    at = F.shiftrightunsigned("h", 64 - log2)
    longs = lexicon.groupBy(F.shiftrightunsigned(at, 6).alias("id")).agg(F.bit_or(_shifted(at)).alias("b"))
    every = lexicon.sparkSession.range(1 << (log2 - 6)).join(longs, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    ordered = F.sort_array(F.collect_list(F.struct("id", "b")))
    return materialize(every.agg(F.transform(ordered, lambda x: x["b"]).alias("bits")), "lexicon-bits"), log2


def _shifted(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def halvings(docs: DataFrame) -> int:
    """So many that the sparsest subset of the longest text's terms holds one or none on average: n characters have at most (n + 1) / 2 words."""
    longest = docs.agg(F.max(F.char_length("text"))).first()[0] or 0
    return max(HALVINGS, ((longest + 1) // 2).bit_length())


def fingerprint(text: Column, bits: Column, log2: int, depth: int = HALVINGS) -> Column:
    """Array of 1 + CHAINS * depth hashes of 32 bits (null: no term in the subset). Equal texts have equal ones."""

    def known(t: Column) -> Column:
        at = F.shiftrightunsigned(t, 64 - log2)
        return F.call_function("getbit", F.element_at(bits, F.shiftrightunsigned(at, 6).cast("int") + 1), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    def hashed(ts: Column) -> Column:
        return F.when(F.size(ts) > 0, F.hash(ts))

    # Arrays of one element stand for names: each step is computed once, however often it is used.
    def named(value: Column, then) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    def chain(ts: Column, c: int, d: int) -> Column:
        """Hashes of the chain's subsets from the d-th on, out of the terms of the one before. A chain has HALVINGS bits of a term's hash for itself."""
        kept = F.filter(ts, lambda t: t.bitwiseAND(F.lit(1 << (HALVINGS * (c % HALF) + d))) == 0)
        return named(kept, lambda k: (F.concat(F.array(hashed(k)), further(k, c)) if depth > HALVINGS else F.array(hashed(k))) if d + 1 == HALVINGS else F.concat(F.array(hashed(k)), chain(k, c, d + 1)))

    def further(k: Column, c: int) -> Column:
        """The subsets beyond HALVINGS, by one more hash for each chain. Most texts have no term left here."""

        def subset(d: Column) -> Column:
            low = F.call_function("shiftleft", F.lit(2).cast("long"), d) - 1
            return hashed(F.filter(k, lambda t: F.xxhash64(t, F.lit(c)).bitwiseAND(low) == 0))

        n = depth - HALVINGS
        return F.when(F.size(k) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), subset)).otherwise(F.array_repeat(F.lit(None).cast("int"), n))

    def of_sorted(ts: Column) -> Column:
        # A hash has bits for half of the chains: the others look at hashes of the hashes, in the same order.
        first = F.concat(F.array(hashed(ts)), *[chain(ts, c, 0) for c in range(HALF)])
        return F.concat(first, named(F.transform(ts, lambda t: F.xxhash64(t)), lambda again: F.concat(*[chain(again, c, 0) for c in range(HALF, CHAINS)])))

    def choose(all_terms: Column) -> Column:
        return named(F.filter(all_terms, known), lambda own: F.sort_array(F.when(F.size(own) >= LEAST_TERMS, own).otherwise(all_terms)))

    return named(named(terms(text), choose), of_sorted)


def tips(f: Column, depth: int = HALVINGS) -> Column:
    """Of a fingerprint, an array of CHAINS longs: the sparsest subset of each chain that holds a term, as its place in the chain and its hash. Place 0 and the
    hash of all terms stand for a chain without any; -1 for a text without terms."""

    def tip(c: int) -> Column:
        held = F.array_compact(F.slice(f, 2 + c * depth, depth))  # a chain's subsets shrink: the first ones hold terms
        last = F.coalesce(F.try_element_at(held, F.lit(-1)), F.element_at(f, 1))
        place = F.call_function("shiftleft", F.size(held).cast("long"), F.lit(32))
        return F.coalesce(place.bitwiseOR(last.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), F.lit(-1).cast("long"))

    return F.array(*[tip(c) for c in range(CHAINS)])


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints' tips: the share of chains whose sparsest subset with a term of either has equal hashes. Where a chain has none, all terms count."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(CHAINS))


def as_text(f: Column) -> Column:
    """The hashes as numbers, joined by points; - for none."""
    return F.array_join(f.cast("array<string>"), ".", "-")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("k"), F.coalesce("doc_id", F.lit(0)).alias("id0"))


def neighbours(keyed: DataFrame) -> DataFrame:
    """(k, id0, doc_id, prev_k, prev_id0, prev_chars): the document before each, by ascending id; the last one's is before the first.

    Ids are range-partitioned, and each range looks back over its own rows; its first row takes the last row of the range before. One row a range is all
    that meets in one place. Documents that agree in id and text are one; those without an id come last.
    """
    spark = keyed.sparkSession
    order = [F.col("doc_id").asc_nulls_last(), F.col("k").asc()]
    ids = keyed.select("doc_id", "k", "id0", F.char_length("text").cast("long").alias("n")).dropDuplicates(["k", "id0"])
    ids = materialize(ids.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "order")
    here = F.struct("k", "id0", "n")
    within = Window.partitionBy("part").orderBy(*order)
    found = ids.withColumn("before", F.lag(here).over(within))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("k").alias("kk"))
    ends = ids.groupBy("part").agg(F.max_by(here, place).alias("end"))
    parts = Window.orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(parts), F.last("end").over(whole)).alias("end"))
    found = found.join(ends, "part").withColumn("before", F.coalesce("before", "end"))
    return found.select("k", "id0", "doc_id", F.col("before.k").alias("prev_k"), F.col("before.id0").alias("prev_id0"), F.col("before.n").alias("prev_chars"))


def compare_edited(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """A row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its code points replaced by as many first ones of the next document (ascending id, after the last the first).
    Null texts are empty. Rows that agree in id and text are one document in that order and give equal rows; documents without an id come last. A single
    document is its own next one. An empty table gives an empty result; other columns are ignored. Whole texts are shuffled once, by their keys, the quarter
    that the document before needs once more, and a fingerprint once. A text with fewer than LEAST_TERMS lexicon terms is taken with all its terms, so no text is left
    out: short texts would else agree by the one term that they share.
    """
    d = _keyed(docs)
    bits, log2 = bit_set(lexicon(docs, band))
    depth = halvings(docs)
    at = neighbours(d)
    # Both uses of the texts read the same columns, so that they share one exchange.
    d = d.select("k", "id0", "text").repartition(shuffle_partitions(docs.sparkSession), "k", "id0")
    one = d.join(at, ["k", "id0"]).dropDuplicates(["k", "id0"]).withColumn("bits", bits.scalar())
    one = one.withColumn("f", fingerprint(F.col("text"), F.col("bits"), log2, depth)).withColumn("next_start", F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")))
    # A text's fingerprint is computed once, for its own row; the row before needs no more of it than the tips.
    no_text, no_hashes, no_tips, no_id = F.lit(None).cast("string"), F.lit(None).cast("array<int>"), F.lit(None).cast("array<bigint>"), F.lit(None).cast("long")
    to_own = F.struct("k", "id0", F.col("doc_id").cast("long").alias("doc_id"), no_text.alias("next_start"), no_tips.alias("next_tips"), "f")
    to_previous = F.struct(F.col("prev_k").alias("k"), F.col("prev_id0").alias("id0"), no_id.alias("doc_id"), "next_start", tips(F.col("f"), depth).alias("next_tips"), no_hashes.alias("f"))
    told = one.select(F.inline(F.array(to_own, to_previous))).groupBy("k", "id0").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "next_start", "next_tips", "f")])
    n = F.char_length("text")
    both = d.join(told, ["k", "id0"]).withColumn("bits", bits.scalar())
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("next_start")))
    f = both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "f", fingerprint(F.col("edited"), F.col("bits"), log2, depth).alias("e"), "next_tips",
    )
    f = f.withColumn("own_tips", tips(F.col("f"), depth))
    return f.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("own_tips"), tips(F.col("e"), depth)).alias("near_edited"), likeness(F.col("own_tips"), F.col("next_tips")).alias("near_next"),
    )


def op4_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
