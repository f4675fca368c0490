"""Columns from names, attributes, CIGAR strings and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIGAR = r"(\d+)([MIDNSHP=X])"


def chrom_if_numeric(name: Column) -> Column:
    """Name without CHR; names with an underscore are blank, and only a numeric result replaces the name."""
    bare = F.regexp_extract(F.upper(name), r"CHR(.*)", 1)
    short = F.when(name.contains("_"), F.lit("")).when(bare != "", bare).otherwise(F.upper(name))
    return F.when(short.rlike(r"^\d+$"), short).otherwise(name)


def chrom_short(name: Column) -> Column:
    """Upper-case name without CHR."""
    bare = F.regexp_extract(F.upper(name), r"CHR(.*)", 1)
    return F.when(bare != "", bare).otherwise(F.upper(name))


def chrom_without_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^(?i)chr", "")


def attributes(text: Column) -> Column:
    """key "value"; pairs as a map; of a repeated key the last value counts."""
    pairs = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x.contains(" "))
    entries = F.transform(
        pairs, lambda x: F.struct(F.substring_index(x, " ", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^\S+\s+(.*)$", 1), '^"|"$', "").alias("value"))
    )
    return F.aggregate(
        entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"]))
    )


def attribute(text: Column, name: str) -> Column:
    """One attribute's value, null if it is absent."""
    found = F.regexp_extract(text, rf'(?:^|[;\s]){name} "([^"]*)"', 1)
    return F.when(text.rlike(rf'(?:^|[;\s]){name} "'), found)


def without_version(name: Column) -> Column:
    return F.regexp_replace(name, r"\.\d+$", "")


def cigar_runs(cigar: Column) -> Column:
    """Alternating lengths of aligned blocks and gaps. M, =, X and D lengthen a block, N a gap; I, S, H and P end a gap without
    length; runs of length zero are dropped. An even number of runs means that the alignment starts or ends with a gap."""
    n = F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(2))
    steps = F.zip_with(n, op, lambda a, b: F.struct(a.cast("long").alias("n"), b.alias("op")))
    start = F.struct(F.array().cast("array<struct<gap:boolean,n:bigint>>").alias("runs"))

    def step(state: Column, x: Column) -> Column:
        gap = x["op"] == "N"
        counts = x["op"].isin("M", "=", "X", "D", "N") & (x["n"] > 0)
        size = F.size(state["runs"])
        last = F.when(size > 0, F.element_at(state["runs"], -1))
        same = counts & (size > 0) & (last["gap"] == gap)
        longer = F.concat(
            F.slice(state["runs"], 1, F.greatest(size - 1, F.lit(0))), F.array(F.struct(gap.alias("gap"), (last["n"] + x["n"]).alias("n")))
        )
        more = F.concat(state["runs"], F.array(F.struct(gap.alias("gap"), x["n"].alias("n"))))
        return F.struct(F.when(same, longer).when(counts, more).otherwise(state["runs"]).alias("runs"))

    return F.transform(F.aggregate(steps, start, step)["runs"], lambda r: r["n"])


def matched_length(runs: Column) -> Column:
    """Sum of the blocks among runs."""
    return F.aggregate(F.filter(runs, lambda x, i: i % 2 == 0), F.lit(0).cast("long"), lambda a, x: a + x)


def read_blocks(pos: Column, runs: Column) -> Column:
    """Aligned blocks as (start, end), both inclusive."""
    zero = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"), F.lit(True).alias("block"))
    return F.aggregate(
        runs,
        zero,
        lambda s, n: F.struct(
            (s["at"] + n).alias("at"),
            F.when(s["block"], F.concat(s["blocks"], F.array(F.struct(s["at"].alias("start"), (s["at"] + n - 1).alias("end"))))).otherwise(s["blocks"]).alias("blocks"),
            (~s["block"]).alias("block"),
        ),
    )["blocks"]


def name_parts(name: Column, separator: str) -> Column:
    """(barcode, umi) from a read name split from the right; null unless it has three parts at least."""
    parts = F.split(name, "\\Q" + separator + "\\E")
    fit = F.size(parts) >= 3
    return F.struct(F.when(fit, F.element_at(parts, -2)).alias("barcode"), F.when(fit, F.element_at(parts, -1)).alias("umi"))


def tag(fields: Column, name: str) -> Column:
    """Value of a tag like CB:Z:value among fields; of several the last counts."""
    prefix = f"{name}:Z:"
    return F.try_element_at(F.transform(F.filter(fields, lambda x: x.startswith(prefix)), lambda x: F.substring(x, len(prefix) + 1, (1 << 31) - 1 - len(prefix))), F.lit(-1))


def without_gem_suffix(barcode: Column) -> Column:
    return F.regexp_replace(barcode, r"-\d+$", "")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing places; for unequal lengths the larger length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def region_type(region: Column) -> Column:
    """Kind of a region by its name: exons are joined by -, points of an exon by :."""
    exons = F.regexp_count(region, F.lit("-")) + 1
    points = F.regexp_count(region, F.lit(":"))
    inside = F.regexp_count(region, F.lit(":")) - exons
    return (
        F.when((exons == 1) & (points == 1), "one_exon")
        .when((exons == 1) & (points == 2), "two_exons")
        .when(exons == 1, "exons")
        .when((exons == 2) & (inside <= 0), "one_junction")
        .otherwise("junctions")
    )


def exon_count(region: Column) -> Column:
    return F.regexp_count(region, F.lit(":"))
