"""Gene models: disjoint exon pieces (atoms), points, and regions (contiguous runs of an isoform's atoms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.intervals import merge_intervals
from strandflow.operators.store import dealt, materialize

GENE = ["chrom", "gene"]
#: Bases of a gene whose cuts one task orders, where genes are spread.
SLICE = 1 << 16


def isoforms(exons: DataFrame) -> DataFrame:
    """chrom, gene, isoform, strand, exons sorted by coordinates, iso_len."""
    return exons.groupBy(*GENE, "isoform").agg(
        F.first("strand").alias("strand"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"), F.sum(F.col("end") - F.col("start") + 1).alias("iso_len")
    )


def merge_copies(isoforms: DataFrame) -> DataFrame:
    """One row for isoforms of a gene with the same exons: the first name, and all names."""
    return isoforms.groupBy(*GENE, "strand", "exons", "iso_len").agg(F.min("isoform").alias("isoform"), F.sort_array(F.collect_set("isoform")).alias("copies"))


def atoms(exons: DataFrame, rows: int | None = None) -> DataFrame:
    """chrom, gene, start, end, first_point, last_point: pieces between the cut points (starts and ends + 1) that an exon covers.

    Pieces of one base are dropped. Points count the remaining pieces' starts and ends from 0. A gene's cuts are ordered in one task; for genes of very many exons rows says how many there are in
    all, and one task orders those of SLICE bases.
    """
    both = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d")))
    if rows is not None:
        return _spread_atoms(exons.select(*GENE, F.explode(both).alias("x")), 2 * rows)
    steps = exons.select(*GENE, "start", "end").distinct().select(*GENE, F.explode(both).alias("x"))
    cuts = steps.groupBy(*GENE, F.col("x.at").alias("start")).agg(F.sum("x.d").alias("d"))
    order = Window.partitionBy(*GENE).orderBy("start")
    pieces = cuts.withColumn("open", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("end", F.lead("start").over(order) - 1)
    pieces = pieces.where("open > 0 AND end > start").withColumn("k", F.row_number().over(order))
    return pieces.select(*GENE, "start", "end", (2 * F.col("k") - 2).alias("first_point"), (2 * F.col("k") - 1).alias("last_point"))


def _spread_atoms(steps: DataFrame, rows: int) -> DataFrame:
    """atoms from steps (chrom, gene, x of at and d): slices of SLICE bases hold at most as many cuts, and only a row a slice is ordered by gene: what is open before it, where the next one begins, and
    its pieces. Exons that are listed twice open and close twice."""
    part = [*GENE, "slice"]
    s = dealt(steps.select(*GENE, F.floor(F.col("x.at") / SLICE).alias("slice"), F.col("x.at").alias("start"), F.col("x.d").alias("d")), rows, *part)
    c = materialize(s.groupBy(*part, "start").agg(F.sum("d").alias("d")), "cuts")
    gene, own = Window.partitionBy(*GENE).orderBy("slice"), Window.partitionBy(*part).orderBy("start")
    before = gene.rowsBetween(Window.unboundedPreceding, -1)
    s = c.groupBy(*part).agg(F.sum("d").alias("d"), F.min("start").alias("first"))
    s = s.select(*part, F.coalesce(F.sum("d").over(before), F.lit(0)).alias("before"), F.lead("first").over(gene).alias("next"))
    p = dealt(c, rows, *part).join(s, part).withColumn("open", F.col("before") + F.sum("d").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    p = p.withColumn("end", F.coalesce(F.lead("start").over(own), "next") - 1).where("open > 0 AND end > start").withColumn("k", F.row_number().over(own))
    p = materialize(p.select(*part, "start", "end", "k"), "pieces")
    n = p.groupBy(*part).agg(F.count("*").alias("n")).withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    k = F.col("n") + F.col("k")
    return p.join(n, part).select(*GENE, "start", "end", (2 * k - 2).alias("first_point"), (2 * k - 1).alias("last_point"))


def point_index(atoms: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("start").alias("at"), F.col("first_point").alias("point")), F.struct(F.col("end").alias("at"), F.col("last_point").alias("point")))
    return atoms.select(*GENE, F.explode(both).alias("x")).select(*GENE, "x.at", F.format_string("P%d", "x.point").alias("point"))


def gene_models(exons: DataFrame) -> DataFrame:
    """chrom, gene, gene_start, gene_end, atoms (sorted structs) and isoforms (name, length, strand, exons, indexes of its atoms)."""
    a = atoms(exons).groupBy(*GENE).agg(F.array_sort(F.collect_list(F.struct("start", "end", "first_point", "last_point"))).alias("atoms"))
    i = isoforms(exons).join(a, GENE)
    inside = F.filter(
        F.transform("atoms", lambda x, n: F.when(F.exists("exons", lambda e: (e["start"] <= x["start"]) & (e["end"] >= x["end"])), n)), lambda n: n.isNotNull()
    )
    i = i.withColumn("atom_ids", inside)
    return i.groupBy(*GENE).agg(
        F.min(F.col("exons")[0]["start"]).alias("gene_start"), F.max(F.array_max(F.transform("exons", lambda e: e["end"]))).alias("gene_end"), F.first("atoms").alias("atoms"),
        F.array_sort(F.collect_list(F.struct("isoform", "iso_len", "strand", "exons", "atom_ids"))).alias("isoforms"),
    )


def runs(values: Column, make) -> Column:
    """All contiguous runs i..j of an array column, each put through make(slice)."""
    n = F.size(values)
    per_start = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: make(F.slice(values, i, j - i + 1))))
    return F.when(n > 0, F.flatten(per_start))


def regions(models: DataFrame) -> DataFrame:
    """chrom, gene, region, region_len, n_atoms, inner_len, first_len, last_len, isoforms. Their number grows with the square of an isoform's atoms: for K-values and small genes."""
    i = models.select(*GENE, "atoms", F.explode("isoforms").alias("i"))
    # Isoforms of the same atoms have the same runs, which are made once, from atoms that are looked up before they are grouped.
    own = F.transform("i.atom_ids", lambda k: F.element_at("atoms", k + 1)).alias("atom_ids")
    i = i.select(*GENE, own, F.col("i.isoform").alias("isoform")).groupBy(*GENE, "atom_ids").agg(F.collect_list("isoform").alias("names"))

    def region(a):
        name = F.array_join(F.transform(a, lambda x: F.concat(F.lit("P"), x["first_point"].cast("string"), F.lit(":P"), x["last_point"].cast("string"))), "-")
        return F.struct(name.alias("region"), F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"] + 1).alias("region_len"), F.size(a).alias("n_atoms"),
                        F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"] + 1).alias("inner_len"),
                        *[(F.element_at(a, k)["end"] - F.element_at(a, k)["start"] + 1).alias(n) for n, k in (("first_len", 1), ("last_len", -1))])

    r = i.select(*GENE, "names", F.explode(runs(F.col("atom_ids"), region)).alias("r"))
    return r.groupBy(*GENE, "r.region").agg(
        F.first("r.region_len").alias("region_len"), F.first("r.n_atoms").alias("n_atoms"), F.first("r.inner_len").alias("inner_len"),
        F.first("r.first_len").alias("first_len"), F.first("r.last_len").alias("last_len"), F.sort_array(F.flatten(F.collect_list("names"))).alias("isoforms")
    )


def gene_structure(exons: DataFrame) -> DataFrame:
    """chrom, gene, merged length (touching exons join), and sorted lengths of exons and isoforms."""
    merged = merge_intervals(exons.select(*GENE, "start", "end").distinct(), GENE, "start", "end", True)
    length = merged.groupBy(*GENE).agg(F.sum(F.col("end") - F.col("start") + 1).alias("merged_len"))
    e = exons.select(*GENE, "start", "end").distinct().groupBy(*GENE).agg(F.sort_array(F.collect_list(F.col("end") - F.col("start") + 1)).alias("exon_lens"))
    i = isoforms(exons).groupBy(*GENE).agg(F.sort_array(F.collect_list("iso_len")).alias("isoform_lens"))
    return length.join(e, GENE).join(i, GENE)
