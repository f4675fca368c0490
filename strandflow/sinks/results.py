"""The tables that a run leaves, with the names and columns that its readers expect, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.config import TeSettings
from strandflow.operators.regions import coordinates, with_points
from strandflow.operators.store import materialize


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Tab-separated text with a header, as a folder of parts; in a global order where one is asked for."""
    (df.orderBy(*order) if order else df).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path, mode="overwrite")


def every_isoform(em: DataFrame, isoforms: DataFrame, communities: DataFrame) -> DataFrame:
    """em (community, isoform, theta, community_reads, cpm, expected_reads) with all isoforms: those that no read fits have theta 0. isoforms: isoform, gene."""
    size = em.groupBy("community").agg(F.first("community_reads").alias("reads"))
    i = isoforms.select("isoform", "gene").join(communities, "gene").join(size, "community", "left")
    out = i.join(em.select("isoform", "theta", "cpm", "expected_reads"), "isoform", "left").fillna(0.0, ["theta", "cpm", "expected_reads"])
    return out.select("isoform", "gene", "cpm", "theta", "community", F.coalesce("reads", F.lit(0)).alias("community_reads"), "expected_reads")


def long_read_expression(every: DataFrame) -> DataFrame:
    return every.select(
        F.col("isoform").alias("Isoform"), F.col("gene").alias("Gene"), F.col("cpm").alias("CPM"), "theta", "community", F.col("community_reads").alias("community_num_LRs"),
        F.col("expected_reads").alias("num_expected_LRs"),
    )


def isoform_abundance(every: DataFrame) -> DataFrame:
    return long_read_expression(every).select("Isoform", "Gene", "CPM", "num_expected_LRs")


def short_read_expression(hybrid: DataFrame, isoforms: DataFrame) -> DataFrame:
    """hybrid: community, isoform, theta, tpm, fragments; isoforms: isoform, gene, eff_len."""
    t = hybrid.join(isoforms.select("isoform", "gene", "eff_len"), "isoform")
    return t.select(F.col("isoform").alias("Isoform"), F.col("gene").alias("Gene"), F.col("tpm").alias("TPM"), F.col("eff_len").alias("Effective length"), "theta", "community",
                    F.col("fragments").alias("community_num_SRs"))


def hybrid_abundance(short: DataFrame, long: DataFrame) -> DataFrame:
    """Both tables of expression side by side; isoforms that the long reads lack have nulls."""
    s = short.select("Isoform", "Gene", "Effective length", "TPM", (F.col("community_num_SRs") * F.col("theta")).alias("num_expected_SRs"))
    return s.join(long.select("Isoform", "num_expected_LRs"), "Isoform", "left").select("Isoform", "Gene", "Effective length", "TPM", "num_expected_SRs", "num_expected_LRs")


def iterations(history: DataFrame, isoforms: DataFrame) -> DataFrame:
    """history (community, isoform, theta, iteration) with genes."""
    t = history.join(isoforms.select("isoform", "gene"), "isoform")
    return t.select(F.col("isoform").alias("Isoform"), F.col("gene").alias("Gene"), "theta", "iteration", "community")


def cell_summary(counts: DataFrame) -> DataFrame:
    """One row: cells, cells and isoforms with counts, and all counts. counts: barcode, isoform, count."""
    some = F.col("count") > 0
    return counts.agg(
        F.countDistinct("barcode").alias("cells"), F.countDistinct(F.when(some, F.col("barcode"))).alias("nonzero_cells"), F.countDistinct(F.when(some, F.col("isoform"))).alias("nonzero_isoforms"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_counts"),
    )


def transcripts_with_elements(annotated: DataFrame, tpm: DataFrame | None = None) -> DataFrame:
    """The 18 columns of the table of transcripts; lists of elements are joined by semicolons. tpm: isoform, tpm."""
    a = annotated if tpm is None else annotated.join(tpm.groupBy("isoform").agg(F.max("tpm").alias("tpm")), "isoform", "left")
    value = F.lit(0.0) if tpm is None else F.coalesce("tpm", F.lit(0.0))

    def listed(field: str):
        return F.coalesce(F.array_join(F.transform("tes", lambda t: t[field].cast("string")), ";"), F.lit(""))

    return a.select(
        F.col("isoform").alias("transcript_id"), F.col("gene").alias("gene_id"), value.alias("transcript_TPM"), "transcript_length", F.col("num_tes").alias("num_TEs"),
        F.coalesce(F.array_join("te_classes", ";"), F.lit("")).alias("TE_class"), F.col("first_exon_percent").alias("first_exon_TE_proportion"),
        F.col("total_percent").alias("total_transcript_TE_proportion"), "tss_200_overlap", "tes_200_overlap", F.col("classification").alias("transcript_classification"),
        F.col("sub_classification").alias("transcript_sub_classification"), listed("locus").alias("locus"), listed("subfamily").alias("subfamily"), listed("family").alias("family"),
        listed("class").alias("class"), listed("te_length").alias("length"), listed("overlap").alias("overlap_length"),
    )


def derived_transcripts(annotated: DataFrame, s: TeSettings = TeSettings()) -> DataFrame:
    """Transcripts of which elements cover enough of the first exon or of all, with their foremost elements; Unknown or 0 where there is none."""
    first_length = F.col("exons")[0]["end"] - F.col("exons")[0]["start"] + 1
    by_first, by_total = F.col("first_exon_percent") >= s.first_exon_threshold, F.col("total_percent") >= s.total_threshold

    def of(which: str, field: str, none):
        return F.coalesce(F.col(f"{which}.{field}"), F.lit(none))

    names = {"repeat_name": "repeat_name", "class": "class", "family": "family", "subfamily": "subfamily", "locus": "locus"}
    columns = {
        "transcript_id": F.col("isoform"), "gene_id": F.col("gene"), "transcript_length": F.col("transcript_length"), "first_exon_TE_proportion": F.col("first_exon_percent"),
        "total_transcript_TE_proportion": F.col("total_percent"), "tss_200_overlap": F.col("tss_200_overlap"), "tes_200_overlap": F.col("tes_200_overlap"),
        "transcript_classification": F.col("classification"), "transcript_sub_classification": F.col("sub_classification"),
        "meets_first_exon_threshold": by_first, "meets_total_threshold": by_total, "TE": of("dominant_first", "repeat_name", "Unknown"),
        "TE_subfamily": of("dominant_first", "subfamily", "Unknown"), "TE_family": of("dominant_first", "family", "Unknown"), "TE_class": of("dominant_first", "class", "Unknown"),
        **{f"dominant_TE_all_{k}": of("dominant", v, "Unknown") for k, v in names.items()},
        "dominant_TE_all_overlap_length": of("dominant", "overlap", 0), "dominant_TE_all_transcript_proportion": of("dominant", "overlap", 0) / F.col("transcript_length") * 100,
        **{f"dominant_TE_first_exon_{k}": of("dominant_first", v, "Unknown") for k, v in names.items()},
        "dominant_TE_first_exon_overlap_length": of("dominant_first", "overlap", 0), "dominant_TE_first_exon_te_overlap_proportion": of("dominant_first", "percent", 0.0),
        "first_exon_length": F.when(F.col("first_overlap") > 0, first_length).otherwise(0),
        "dominant_TE_first_exon_proportion": F.when(F.col("first_overlap") > 0, of("dominant_first", "overlap", 0) / first_length * 100).otherwise(0.0),
    }
    return annotated.where(by_first | by_total).select(*[v.alias(k) for k, v in columns.items()])


def element_tables(levels: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of elements' expression by file name, from te.bulk_levels."""
    e = F.col("tpm").alias("TE_expression")
    return {
        "TE_loci_exp_TPM.tsv": levels["locus"].select(F.col("repeat_name").alias("TE_loci"), F.col("subfamily").alias("TE_subfamily"), F.col("family").alias("TE_family"), F.col("class").alias("TE_class"), F.col("te_length").alias("TE_length"), e),
        "TE_subfamily_exp_TPM.tsv": levels["subfamily"].select(F.col("subfamily").alias("TE_subfamily"), F.col("family").alias("TE_family"), F.col("class").alias("TE_class"), e),
        "TE_family_exp_TPM.tsv": levels["family"].select(F.col("family").alias("TE_family"), F.col("class").alias("TE_class"), e),
        "TE_class_exp_TPM.tsv": levels["class"].select(F.col("class").alias("TE_class"), e),
    }


def element_gtf(elements: DataFrame) -> DataFrame:
    """Lines of GTF from RepeatMasker's rows."""
    locus = F.format_string("%s:%d-%d", "chrom", "start", "end")
    values = (
        ("gene_id", F.col("subfamily")), ("transcript_id", F.col("name")), ("family_id", F.col("family")), ("class_id", F.col("class")), ("locus", locus),
        ("consensus_length", F.col("consensus_length").cast("string")), ("truncated_proportion", F.col("truncated_proportion").cast("string")),
    )
    attributes = F.concat_ws("; ", *[F.concat(F.lit(f'{k} "'), v, F.lit('"')) for k, v in values])
    return elements.select(F.concat_ws("\t", "chrom", F.lit("RepeatMasker"), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(attributes, F.lit(";"))).alias("value"))


def k_value_tables(k: DataFrame, models: DataFrame) -> dict[str, DataFrame]:
    """K-values by gene and by isoform; genes of the models without regions are listed with nulls."""
    genes = models.select("chrom", "gene", F.size("isoforms").alias("isoforms")).join(k, ["chrom", "gene"], "left")
    per_gene = genes.select("gene", "chrom", F.coalesce("n_isoforms", "isoforms").alias("n_isoforms"), "n_regions", "k_value", "condition", "generalised", "product")
    per_isoform = models.select("chrom", "gene", F.explode("isoforms.isoform").alias("isoform")).join(k.select("chrom", "gene", "k_value"), ["chrom", "gene"], "left")
    return {"kvalues_gene.out": per_gene, "kvalues_isoform.out": per_isoform.select("isoform", "gene", "chrom", "k_value")}


def singular_value_table(values: DataFrame) -> DataFrame:
    """A row a gene: its singular values, largest first, joined by commas."""
    return values.select("gene", "chrom", "n_isoforms", "n_regions", F.array_join(F.col("singular_values").cast("array<string>"), ",").alias("singular_values"))


def matrix_dump(design: DataFrame, abundance: DataFrame, points: DataFrame, digits: int = 3) -> tuple[DataFrame, DataFrame]:
    """The design matrix of every gene, whose equal columns are kept once: chrom, gene, region, coordinates, abundance, columns, a row a region with its name in coordinates and the entries of the
    gene's different columns with so many decimals; and chrom, gene, isoform, k, the column of every isoform, counted from 1.

    design: chrom, gene, region, isoform, value; abundance: chrom, gene, region, abundance; points: chrom, gene, at, point. Copies of an isoform add a row to the second table alone.
    """
    keys = ["chrom", "gene"]
    shown = F.format_string(f"%.{digits}f", F.coalesce("value", F.lit(0.0))).alias("shown")
    each = design.groupBy(*keys, "isoform").agg(F.sort_array(F.collect_list(F.struct("region", shown))).alias("entries"))
    same = each.groupBy(*keys, "entries").agg(F.collect_list("isoform").alias("isoforms"))
    gene = Window.partitionBy(*keys)
    same = same.withColumn("k", F.row_number().over(gene.orderBy(F.array_min("isoforms")))).withColumn("n", F.count("*").over(gene))
    same = materialize(same, "columns")
    rows = same.select(*keys, "k", "n", F.explode("entries").alias("e")).groupBy(*keys, "e.region").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "e.shown"))).alias("entries"))
    columns = F.array_join(F.transform(F.sequence(F.lit(1), "n"), lambda k: F.coalesce(F.element_at("entries", k), F.lit(f"{0:.{digits}f}"))), ",")
    rows = rows.select(*keys, "region", columns.alias("columns")).join(abundance.select(*keys, "region", "abundance"), [*keys, "region"], "left")
    named = with_points(rows, points).select(*keys, "region", coordinates(F.col("region"), F.col("points")).alias("coordinates"), "abundance", "columns")
    return named, same.select(*keys, F.explode("isoforms").alias("isoform"), "k")


def write_matrices(rows: DataFrame, isoforms: DataFrame, folder: str) -> None:
    """A folder a gene with its matrix as text, and the table of isoforms; tables.read_matrices puts them together."""
    rows.repartition("chrom", "gene").write.mode("overwrite").partitionBy("chrom", "gene").option("sep", "\t").option("header", True).csv(f"{folder}/matrix_info")
    write_table(isoforms.select("chrom", "gene", "isoform", "k"), f"{folder}/matrix_isoforms")


def expression_tables(tpm: DataFrame, isoforms: DataFrame) -> dict[str, DataFrame]:
    """expression_isoform.out and expression_gene.out. tpm: isoform, tpm; isoforms: chrom, gene, isoform."""
    t = isoforms.select("isoform", "gene", "chrom").join(tpm.select("isoform", "tpm"), "isoform", "left").fillna(0.0, ["tpm"])
    genes = t.groupBy("gene", "chrom").agg(F.sum("tpm").alias("tpm"))
    return {"expression_isoform.out": t, "expression_gene.out": genes}


def top_labels(elements: DataFrame, n: int = 5) -> DataFrame:
    """level, label, count, rank: the most frequent classes, families and subfamilies; of equal ones the first by name."""
    labels = F.create_map(*[x for k in ("class", "family", "subfamily") for x in (F.lit(k), F.col(k))])
    c = elements.select(F.explode(labels).alias("level", "label")).groupBy("level", "label").agg(F.count("*").alias("count"))
    k = F.row_number().over(Window.partitionBy("level").orderBy(F.col("count").desc(), "label"))
    return c.withColumn("rank", k).where(F.col("rank") <= n)
