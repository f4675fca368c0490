"""Queries over files and strings that are made from the driver's tables, and the same in DuckDB's SQL.

Annotations, alignments, matrices and tables are written as text in the shared folder and read by the sources. The SQL computes from the tables what the
lines say: parts are isoforms T<partkey>.<size> of genes brand|size, lineitems are alignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.config import MapSettings
from strandflow.functions import text
from strandflow.functions.lengths import gaussian_hit, with_effective_length
from strandflow.operators import te
from strandflow.operators.assign import whitelisted
from strandflow.operators.matrix import write_mex
from strandflow.operators.store import new_dir
from strandflow.plans.contract import query as register
from strandflow.sinks import results
from strandflow.sources import fasta, gtf, sam, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    return register(sql, QUERIES, ORACLE_SQL)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _file(lines: DataFrame, what: str) -> str:
    """A file (a folder of parts) of the lines in the column value."""
    path = new_dir(lines.sparkSession, what)
    lines.select("value").write.text(path)
    return path


def _tabs(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in columns])


def _key(*columns: str) -> list[Column]:
    return [F.col(c) for c in columns]


_LI = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _cigar() -> Column:
    q = F.col("l_quantity").cast("long")
    n = [q, F.col("l_partkey") % 3, F.col("l_partkey") % 5, F.col("l_suppkey") % 4, q + 1]
    head = F.concat(F.col("l_linenumber").cast("string"), F.lit("S"))
    return F.concat(head, *[F.concat(x.cast("string"), F.lit(op)) for x, op in zip(n, "MIDNX", strict=True)], F.lit("7H"))


_RUNS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) + l_partkey % 5 AS a, l_suppkey % 4 AS gap, CAST(l_quantity AS BIGINT) + 1 AS b FROM lineitem"""


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN gap = 0 THEN CAST(a + b AS VARCHAR) ELSE a || ',' || gap || ',' || b END AS runs,
  a + b AS matched, l_partkey + a + gap + b - 1 AS last, CASE WHEN gap = 0 THEN 1 ELSE 2 END AS blocks FROM ({_RUNS})""")
def cigar_runs(spark, sf):
    li = _table(spark, sf, "lineitem").withColumn("runs", text.cigar_runs(_cigar()))
    blocks = text.read_blocks(F.col("l_partkey"), F.col("runs"))
    return li.select(*_key(*_LI), F.array_join(F.transform("runs", lambda x: x.cast("string")), ",").alias("runs"), text.matched_length(F.col("runs")).alias("matched"),
                     F.element_at(blocks, -1)["end"].alias("last"), F.size(blocks).alias("blocks"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'B' || l_suppkey END AS barcode,
  CASE WHEN l_linenumber % 3 = 2 THEN 'second' ELSE 'U' || l_orderkey END AS umi FROM lineitem""")
def tag_extract(spark, sf):
    """Of several tags of a name the last counts; the suffix of a barcode goes."""
    cell = F.when(F.col("l_linenumber") % 3 == 0, "CX:Z:none").otherwise(F.concat(F.lit("CB:Z:B"), "l_suppkey", F.lit("-1")))
    fields = F.array_compact(F.array(F.lit("NM:i:1"), cell, F.concat(F.lit("UB:Z:U"), "l_orderkey"), F.when(F.col("l_linenumber") % 3 == 2, "UB:Z:second")))
    return _table(spark, sf, "lineitem").select(*_key(*_LI), text.without_gem_suffix(text.tag(fields, "CB")).alias("barcode"), text.tag(fields, "UB").alias("umi"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS barcode, CASE WHEN c_custkey % 2 = 0 THEN 'U' || c_custkey END AS umi FROM customer""")
def name_split(spark, sf):
    """Names of two parts have neither barcode nor molecule."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(".", F.lit("a.b"), "c_mktsegment", F.concat(F.lit("U"), "c_custkey"))).otherwise(F.concat_ws(".", "c_mktsegment", "c_custkey"))
    parts = text.name_parts(name, ".")
    return _table(spark, sf, "customer").select("c_custkey", parts["barcode"].alias("barcode"), parts["umi"].alias("umi"))


@query("""SELECT p_partkey, p_brand || '|' || p_size AS gene, 'T' || p_partkey || '.' || p_size AS isoform, CASE WHEN p_partkey % 2 = 0 THEN 'last' ELSE p_type END AS note,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 3 END AS BIGINT) AS entries, false AS has_more FROM part""")
def attributes(spark, sf):
    """Of repeated keys the last value counts."""
    p = _table(spark, sf, "part")
    line = F.concat(F.lit('gene_id "'), "p_brand", F.lit("|"), "p_size", F.lit('"; transcript_id "T'), "p_partkey", F.lit("."), "p_size", F.lit('"; note "'), "p_type",
                    F.when(F.col("p_partkey") % 2 == 0, '"; note "last";').otherwise('";'))
    p = p.withColumn("line", line).withColumn("m", text.attributes(F.col("line")))
    return p.select("p_partkey", text.attribute(F.col("line"), "gene_id").alias("gene"), F.col("m")["transcript_id"].alias("isoform"), F.col("m")["note"].alias("note"),
                    F.size("m").cast("long").alias("entries"), text.attribute(F.col("line"), "note_more").isNotNull().alias("has_more"))


@query("""WITH n AS (SELECT (['chr', 'CHR', 'Chr', '', 'chr0', 'scaffold_', 'chrX', 'chrUn_', 'ACGT'])[1 + p_partkey % 9] || CASE WHEN p_partkey % 11 < 8 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 11 = 8 THEN 'X' WHEN p_partkey % 11 = 9 THEN 'M' ELSE 'tgca_random' END AS name FROM part)
  SELECT name, CASE WHEN contains(name, '_') THEN name WHEN regexp_matches(regexp_replace(upper(name), '^.*CHR', ''), '^[0-9]+$') THEN regexp_replace(upper(name), '^.*CHR', '') ELSE name END AS a,
  regexp_replace(upper(name), '^.*CHR', '') AS b, regexp_replace(name, '^chr', '', 'i') AS c, reverse(translate(name, 'ACGTacgt', 'TGCAtgca')) AS d FROM n""")
def name_normalisers(spark, sf):
    first = F.element_at(F.array(*[F.lit(x) for x in ("chr", "CHR", "Chr", "", "chr0", "scaffold_", "chrX", "chrUn_", "ACGT")]), (1 + F.col("p_partkey") % 9).cast("int"))
    k = F.col("p_partkey") % 11
    rest = F.when(k < 8, F.col("p_size").cast("string")).when(k == 8, "X").when(k == 9, "M").otherwise("tgca_random")
    names = _table(spark, sf, "part").select(F.concat(first, rest).alias("name"))
    n = F.col("name")
    return names.select("name", text.chrom_if_numeric(n).alias("a"), text.chrom_short(n).alias("b"), text.chrom_without_prefix(n).alias("c"), text.reverse_complement(n).alias("d"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / (1 + l_partkey % 50) AS off5, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_quantity / (l_suppkey % 3) END AS safe,
  round(exp(-(((l_quantity - 25) / 5) ** 2) / 2) / (5 * sqrt(pi())) / (1 + l_partkey % 50), 12) AS hit FROM lineitem""")
def fractions_and_densities(spark, sf):
    from strandflow.functions.lengths import ratio

    w = (1 + F.col("l_partkey") % 50).cast("double")
    hit = gaussian_hit(F.col("l_quantity"), F.lit(25.0), F.lit(5.0), w)
    return _table(spark, sf, "lineitem").select(*_key(*_LI), (F.col("l_quantity") / w).alias("off5"), ratio(F.col("l_quantity"), F.col("l_suppkey") % 3).alias("safe"), F.round(hit, 12).alias("hit"))


@query("""WITH l AS (SELECT DISTINCT 30 + p_partkey % 300 AS length FROM part), w AS (SELECT length, CAST(unnest(generate_series(1, length)) AS DOUBLE) AS i FROM l)
  SELECT length, round(CASE WHEN length < 150.0 - 5 * 20 THEN 1 ELSE greatest(1, sum((length - i + 1) * exp(-(((i - 150.0) / 20) ** 2) / 2)) / sum(exp(-(((i - 150.0) / 20) ** 2) / 2))) END, 6) AS eff_len FROM w GROUP BY length""")
def eff_len_rsem(spark, sf):
    lengths = _table(spark, sf, "part").select((30 + F.col("p_partkey") % 300).alias("length")).distinct()
    return with_effective_length(lengths, 150.0, 20.0, "rsem").select("length", F.round("eff_len", 6).alias("eff_len"))


def _annotation(spark, sf) -> str:
    """One transcript a part, of one to three exons 1000 bases apart, on chr<1 to 5> or chrX; also comments, features, broken lines and reversed exons."""
    p = _table(spark, sf, "part")
    chrom = F.when(F.col("p_size") % 6 == 0, "chrX").otherwise(F.concat(F.lit("chr"), F.col("p_size") % 6))
    at = F.col("p_partkey") * 10
    e = p.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))))
    start, end = at + 1000 * F.col("k") + 1, at + 1000 * F.col("k") + 100 + F.col("p_size")
    names = F.concat(F.lit('gene_id "'), "p_brand", F.lit("|"), "p_size", F.lit('"; transcript_id "T'), "p_partkey", F.lit("."), "p_size", F.lit('";'))
    strand = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")

    def line(feature: str, a: Column, b: Column) -> Column:
        return _tabs(chrom, F.lit("x"), F.lit(feature), a, b, F.lit("."), strand, F.lit("."), names)

    good = e.select(line("exon", start, end).alias("value"))
    genes = p.select(line("gene", at + 1, at + 2000 + 100 + F.col("p_size")).alias("value"))
    bad = p.where("p_partkey % 10 = 0").select(F.explode(F.array(F.lit("# comment"), line("CDS", at, at), line("exon", at + 50, at), F.lit("chr1\tx\texon\t1"))).alias("value"))
    return _file(good.unionByName(genes).unionByName(bad), "annotation")


_EXONS = """ex AS (SELECT CASE WHEN p_size % 6 = 0 THEN 'chrX' ELSE CAST(p_size % 6 AS VARCHAR) END AS chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  p_brand || '|' || p_size AS gene, 'T' || p_partkey || '.' || p_size AS isoform, p_partkey * 10 + 1000 * k + 1 AS "start", p_partkey * 10 + 1000 * k + 100 + p_size AS "end", k
  FROM part, (SELECT unnest([0, 1, 2]) AS k) WHERE k <= p_partkey % 3)"""


@query(f'WITH {_EXONS} SELECT chrom, strand, gene, isoform, "start", "end" FROM ex')
def gtf_exon_scan(spark, sf):
    return gtf.exons(spark, _annotation(spark, sf))


@query(f"""WITH {_EXONS} SELECT isoform, any_value(gene) AS gene, CASE WHEN any_value(chrom) = 'chrX' THEN 'X' ELSE any_value(chrom) END AS chrom, any_value(strand) AS strand,
  CAST(sum("end" - "start" + 1) AS BIGINT) AS transcript_length, CASE WHEN any_value(strand) = '+' THEN min("start") ELSE max("start") END AS first_start,
  CASE WHEN any_value(strand) = '+' THEN max("end") ELSE min("end") END AS last_end FROM ex GROUP BY isoform""")
def gtf_transcripts_for_repeats(spark, sf):
    t = gtf.transcripts_for_repeats(spark, _annotation(spark, sf))
    return t.select("isoform", "gene", "chrom", "strand", "transcript_length", F.col("exons")[0]["start"].alias("first_start"), F.element_at("exons", -1)["end"].alias("last_end"))


@query("""SELECT p_brand || '|' || p_size AS gene, CASE WHEN p_size % 6 = 0 THEN 'chrX' ELSE 'chr' || p_size % 6 END AS chrom, p_partkey * 10 + 1 AS "start", p_partkey * 10 + 2100 + p_size AS "end" FROM part""")
def gtf_gene_scan(spark, sf):
    return gtf.genes_of(spark, _annotation(spark, sf))


@query(f"""WITH {_EXONS} SELECT gene, isoform, chrom, strand, min("start") - 1 AS tx_start, max("end") AS tx_end, CAST(count(*) AS INTEGER) AS exon_count,
  string_agg(CAST("start" - 1 AS VARCHAR), ',' ORDER BY "start") AS starts, string_agg(CAST("end" AS VARCHAR), ',' ORDER BY "start") AS ends FROM ex GROUP BY gene, isoform, chrom, strand""")
def gene_predictions(spark, sf):
    return fasta.gene_predictions(gtf.exons(spark, _annotation(spark, sf)))


@query("""WITH c AS (SELECT 's' || s_suppkey AS name, repeat('ACGTTGCA' || substr('ACGT', 1 + CAST(s_suppkey % 4 AS INTEGER), 1), 40) AS sequence, s_suppkey FROM supplier),
  e AS (SELECT DISTINCT l_suppkey, l_suppkey || ':' || l_partkey AS isoform, l_partkey, 1 + l_partkey % 100 AS a, 20 + l_partkey % 100 AS b, 151 + l_partkey % 50 AS a2, 160 + l_partkey % 50 AS b2 FROM lineitem),
  j AS (SELECT isoform, l_partkey, substr(sequence, CAST(a AS INTEGER), 20) || substr(sequence, CAST(a2 AS INTEGER), 10) AS s FROM e JOIN c ON l_suppkey = s_suppkey)
  SELECT isoform, CASE WHEN l_partkey % 2 = 1 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS sequence FROM j""")
def fasta_transcripts(spark, sf):
    s = _table(spark, sf, "supplier")
    sequence = F.repeat(F.concat(F.lit("ACGTTGCA"), F.substring(F.lit("ACGT"), (1 + F.col("s_suppkey") % 4).cast("int"), F.lit(1))), F.lit(40))
    lines = s.select(F.concat_ws("\n", F.concat(F.lit(">s"), "s_suppkey", F.lit(" of a supplier")), F.substring(sequence, 1, 100), F.substring(sequence, 101, 1000)).alias("value"))
    genome = fasta.read_fasta(spark, _file(lines, "genome"))
    li = _table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    exon = F.array(F.struct((1 + F.col("l_partkey") % 100).alias("start"), (20 + F.col("l_partkey") % 100).alias("end")), F.struct((151 + F.col("l_partkey") % 50).alias("start"), (160 + F.col("l_partkey") % 50).alias("end")))
    e = li.select(F.concat(F.lit("s"), "l_suppkey").alias("chrom"), F.concat_ws(":", "l_suppkey", "l_partkey").alias("isoform"), F.when(F.col("l_partkey") % 2 == 1, "-").otherwise("+").alias("strand"), F.explode(exon).alias("x"))
    return fasta.transcript_sequences(e.select("chrom", "isoform", "strand", "x.start", "x.end"), genome)


def _repeats(spark, sf) -> str:
    p = _table(spark, sf, "part")
    at = F.col("p_partkey") * 7
    some = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit('transcript_id "n'), "p_partkey", F.lit('"; '))).otherwise("")
    more = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit('class_id "'), "p_brand", F.lit('"; locus "'), F.col("p_partkey") % 50, F.lit('"; consensus_length "'), "p_size", F.lit('";'))).otherwise("")
    names = F.concat(F.lit('gene_id "s'), "p_size", F.lit('"; family_id "'), "p_type", F.lit('"; '), some, more)
    line = _tabs(F.concat(F.lit("chr"), F.col("p_size") % 6), F.lit("x"), F.lit("exon"), at, at + F.col("p_size") - 1, F.lit("."), F.lit("+"), F.lit("."), names)
    return _file(p.coalesce(1).orderBy("p_partkey").select(line.alias("value")), "repeats")


_REPEATS = """rep AS (SELECT p_partkey, CAST(p_size % 6 AS VARCHAR) AS chrom, p_partkey * 7 AS te_start, p_partkey * 7 + p_size - 1 AS te_end,
  CASE WHEN p_partkey % 4 <> 0 THEN 'n' || p_partkey ELSE 's' || p_size END AS repeat_name, 's' || p_size AS subfamily, p_type AS family,
  CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE 'Unknown' END AS class, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 50 AS VARCHAR) ELSE (p_size % 6) || ':' || (p_partkey * 7) || '-' || (p_partkey * 7 + p_size - 1) END AS locus,
  CASE WHEN p_partkey % 5 <> 0 THEN p_size ELSE 0 END AS consensus_length FROM part WHERE p_size > 1)"""


@query(f"WITH {_REPEATS} SELECT chrom, te_start, te_end, repeat_name, subfamily, family, class, locus, te_end - te_start + 1 AS te_length, consensus_length FROM rep")
def gtf_repeat_scan(spark, sf):
    """Missing names are Unknown; elements of one base go."""
    r = gtf.repeats(spark, _repeats(spark, sf))
    return r.select("chrom", "te_start", "te_end", "repeat_name", "subfamily", "family", "class", "locus", "te_length", "consensus_length")


@query(f"WITH {_REPEATS} SELECT locus, max_by(subfamily, p_partkey) AS subfamily, max_by(family, p_partkey) AS family, max_by(consensus_length, p_partkey) AS consensus_length FROM rep GROUP BY locus")
def gtf_loci_last_row(spark, sf):
    return gtf.loci(gtf.repeats(spark, _repeats(spark, sf))).select("locus", "subfamily", "family", "consensus_length")


@query(f"""WITH {_REPEATS}, c AS (SELECT 'class' AS level, class AS label, count(*) AS n FROM rep GROUP BY class UNION ALL SELECT 'family', family, count(*) FROM rep GROUP BY family
  UNION ALL SELECT 'subfamily', subfamily, count(*) FROM rep GROUP BY subfamily) SELECT level, label, n AS "count", rank FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY level ORDER BY n DESC, label) AS INTEGER) AS rank FROM c) WHERE rank <= 5""")
def top_labels(spark, sf):
    return results.top_labels(gtf.repeats(spark, _repeats(spark, sf)))


@query("""WITH r AS (SELECT CAST(p_size % 6 AS VARCHAR) AS chrom, p_partkey AS s, p_partkey + p_size AS e, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand, 'r' || p_size AS sub,
  CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'c' || p_size % 3 END AS cls, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_brand END AS fam,
  p_size + 100 AS whole, p_size - 1 AS actual, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part)
  SELECT chrom || chr(9) || 'RepeatMasker' || chr(9) || 'exon' || chr(9) || s || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'gene_id "' || sub || '"; transcript_id "' || sub || '.' || k
  || '"; family_id "' || fam || '"; class_id "' || cls || '"; locus "' || chrom || ':' || s || '-' || e || '"; consensus_length "' || whole || '"; truncated_proportion "' || round(actual / whole, 3) || '";' AS value FROM r""")
def repeatmasker_to_gtf(spark, sf):
    """Serials follow the order of the file; on the other strand the positions in the repeat stand in reverse."""
    p = _table(spark, sf, "part").coalesce(1).orderBy("p_partkey")
    reverse = F.col("p_partkey") % 3 == 0
    left = F.lit("(100)")
    strand = F.when(reverse, "C").when(F.col("p_partkey") % 3 == 1, "+").otherwise("?")
    kind = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("c"), F.col("p_size") % 3, F.lit("/"), "p_brand"))
    ends = [F.when(reverse, left).otherwise("1"), F.col("p_size"), F.when(reverse, "1").otherwise(left)]
    row = [F.lit(" 10"), F.lit("1.0"), F.lit("0.0"), F.lit("0.0"), F.concat(F.lit("chr"), F.col("p_size") % 6), F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), left, strand,
           F.concat(F.lit("r"), "p_size"), kind, *ends, F.lit("1")]
    line = F.concat_ws("  ", *[x.cast("string") for x in row])
    head = spark.createDataFrame([("  SW   perc perc perc  query",), ("score  div. del. ins.  sequence begin end (left) repeat class/family begin end (left) ID x y z",), ("",)], "value string")
    lines = head.coalesce(1).unionByName(p.select(line.alias("value"))).coalesce(1)
    return results.element_gtf(gtf.read_repeatmasker(spark, _file(lines, "repeatmasker")))


def _alignments(spark, sf) -> str:
    li = _table(spark, sf, "lineitem").dropDuplicates(_LI)
    name = F.concat_ws("_", F.lit("x"), F.concat_ws(":", *_LI), F.concat(F.lit("B"), "l_suppkey", F.lit("-1")), F.concat(F.lit("U"), "l_orderkey"))
    rname = F.when(F.col("l_linenumber") == 7, "*").otherwise(F.concat(F.lit("T"), "l_partkey", F.lit("|x")))
    line = _tabs(name, F.col("l_orderkey"), rname, F.col("l_partkey"), F.col("l_quantity").cast("int"), _cigar(), F.lit("*"), F.lit(0), F.col("l_linenumber") - 3, F.lit("A"), F.lit("I"))
    head = _table(spark, sf, "part").select(F.concat(F.lit("@SQ\tSN:T"), "p_partkey", F.lit("|x\tLN:"), 50 + F.col("p_partkey") % 500).alias("value"))
    broken = spark.createDataFrame([("too\tfew",), ("",)], "value string")
    return _file(head.unionByName(li.select(line.alias("value"))).unionByName(broken), "alignments")


_ALIGNED = """al AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"""


@query(f"""WITH {_ALIGNED}, one AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k, max(l_quantity) AS q FROM al JOIN lineitem USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY ALL)
  SELECT 'x_' || k || '_B' || l_suppkey || '-1_U' || l_orderkey AS read, 'T' || l_partkey || '|x' AS chrom, l_partkey AS pos, 'B' || l_suppkey AS barcode, 'U' || l_orderkey AS umi, l_suppkey % 4 <> 0 AS spliced
  FROM one WHERE (l_orderkey & 2820) = 0 AND l_linenumber <> 7 AND q >= 10""")
def sam_long_reads(spark, sf):
    """By flags, quality and a mapped name; only repeated keys have several quantities, of which the file holds one."""
    li = _table(spark, sf, "lineitem")
    reads = sam.long_reads(sam.read_sam(spark, _alignments_of_largest(li)), MapSettings(multi_mapping="unique_only"))
    return reads.select("read", "chrom", "pos", "barcode", "umi", (F.size("blocks") == 2).alias("spliced"))


def _alignments_of_largest(li: DataFrame) -> str:
    one = li.groupBy(*_LI).agg(F.max("l_quantity").alias("l_quantity"))
    name = F.concat_ws("_", F.lit("x"), F.concat_ws(":", *_LI), F.concat(F.lit("B"), "l_suppkey", F.lit("-1")), F.concat(F.lit("U"), "l_orderkey"))
    rname = F.when(F.col("l_linenumber") == 7, "*").otherwise(F.concat(F.lit("T"), "l_partkey", F.lit("|x")))
    return _file(one.select(_tabs(name, F.col("l_orderkey"), rname, F.col("l_partkey"), F.col("l_quantity").cast("int"), _cigar(), F.lit("*"), F.lit(0), F.lit(0), F.lit("A"), F.lit("I")).alias("value")), "reads")


@query(f"WITH {_ALIGNED} SELECT 'x_' || k || '_B' || l_suppkey || '-1_U' || l_orderkey AS frag, 'T' || l_partkey AS isoform, CAST(l_linenumber - 3 AS BIGINT) AS frag_len FROM al WHERE l_linenumber > 3 AND l_linenumber <> 7 AND l_partkey % 2 = 0")
def sam_short_hits(spark, sf):
    known = _table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("T"), "p_partkey").alias("isoform"))
    return sam.short_hits(sam.read_sam(spark, _alignments(spark, sf)), known)


@query("""SELECT 'T' || p_partkey AS isoform, 50 + p_partkey % 500 AS length, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS known, (SELECT count(*) FROM part) AS every FROM part""")
def sam_references(spark, sf):
    """Header lines, and how many of their names the annotation knows."""
    refs = sam.reference_lengths(spark, _alignments(spark, sf))
    known, every = sam.check_references(refs, _table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("T"), "p_partkey").alias("isoform")))
    return refs.withColumn("known", F.lit(known).cast("long")).withColumn("every", F.lit(every).cast("long"))


@query("SELECT CAST(max(l_quantity) + 26 AS INTEGER) AS n, 150 AS none FROM lineitem")
def sam_read_length(spark, sf):
    """The length of the first read that has one: here all are as long as the largest quantity and 26 bases, with clips, gaps and insertions. Alignments without any give the usual length."""
    li = _table(spark, sf, "lineitem")
    most = li.agg(F.max("l_quantity").cast("int").alias("most"))
    name = F.concat_ws(":", "l_orderkey", "l_linenumber")
    cigar = F.concat(F.lit("5S"), F.col("most"), F.lit("M10N3D4I10=6X1S9H"))
    tail = [F.lit("*"), F.lit(0), F.lit(0), F.lit("A"), F.lit("I")]
    seen = li.crossJoin(F.broadcast(most)).select(_tabs(name, F.lit(0), F.lit("x"), F.lit(1), F.lit(9), cigar, *tail).alias("value"))
    unseen = li.select(_tabs(name, F.lit(4), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), *tail).alias("value"))
    found = sam.infer_read_length(sam.read_sam(spark, _file(unseen.unionByName(seen), "reads")))
    none = sam.infer_read_length(sam.read_sam(spark, _file(unseen, "reads")))
    return spark.createDataFrame([(found, none)], "n int, none int")


_COUNTS = "c AS (SELECT 'B' || l_suppkey AS barcode, 'T' || l_partkey AS isoform, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_COUNTS} SELECT barcode, isoform AS feature, p_brand || '|' || p_size AS alternate, CAST(n AS DOUBLE) AS value, round(n / sum(n) OVER (PARTITION BY barcode) * 1e6, 4) AS cpm
  FROM c JOIN part ON isoform = 'T' || p_partkey""")
def mex_round_trip(spark, sf):
    """Matrices are written and read again, with all features in order of their names."""
    c = _table(spark, sf, "lineitem").groupBy(F.concat(F.lit("B"), "l_suppkey").alias("barcode"), F.concat(F.lit("T"), "l_partkey").alias("isoform")).agg(F.sum("l_quantity").cast("long").alias("count"))
    features = _table(spark, sf, "part").select(F.concat(F.lit("T"), "p_partkey").alias("isoform"), F.concat_ws("|", "p_brand", "p_size").alias("gene"))
    path = new_dir(spark, "matrix")
    write_mex(c, f"{path}/isoform", features)
    return tables.read_mex_pair(spark, path).select("barcode", "feature", "alternate", "value", "cpm")


@query(f"""WITH {_COUNTS} SELECT count(DISTINCT barcode) AS cells, count(DISTINCT CASE WHEN n > 0 THEN barcode END) AS nonzero_cells, count(DISTINCT CASE WHEN n > 0 THEN isoform END) AS nonzero_isoforms,
  CAST(sum(n) AS BIGINT) AS total_counts FROM c""")
def cell_summary(spark, sf):
    c = _table(spark, sf, "lineitem").groupBy(F.concat(F.lit("B"), "l_suppkey").alias("barcode"), F.concat(F.lit("T"), "l_partkey").alias("isoform")).agg(F.sum("l_quantity").cast("long").alias("count"))
    return results.cell_summary(c)


@query("""SELECT l_suppkey AS barcode, count(*) AS reads, (SELECT count(*) FROM lineitem WHERE l_suppkey % 3 <> 0) AS rejected FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY l_suppkey""")
def whitelist_semijoin(spark, sf):
    s = _table(spark, sf, "supplier").where("s_suppkey % 3 = 0")
    lines = s.select(F.explode(F.array(F.concat(F.lit(" "), "s_suppkey"), F.col("s_suppkey").cast("string"), F.lit(""))).alias("value"))
    listed = tables.read_whitelist(spark, _file(lines, "whitelist")).select(F.col("barcode").cast("long").alias("barcode"))
    reads, rejected = whitelisted(_table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "barcode"), listed)
    return reads.groupBy("barcode").agg(F.count("*").alias("reads")).crossJoin(F.broadcast(rejected))


@query("SELECT 'B' || s_suppkey AS barcode, CAST(s_suppkey % 2 AS INTEGER) AS in_tissue, CAST(s_nationkey AS INTEGER) AS array_row, CAST(s_suppkey AS INTEGER) AS array_col, CAST(s_acctbal AS DOUBLE) AS x, 0.5 AS y FROM supplier")
def positions_scan(spark, sf):
    s = _table(spark, sf, "supplier")
    rows = s.select(F.concat_ws(",", F.concat(F.lit("B"), "s_suppkey"), F.col("s_suppkey") % 2, "s_nationkey", "s_suppkey", "s_acctbal", F.lit("0.5")).alias("value"))
    head = spark.createDataFrame([("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres",)], "value string")
    p = tables.read_positions(spark, _file(head.unionByName(rows), "positions"))
    return p.select("barcode", "in_tissue", "array_row", "array_col", F.col("pxl_row_in_fullres").alias("x"), F.col("pxl_col_in_fullres").alias("y"))


@query("""SELECT 'T' || p_partkey AS isoform, CAST(p_retailprice AS DOUBLE) AS tpm, tool FROM part, (SELECT unnest(['kallisto', 'salmon', 'rsem', 'sniffed']) AS tool)""")
def tool_results(spark, sf):
    """Tables of three tools, and one whose columns are known by their names."""
    p, out = _table(spark, sf, "part"), []
    for tool, names in {"kallisto": ("target_id", "tpm"), "salmon": ("Name", "TPM"), "rsem": ("transcript_id", "TPM"), "sniffed": ("ISOFORM_ID", "my_tpm_value")}.items():
        path = new_dir(spark, tool)
        results.write_table(p.select(F.concat(F.lit("T"), "p_partkey", F.lit("" if tool == "sniffed" else "|x")).alias(names[0]), F.col("p_retailprice").alias(names[1])), path)
        t = tables.read_quantified(spark, path) if tool == "sniffed" else tables.read_tool_result(spark, path, tool)
        out.append(t.withColumn("tool", F.lit(tool)))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""SELECT s_suppkey AS community, CAST(s_nationkey / 25 AS DOUBLE) AS alpha FROM supplier""")
def alpha_table(spark, sf):
    path = new_dir(spark, "alpha")
    results.write_table(_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.1).alias("error"), (F.col("s_nationkey") / 25).alias("alpha")), path)
    return tables.read_alpha(spark, path).select(F.col("community").cast("long").alias("community"), "alpha")


@query(f"""WITH {_COUNTS} SELECT barcode, CASE WHEN p_partkey IS NULL OR p_partkey % 3 = 0 THEN 'Gene-alone' ELSE 'k' || p_partkey % 3 END AS classification, CAST(sum(n) AS BIGINT) AS "count"
  FROM c LEFT JOIN part ON isoform = 'T' || p_partkey AND p_partkey % 3 <> 0 GROUP BY ALL""")
def unit_classes(spark, sf):
    """Isoforms without annotation are of the gene alone."""
    c = _table(spark, sf, "lineitem").groupBy(F.concat(F.lit("B"), "l_suppkey").alias("barcode"), F.concat(F.lit("T"), "l_partkey").alias("isoform")).agg(F.sum("l_quantity").cast("long").alias("count"))
    a = _table(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("T"), "p_partkey").alias("isoform"), F.concat(F.lit("k"), F.col("p_partkey") % 3).alias("classification"))
    return te.unit_classes(c, a)
