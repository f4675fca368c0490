"""Queries of files and tables that a run leaves, and of small operators that others hold, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.config import EmSettings, KSettings
from strandflow.operators import annotation, assign, te
from strandflow.operators import regions as reg
from strandflow.operators.em import bulk_history
from strandflow.operators.features import nearest_model
from strandflow.operators.identifiability import design_matrix
from strandflow.operators.matrix import gene_counts, write_mex
from strandflow.operators.store import materialize, new_dir
from strandflow.plans import contract, models
from strandflow.plans.contract import query as register
from strandflow.sinks import results
from strandflow.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    return register(sql, QUERIES, ORACLE_SQL)


def _table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("""SELECT 'first' AS run, 'T' || p_partkey AS isoform, CAST(p_size AS DOUBLE) AS tpm FROM part UNION ALL SELECT 'second', 'T' || p_partkey, CAST(p_partkey % 100 AS DOUBLE) FROM part""")
def results_by_candidates(spark, sf):
    """Another run's results by an ordered list of names: one folder has the second and the fourth, the other only the last."""
    p = _table(spark, sf, "part").withColumn("Isoform", F.concat(F.lit("T"), "p_partkey"))
    one, two = new_dir(spark, "first"), new_dir(spark, "second")
    results.write_table(p.select("Isoform", F.col("p_size").alias("TPM")), f"{one}/{tables.RESULT_FILES[1]}")
    results.write_table(p.select("Isoform", F.lit(-1).alias("TPM")), f"{one}/{tables.RESULT_FILES[3]}")
    results.write_table(p.select(F.col("Isoform").alias("transcript_id"), (F.col("p_partkey") % 100).alias("my_tpm")), f"{two}/{tables.RESULT_FILES[4]}")
    found = [tables.read_quantified(spark, tables.first_result(spark, d)).withColumn("run", F.lit(n)) for d, n in ((one, "first"), (two, "second"))]
    return found[0].unionByName(found[1]).select("run", "isoform", "tpm")


@query(f"""WITH {models._READ}, w AS (SELECT gene, region, isoform, {models._EFF} AS weight FROM regi), v AS (SELECT gene, region, isoform, weight / sum(weight) OVER (PARTITION BY gene, isoform) AS value FROM w),
  i AS (SELECT DISTINCT gene, isoform FROM regi), g AS (SELECT gene, string_agg(isoform, ',' ORDER BY isoform) AS isoforms FROM i GROUP BY gene),
  c AS (SELECT x.gene, region, string_agg(s || ':' || e, '-' ORDER BY s) AS coordinates FROM (SELECT gene, region, unnest(string_split(region, '-')) AS part FROM reg) x JOIN atom a ON a.gene = x.gene AND part = 'P' || p || ':P' || (p + 1) GROUP BY x.gene, region),
  r AS (SELECT reg.gene, reg.region, string_agg(printf('%.6f', coalesce(value, 0)), ',' ORDER BY i.isoform) AS "row" FROM reg JOIN i ON i.gene = reg.gene LEFT JOIN v ON v.gene = reg.gene AND v.region = reg.region AND v.isoform = i.isoform GROUP BY ALL)
  SELECT gene, region, coordinates, round(CAST(reads AS DOUBLE), 6) AS abundance, g.isoforms, "row" FROM rr JOIN c USING (gene, region) JOIN g USING (gene) JOIN r USING (gene, region)""")
def matrix_info(spark, sf):
    """The design matrix of every gene, written by gene and read again."""
    r = materialize(models._regions(spark, sf), "regions")
    a = reg.abundance(r.join(models._region_reads(r), ["chrom", "gene", "region"]))
    rows, isoforms = results.matrix_dump(design_matrix(r, KSettings(read_length=80)), a, annotation.point_index(annotation.atoms(models._exons(spark, sf))), digits=6)
    path = new_dir(spark, "matrices")
    few = [t.withColumn("gene", F.regexp_replace("gene", r"\|", "~")) for t in (rows, isoforms)]
    results.write_matrices(*few, path)
    back = tables.read_matrices(spark, path)
    return back.select(F.regexp_replace("gene", "~", "|").alias("gene"), "region", "coordinates", F.round("abundance", 6).alias("abundance"), "isoforms", "row")


_ITERATIONS = f"""WITH {contract._COND}, {contract._rounds(3, "cond")}, links AS (SELECT 1),
  every AS (SELECT 1 AS iteration, isoform, t FROM t1 UNION ALL SELECT 2, isoform, t FROM t2 UNION ALL SELECT 3, isoform, t FROM t3)
  SELECT every.isoform AS "Isoform", gene AS "Gene", CAST(iteration AS INTEGER) AS iteration, round(t, 6) AS reads FROM every JOIN iso USING (isoform)"""


def _iterations(spark, sf, s: EmSettings):
    cond = contract._class_communities(spark, sf)[0]
    n = cond.select("community", "read", "n").distinct().groupBy("community").agg(F.sum("n").alias("n"))
    h = contract._of_alike(spark, sf, bulk_history(cond, s))
    t = results.iterations(h, contract._isoforms(spark, sf)).join(n, "community")
    return t.select("Isoform", "Gene", "iteration", F.round(F.col("theta") * F.col("n"), 6).alias("reads"))


@query(_ITERATIONS)
def em_iterations(spark, sf):
    """The thetas after each of three rounds, times their community's reads; with this tolerance no community stands still before."""
    return _iterations(spark, sf, EmSettings(iterations=3, tolerance=-1.0))


@query(_ITERATIONS)
def em_iterations_joined(spark, sf):
    """The form for communities that no task can hold."""
    return _iterations(spark, sf, EmSettings(iterations=3, tolerance=-1.0, rows_in_task=0))


@query("""WITH c AS (SELECT l_suppkey AS b, p_brand AS gene, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT 'B' || b AS barcode, gene AS feature, gene AS alternate, CAST(n AS DOUBLE) AS value FROM c WHERE n > 0""")
def gene_mex_round_trip(spark, sf):
    """A matrix of genes on disk, and read again."""
    li = _table(spark, sf, "lineitem").groupBy(F.concat(F.lit("B"), "l_suppkey").alias("barcode"), F.col("l_partkey").alias("isoform")).agg(F.sum("l_quantity").cast("long").alias("count"))
    iso = _table(spark, sf, "part").select(F.col("p_partkey").alias("isoform"), F.col("p_brand").alias("gene"))
    path = new_dir(spark, "genes")
    write_mex(gene_counts(li, iso), path, iso.select("gene"), "gene")
    return tables.read_mex(spark, path)


@query(f"WITH {models._REGIONS} SELECT gene, region FROM reg WHERE n_atoms <= 2")
def single_exons_and_junctions(spark, sf):
    return reg.single_exons_and_junctions(models._regions(spark, sf)).select("gene", "region")


@query("""WITH s AS (SELECT DISTINCT p_brand || '|' || p_size AS gene FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0), l AS (SELECT DISTINCT p_brand || '|' || p_size AS gene FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber % 2 = 1 AND p_size > 10)
  SELECT gene FROM s INTERSECT SELECT gene FROM l""")
def genes_of_both_kinds(spark, sf):
    li = _table(spark, sf, "lineitem").join(_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("gene", F.concat_ws("|", "p_brand", "p_size"))
    return assign.in_both(li.where("l_linenumber % 2 = 0"), li.where("l_linenumber % 2 = 1 AND p_size > 10"), ["gene"])


@query("SELECT p_brand AS gene, sum(CAST(p_retailprice AS DECIMAL(18, 2)))::DOUBLE AS tpm FROM part GROUP BY p_brand")
def gene_totals(spark, sf):
    t = _table(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.col("p_retailprice").cast("decimal(18,2)").alias("tpm"))
    return assign.gene_tpm(t).select("gene", F.col("tpm").cast("double").alias("tpm"))


@query("""SELECT round(count(*) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 30)) / count(*), 9) AS rate FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
def share_of_known_features(spark, sf):
    f = _table(spark, sf, "lineitem").select(F.concat(F.lit("T"), "l_partkey").alias("feature")).distinct().withColumn("alternate", F.lit(None).cast("string"))
    known = _table(spark, sf, "part").where("p_size <= 30").select(F.concat(F.lit("T"), "p_partkey").alias("isoform"))
    return spark.createDataFrame([(round(te.match_rate(te.resolve(f, known)), 9),)], "rate double")


@query("""WITH m AS (SELECT DISTINCT p_size % 7 * 5 AS lr, p_size % 5 * 10 AS sr FROM part), t AS (SELECT r_regionkey, r_regionkey * 9 AS lr, r_regionkey * 8 AS sr FROM region),
  k AS (SELECT r_regionkey, 'LR' || m.lr || 'M_SR' || m.sr || 'M.model' AS model, row_number() OVER (PARTITION BY r_regionkey ORDER BY abs(t.lr - m.lr), abs(t.sr - m.sr), m.lr, m.sr) AS k FROM t, m)
  SELECT r_regionkey, model FROM k WHERE k = 1""")
def models_by_coverage(spark, sf):
    """Of models named by their numbers of reads, in millions, the nearest to each of some runs."""
    made = _table(spark, sf, "part").select((F.col("p_size") % 7 * 5).alias("lr"), (F.col("p_size") % 5 * 10).alias("sr")).distinct().orderBy("lr", "sr")
    names = [f"LR{r['lr']}M_SR{r['sr']}M.model" for r in made.collect()]  # a name a model
    runs = [r[0] for r in _table(spark, sf, "region").select("r_regionkey").collect()]
    return spark.createDataFrame([(k, nearest_model(names, k * 8_000_000, k * 9_000_000)) for k in runs], "r_regionkey long, model string")


@query("""SELECT row_number() OVER (ORDER BY p_brand, p_size, p_partkey) AS line, p_brand AS "Gene", p_partkey AS "Isoform" FROM part""")
def ordered_table(spark, sf):
    """A table in a global order: the lines of its parts, one after the other."""
    path = new_dir(spark, "ordered")
    t = _table(spark, sf, "part").select(F.col("p_brand").alias("Gene"), "p_size", F.col("p_partkey").alias("Isoform"))
    results.write_table(t, path, ["Gene", "p_size", "Isoform"])
    lines = spark.read.option("sep", "\t").option("header", True).schema("Gene string, p_size long, Isoform long").csv(path)
    from pyspark.sql import Window

    of_part = lines.select("*", F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("n"))
    return of_part.select(F.row_number().over(Window.orderBy("part", "n")).cast("long").alias("line"), "Gene", "Isoform")


@query(f"""WITH {models._REGIONS}, w AS (SELECT gene, region, isoform, CASE WHEN n_atoms > 2 AND (300 - inner_len - 1) / 300 > 0 AND (300 - inner_len - 1) / 300 <= 1 THEN (300 - inner_len - 1) / 300 ELSE 1 END AS weight FROM regi)
  SELECT gene, region, isoform, round(weight / sum(weight) OVER (PARTITION BY gene, isoform), 9) AS value FROM w""")
def design_minus_inner(spark, sf):
    """Weights by the bases of a read beyond a region's inner exons."""
    return design_matrix(models._regions(spark, sf), KSettings(read_length=300, minus_inner=True)).select("gene", "region", "isoform", F.round("value", 9).alias("value"))


@query("""SELECT n_nationkey, (['transcript_id', 'ISOFORM', 'target_id', 'name'])[1 + n_nationkey % 4] AS id, (['TPM', 'tpm', 'IsoTPM', 'mean_tpm_of_runs'])[1 + n_nationkey // 4 % 4] AS tpm FROM nation""")
def sniffed_columns(spark, sf):
    """The columns of names and values among others, exactly, but for case, or by a part of the name."""
    rows = []
    for r in _table(spark, sf, "nation").select("n_nationkey").collect():  # a table a nation
        k = r[0]
        columns = ["length", ("transcript_id", "ISOFORM", "target_id", "name")[k % 4], "eff_length", ("TPM", "tpm", "IsoTPM", "mean_tpm_of_runs")[k // 4 % 4]]
        rows.append((k, tables.detect_column(columns, tables.ID_COLUMNS), tables.detect_column(columns, tables.TPM_COLUMNS, "tpm")))
    return spark.createDataFrame(rows, "n_nationkey long, id string, tpm string")
