"""Matrices, whitelists, positions and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MEX_FOLDERS = ("", "isoform", "isoform_matrix", "SC_output/isoform", "ST_output/isoform")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _file(spark: SparkSession, folder: str, name: str) -> str:
    for n in (name, f"{name}.gz"):
        if _exists(spark, f"{folder}/{n}"):
            return f"{folder}/{n}"
    raise FileNotFoundError(f"{folder}/{name}")


def find_mex(spark: SparkSession, folder: str) -> str:
    """The folder itself or the first of the usual ones below it that holds a matrix."""
    for f in _MEX_FOLDERS:
        at = f"{folder}/{f}".rstrip("/")
        if any(_exists(spark, f"{at}/matrix.mtx{z}") for z in ("", ".gz")):
            return at
    raise FileNotFoundError(f"no matrix.mtx below {folder}")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) with where they stand: file, block within it, and a number that grows within the block. Spark reads files, and their blocks, in an order of its own."""
    m = F.col("_metadata")
    return spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 1-based numbers, over all files of a folder in the order of their names. The window sees one row a block."""
    rows = _placed(spark, path)
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.withColumn("before", before), ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first") + 1).alias("no"), "value")


def _lists(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Features by row and barcodes by col, and how many there are of each."""
    barcodes = _numbered(spark, _file(spark, at, "barcodes.tsv")).select(F.col("no").alias("col"), F.trim("value").alias("barcode"))
    f = F.split("value", "\t")
    features = _numbered(spark, _file(spark, at, "features.tsv")).select(F.col("no").alias("row"), f[0].alias("feature"), F.try_element_at(f, F.lit(2)).alias("alternate"))
    return features, barcodes, [features.count(), barcodes.count()]


def _entries(spark: SparkSession, at: str, matrix: str, listed: list[int]) -> DataFrame:
    """row, col, value."""
    lines = _placed(spark, _file(spark, at, matrix)).where(~F.col("value").startswith("%"))
    first = lines.orderBy("file", "block", "id").first()
    size = [int(x) for x in first[0].split()] if first else [0, 0, 0]
    if listed != size[:2]:
        raise ValueError(f"the matrix in {at} has size {size[:2]}, its lists have {listed[0]} features and {listed[1]} barcodes")
    v = F.split(F.trim("value"), r"\s+")
    rest = lines.where((F.col("file") != first["file"]) | (F.col("block") != first["block"]) | (F.col("id") != first["id"])) if first else lines
    return rest.select(v[0].cast("long").alias("row"), v[1].cast("long").alias("col"), v[2].cast("double").alias("value"))


def read_mex(spark: SparkSession, folder: str, matrix: str = "matrix.mtx") -> DataFrame:
    """(barcode, feature, alternate, value) of a sparse matrix: features are rows and barcodes columns, counted from 1, plain or gzip.

    A matrix whose size line disagrees with the lists of barcodes and features is an error.
    """
    at = find_mex(spark, folder)
    features, barcodes, listed = _lists(spark, at)
    return _entries(spark, at, matrix, listed).join(features, "row").join(barcodes, "col").select("barcode", "feature", "alternate", "value")


def read_mex_pair(spark: SparkSession, folder: str, matrix: str = "matrix.mtx", cpm: str = "cpm_matrix.mtx") -> DataFrame:
    """(barcode, feature, alternate, value, cpm) of the entries that both matrices have: they meet by their numbers, and get their names once."""
    at = find_mex(spark, folder)
    features, barcodes, listed = _lists(spark, at)
    both = _entries(spark, at, matrix, listed).join(_entries(spark, at, cpm, listed).withColumnRenamed("value", "cpm"), ["row", "col"])
    return both.join(features, "row").join(barcodes, "col").select("barcode", "feature", "alternate", "value", "cpm")


def read_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """chrom, gene, region, coordinates, abundance, isoforms, row: design matrices that results.write_matrices wrote, with all columns in the order of the isoforms' names. Rows get their isoforms last,
    so that no whole row is shuffled."""
    text = spark.read.option("sep", "\t").option("header", True)
    rows = text.schema("region string, coordinates string, abundance double, columns string, chrom string, gene string").csv(f"{folder}/matrix_info")
    each = text.schema("chrom string, gene string, isoform string, k int").csv(f"{folder}/matrix_isoforms")
    sorted_ = each.groupBy("chrom", "gene").agg(F.sort_array(F.collect_list(F.struct("isoform", "k"))).alias("each"))
    names = sorted_.select("chrom", "gene", F.array_join("each.isoform", ",").alias("isoforms"), F.col("each.k").alias("ks"))
    found = rows.withColumn("columns", F.split("columns", ",")).join(names, ["chrom", "gene"])
    row = F.array_join(F.transform("ks", lambda k: F.element_at("columns", k)), ",").alias("row")
    return found.select("chrom", "gene", "region", "coordinates", "abundance", "isoforms", row)


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("barcode")).where("barcode <> ''").distinct()


_POSITIONS = "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double"


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Spot positions; a header is known by its first word."""
    rows = spark.read.schema(_POSITIONS).csv(path, header=False, mode="PERMISSIVE")
    return rows.where(~F.lower("barcode").startswith("barcode"))


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def read_alpha(spark: SparkSession, path: str) -> DataFrame:
    """community and alpha from a table of two columns, or of three with an error between them."""
    t = read_table(spark, path)
    return t.select(F.col(t.columns[0]).alias("community"), F.col(t.columns[-1]).cast("double").alias("alpha"))


def read_tool_result(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """isoform and tpm from kallisto's, salmon's or RSEM's table."""
    t = read_table(spark, path)
    isoform, tpm = {"kallisto": ("target_id", "tpm"), "salmon": ("Name", "TPM"), "rsem": ("transcript_id", "TPM")}[tool]
    return t.select(F.split_part(isoform, F.lit("|"), F.lit(1)).alias("isoform"), F.col(tpm).cast("double").alias("tpm"))


#: Names of columns in result tables, in order of preference.
ID_COLUMNS = ("transcript_id", "Isoform", "isoform_id", "target_id", "Name")
TPM_COLUMNS = ("TPM", "tpm", "Tpm", "IsoTPM", "transcript_TPM")


def detect_column(columns: list[str], names: tuple[str, ...], contains: str | None = None, only: bool = False) -> str:
    """The first of names that is a column, exactly or but for case; else one that contains a text. only: that must be a single one."""
    lower = {c.lower(): c for c in reversed(columns)}
    for n in names:
        if n in columns:
            return n
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    found = [c for c in columns if contains and contains in c.lower()]
    if not found or only and len(found) > 1:
        raise ValueError(f"no single column of {columns} is one of {names}")
    return found[0]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: Names of result files of other runs, in order of preference.
RESULT_FILES = ("Isoform_abundance.out", "isoform_abundance.out", "expression_isoform.out", "LR_EM_expression.out", "SR_EM_expression.out")


def first_result(spark: SparkSession, folder: str, candidates: tuple[str, ...] = RESULT_FILES) -> str:
    """The first of the candidates that the folder has."""
    for name in candidates:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"{folder} has none of {', '.join(candidates)}")


def read_quantified(spark: SparkSession, path: str) -> DataFrame:
    """isoform and tpm of a result table whose columns are known by their names."""
    t = read_table(spark, path)
    return t.select(F.col(f"`{detect_column(t.columns, ID_COLUMNS)}`").cast("string").alias("isoform"), F.col(f"`{detect_column(t.columns, TPM_COLUMNS, 'tpm')}`").cast("double").alias("tpm"))
