"""Counts of units and isoforms: apportionment, counts per million, roll-ups, and sparse matrices on disk."""

from __future__ import annotations

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.operators.store import materialize

#: Bytes of a matrix that are put together by copying.
COPIED = 256 << 20


def apportion(theta: DataFrame, keys: list[str]) -> DataFrame:
    """theta (keys, isoform, theta, n) -> count: floor(theta n), and one more for the largest remainders until n are given out. Of equal remainders the higher isoform comes first.

    Remainders are equal if they agree in nine places: what a double makes of equal shares differs in the last bits.
    """
    share = F.col("theta") * F.col("n")
    t = theta.withColumn("count", F.floor(share)).withColumn("__rest", F.round((share - F.floor(share)) * 1e9))
    order = Window.partitionBy(*keys).orderBy(F.col("__rest").desc(), F.col("isoform").desc())
    t = t.withColumn("__k", F.row_number().over(order)).withColumn("__short", F.col("n") - F.sum("count").over(Window.partitionBy(*keys)))
    return t.withColumn("count", F.col("count") + (F.col("__k") <= F.col("__short")).cast("long")).drop("__k", "__rest", "__short")


def per_million(counts: DataFrame, unit: str = "barcode", count: str = "count") -> DataFrame:
    """counts with cpm, by unit; a unit without counts has 0."""
    total = F.sum(count).over(Window.partitionBy(unit))
    return counts.withColumn("cpm", F.col(count) / F.when(total == 0, 1).otherwise(total) * 1e6)


def gene_counts(counts: DataFrame, isoforms: DataFrame) -> DataFrame:
    """barcode, gene, count. The isoforms' table is joined as Catalyst sees fit, by its size."""
    return counts.join(isoforms.select("isoform", "gene"), "isoform").groupBy("barcode", "gene").agg(F.sum("count").alias("count"))


def write_mex(counts: DataFrame, path: str, features: DataFrame | None = None, row: str = "isoform", version: str = "strandflow") -> None:
    """The files barcodes.tsv, features.tsv, matrix.mtx and cpm_matrix.mtx in a folder: names sorted, entries counted from 1.

    counts: barcode, row and count. features: row, and gene for the second column; without it, the rows that have counts. Barcodes without counts have no column.
    Names get their numbers by a global sort with a count of each partition before, so that no single task sees them all; files are put together from
    the sorted parts.
    """
    spark = counts.sparkSession
    c = materialize(per_million(counts.where(F.col("count") != 0)), "counts")
    listed = c.select(row, F.col(row).alias("__of")) if features is None else features.select(row, F.col("gene").alias("__of"))
    rows, cols = _ordinals(listed.dropDuplicates([row]), row, "row"), _ordinals(c.select("barcode").distinct(), "barcode", "col")
    _write_lines(cols.orderBy("col").select("barcode"), f"{path}/barcodes.tsv")
    _write_lines(rows.orderBy("row").select(F.concat_ws("\t", row, "__of", F.lit("Gene Expression"))), f"{path}/features.tsv")
    e = materialize(c.join(rows.drop("__of"), row).join(cols, "barcode").select("row", "col", "count", "cpm"), "entries")
    size = f"{rows.count()} {cols.count()} {e.count()}"
    kinds = {"matrix.mtx": "integer", "cpm_matrix.mtx": "real"}
    head = [(0, i, name, x) for name, kind in kinds.items() for i, x in enumerate((f"%%MatrixMarket matrix coordinate {kind} general", f'%metadata_json: {{"software_version": "{version}"}}', size))]
    at = F.concat_ws(" ", "row", "col")
    lines = F.array(F.struct(F.lit("matrix.mtx").alias("name"), F.concat_ws(" ", at, "count").alias("value")), F.struct(F.lit("cpm_matrix.mtx").alias("name"), F.concat_ws(" ", at, F.format_string("%.4f", "cpm")).alias("value")))
    # Entries are put in order once; each part then has its lines of both files.
    top = spark.createDataFrame(head, "col long, row long, name string, value string").groupBy("col", "row").agg(F.collect_list(F.struct("name", "value")).alias("lines"))
    both = top.select("col", "row", F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("cpm"), "lines").unionByName(e.select("col", "row", F.col("count").cast("long"), "cpm", F.lit(None).cast(top.schema["lines"].dataType).alias("lines")))
    both = both.repartitionByRange("col", "row").select("col", "row", F.inline(F.coalesce("lines", lines)))
    both = both.sortWithinPartitions("name", "col", "row").select("name", "value")
    parts = f"{path}/entries.parts"
    both.write.mode("overwrite").partitionBy("name").text(parts)
    for name in kinds:
        _put_together(spark, f"{parts}/name={name}", f"{path}/{name}")
    _filesystem(spark, parts)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(parts), True)


def _write_lines(lines: DataFrame, path: str) -> None:
    """All lines in their order, from parts that are written at once. Up to COPIED bytes become one file by copying. Beyond that nothing goes through the driver: a store that can put files together
    does so, in others the ordered parts stay as a folder of that name, which the readers of this library take as well."""
    parts = f"{path}.parts"
    lines.write.mode("overwrite").text(parts)
    _put_together(lines.sparkSession, parts, path)


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _put_together(spark: SparkSession, parts: str, path: str) -> None:
    """The folder of parts becomes the file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    (fs, folder), to = _filesystem(spark, parts), jvm.org.apache.hadoop.fs.Path(path)
    found = sorted(((str(f.getPath()), f.getLen()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")))
    fs.delete(to, True)
    if sum(n for _, n in found) > COPIED:
        filled = [jvm.org.apache.hadoop.fs.Path(p) for p, n in found if n]
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(filled) - 1)
        for i, p in enumerate(filled[1:]):
            rest[i] = p
        try:
            if len(filled) > 1:
                fs.concat(filled[0], rest)
            fs.rename(filled[0], to)
            fs.delete(folder, True)
        except UnsupportedOperationException:
            fs.rename(folder, to)
        return
    out = fs.create(to, True)
    for p, _ in found:
        part = fs.open(jvm.org.apache.hadoop.fs.Path(p))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
    out.close()
    fs.delete(folder, True)


def _ordinals(names: DataFrame, name: str, to: str) -> DataFrame:
    part = materialize(names.orderBy(name).withColumn("__p", F.spark_partition_id()), "names")
    before = part.groupBy("__p").count().withColumn("__at", F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    k = F.row_number().over(Window.partitionBy("__p").orderBy(name))
    return part.join(before, "__p").withColumn(to, F.coalesce("__at", F.lit(0)) + k).drop("__p", "__at", "count")
