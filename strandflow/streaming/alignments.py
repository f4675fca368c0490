"""Alignments that arrive as files while a run of the sequencer goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandflow.config import MapSettings
from strandflow.sources.sam import long_reads, parse_lines


def arriving_reads(spark: SparkSession, folder: str, m: MapSettings = MapSettings()) -> DataFrame:
    """Usable long reads of all SAM files in folder and of those to come. No state: each line stands for itself."""
    return long_reads(parse_lines(spark.readStream.text(folder)), m)


def arriving_molecules(reads: DataFrame) -> DataFrame:
    """barcode and umi of each molecule, once. The state holds every molecule, as the result does."""
    return reads.where("barcode IS NOT NULL").select("barcode", "umi").dropDuplicates(["barcode", "umi"])


def gather(rows: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the rows of a stream to Parquet in folder, each exactly once, also after a restart from checkpoint. once: take what is there, then end."""
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
