"""Genome sequences and transcripts cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.text import reverse_complement


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and sequence; a record reaches from one > to the next."""
    r = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^([^\s]+)", 1)
    return r.select(head.alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def transcript_sequences(exons: DataFrame, genome: DataFrame) -> DataFrame:
    """isoform and sequence: exons (chrom, strand, isoform, start, end) cut out and joined, reverse-complemented on the minus strand.

    Each exon is cut before grouping, so that a chromosome is never copied for a transcript.
    """
    pieces = exons.join(genome.withColumnRenamed("name", "chrom"), "chrom").select(
        "isoform", "strand", "start", F.substring("sequence", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")).alias("piece")
    )
    joined = pieces.groupBy("isoform").agg(F.first("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return joined.select("isoform", F.when(F.col("strand") == "-", reverse_complement(text)).otherwise(text).alias("sequence"))


def gene_predictions(exons: DataFrame) -> DataFrame:
    """genePred lines: gene, isoform, chrom, strand, bounds, exon count, starts from 0 and ends."""
    e = exons.groupBy("gene", "isoform", "chrom", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("e"))
    starts = F.array_join(F.transform("e", lambda x: (x["start"] - 1).cast("string")), ",")
    ends = F.array_join(F.transform("e", lambda x: x["end"].cast("string")), ",")
    low, high = F.array_min(F.transform("e", lambda x: x["start"])) - 1, F.array_max(F.transform("e", lambda x: x["end"]))
    return e.select("gene", "isoform", "chrom", "strand", low.alias("tx_start"), high.alias("tx_end"), F.size("e").alias("exon_count"), starts.alias("starts"), ends.alias("ends"))
