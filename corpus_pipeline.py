"""A training corpus from documents: stages of the operators in strandflow.llm.

Each stage gets all that the one before it kept, written as Parquet in the shared folder and read again. All stages but the last return the columns of documents.
Of null, empty, repeated and very long texts each stage says what becomes of them; an empty table gives empty tables. Further columns pass through, whatever their names, up to
packing, which gives pieces of documents instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm._store import materialize
from strandflow.llm.mixing import mixed, word_count
from strandflow.llm.ngram_join import first_of_groups
from strandflow.llm.packing import pack
from strandflow.llm.substring_dedup import without_repeats
from strandflow.llm.toxicity import fit_on, learnable, without_toxic

#: Words of a passage that counts as repeated.
PASSAGE = 50


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by the threshold of their language go. Null texts are scored as empty ones; repeated rows go or stay together."""
    model = fit_on(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles link at a Jaccard similarity of 0.8, the smallest doc_id stays, once. Null texts and texts without words all stay."""
    return first_of_groups(docs, 5, 80, 100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE words and more that a document before has are cut out of texts. Null texts stay null; documents without an id count as later than all others."""
    return without_repeats(docs, PASSAGE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their curricula: documents repeat, end early or are left out, in the order of their positions. Documents without words are left out; a null source is one of its own."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of several lengths. Repeats are packed each; very long documents are cut at the longest length."""
    return pack(docs, word_count(F.col("text")))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier and best-fit packing are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
