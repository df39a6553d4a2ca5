"""The corpus pipeline: five operators of gridloom.llm, each stage written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import MADE, swept
from gridloom.llm.op3_toxicity import without_toxic
from gridloom.llm.op4_suffix_dedup import without_repeats
from gridloom.llm.op5_decontaminate import decontaminate
from gridloom.llm.op6_mix_sources import mixed_documents
from gridloom.llm.op10_jaccard_join import one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects by their own text go. Null and empty texts stay, null and repeated ids are rows as others."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (5-word shingles, 0.8: the general rule; 3 and 0.9 bind only op10's query) the smallest doc_id stays.

    Rows with a null doc_id, and texts without words, all stay; rows of one doc_id are one document.
    """
    return one_of_each(docs, n=5, threshold=(8, 10)).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the 50-byte strings of smaller doc_ids; n_chars follows. Every row stays, null and repeated ids too (a null id counts as the largest)."""
    kind = docs.schema["n_chars"].dataType
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(kind)).select(COLUMNS)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth or more is covered by benchmark items go; the others stay as they are, null texts and ids too."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: each row with its whole repeats and the words of a last, cut pass. Null ids take part; texts without words are never taken."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_test_items),
    ("mixing sources", mix),
]

#: The stages' models, suffix arrays and components are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage made goes when its result is written; its input goes when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(MADE)
    for name, stage in STAGES:
        docs = swept(stage(spark, docs, sf_dir), name.replace(" ", "-"), since)
    return docs
