"""A training-corpus pipeline over documents: each stage works on what the one before it kept.

Defined results: a null or empty text is scored and packed like any other (it is the end token alone); of rows
equal up to white space, null and empty texts among them, one stays, also if ids repeat, and other texts of a
repeated id stay; rows with a null id are kept like others; an empty table gives no rows. Columns beyond
those of documents don't pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import drop_materialized, materialize, scratch, table
from dotloom.llm.exact_dedup import drop_exact_copies
from dotloom.llm.jaccard import keep_one_of_each
from dotloom.llm.packing import pack_documents
from dotloom.llm.suffix_dedup import cut_repeats
from dotloom.llm.toxicity import drop_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go."""
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, one row stays: that with the smallest doc_id."""
    return drop_exact_copies(docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, one row stays: that with the smallest doc_id."""
    return keep_one_of_each(docs).select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that also start elsewhere go; n_chars is that of the remaining text."""
    cut = cut_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left goes into sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("jaccard join", near_stage),
    ("suffix dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]
#: Hashed features and transducers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again, and what it was made from is deleted."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if number:
            drop_materialized(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
