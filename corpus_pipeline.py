"""The corpus pipeline: toxicity, exact dedup, near duplicates, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and
returns a DataFrame; :func:`run` writes each stage's rows as Parquet to the shared
folder and reads them again for the next.  All stages but the last return the columns
of ``documents``, extra ones too.  Stages drop rows by id and text together or by the
row itself, so nulls and repeats among the ids take no other text with them.  An empty
table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from sparkwright.llm.common import Scratch, remainder, table
from sparkwright.shipping import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more; the model learns from four fifths of the labels."""
    ship(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the row with the smallest id stays."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8 the row with the smallest id stays."""
    ship(spark)
    return jaccard_join.drop_near_copies(docs)


def drop_leaking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    ship(spark)
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    ship(spark)
    return bpe.encode_decode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaking),
    ("bpe", tokenise),
]

#: Learned and approximate stages have no SQL; tests/llm/test_pipeline.py compares the pipeline with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
