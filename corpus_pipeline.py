"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import packing, quality_rules, secret_scan, simhash_dedup, substring_dedup
from wordloom.llm.shared import Scratch, gathered, table


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars counted anew where there is one."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    return quality_rules.judge(docs).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return simhash_dedup.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that came earlier, in this or another document, go from the text."""
    return _like(docs, substring_dedup.dedup(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to a mark."""
    model = secret_scan.train(secret_scan.identifiers(docs))
    return _like(docs, secret_scan.redact(secret_scan.find(docs, model)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality_rules", rules), ("simhash_dedup", near_duplicates), ("substring_dedup", passages), ("secret_scan", secrets), ("packing", sequences)]

#: Near duplicates, fitted models and tokens are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage left in the shared folder goes once its result is written, but for the last stage's, which is read lazily."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        with gathered() as made:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        for done in made:
            done.drop()
        if at:
            scratch.drop(STAGES[at - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
