"""Corpus pipeline over documents: quality filter, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontamination, ngram_join, packing, quality
from trailmark.llm.shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier scores 0.3 or more (learned from labels outside the held-out fold).

    Each row is judged by its own text (a null one as an empty one), repeated rows alike; all columns stay as they
    were, one named score too; ties at 0.3 stay; no rows, no rows.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = docs.toDF(*[f"c{k}_" if c not in ("doc_id", "text") else c for k, c in enumerate(docs.columns)])
    return quality.score_quality(plain, model).where(F.col("score") >= 0.3).drop("score").toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of linked texts, the one with the least doc_id (a null id where it has no other).

    Equal texts are one class, of equal ids in a class one row stays; rows with a null text stay; columns keep their names; no rows, no rows.
    """
    plain = docs.toDF(*[f"c{k}_" if c not in ("doc_id", "text") else c for k, c in enumerate(docs.columns)])
    return ngram_join.one_of_each_class(plain).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; rows with a null or empty text stay, repeated rows fare alike, columns of any name stay; no rows, no rows."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset: a null text is an empty one, repeated rows and null ids are documents of their own; no rows, no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None  # a learned model, components and packing are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
