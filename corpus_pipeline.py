"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, table, text_or_empty
from graphloom.llm.decontaminate import contaminated
from graphloom.llm.line_dedup import drop_recurring_lines
from graphloom.llm.packing import pack
from graphloom.llm.queries import toxicity_model
from graphloom.llm.simhash import near_duplicates
from graphloom.llm.toxicity import score_toxicity


def _text_hash() -> Column:
    return F.xxhash64(text_or_empty().cast("binary"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.3 or more) go. Null and empty texts stay where the share of toxic labels is less than that."""
    return score_toxicity(docs, toxicity_model(spark, sf_dir), keep=docs.columns, name="__score").where("__score < 0.3").drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go, but in the first text; every document stays, with n_chars of what is left of its text (a null text keeps its n_chars)."""
    kept = drop_recurring_lines(docs, with_counts=False)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity of 0.8 or more over five-word shingles) the document of the smallest id stays. Candidates differ in at most 48 of 192 bits: those of similarity 0.8 differ in 29, with a standard deviation of 5. They have two equal bytes in one third of the fingerprint, which is sure with four equal bytes and lacking for one pair in fifty right at 0.8. Rows without an id go if they are copies of one that has one, else they stay; rows that share an id are told apart by their texts, and repeated rows stay or go together."""
    found = near_duplicates(docs, shingle=5, bits=192, radius=48, shared=4, width=2, similarity=0.8)
    gone = found.where("id <> component or id is null and component is not null").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_hash() == F.col("__hash")), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. What counts is the text, whatever the ids are."""
    found = contaminated(docs.select(_text_hash().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("doc_id").alias("__hash")).distinct(), _text_hash() == F.col("__hash"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens."""
    return pack(docs, length=1024, with_ids=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL cannot express these stages; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
