"""Corpus cleaning pipeline over `documents`: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Null and empty texts
fail the quality rules. A null or unlisted lang, or no such column, adds to no reference. Rows may repeat
and share or lack a doc_id: near duplicates are told apart by row, and of a group that row stays which has
the smallest doc_id (rows without one come last), of several such rows any one. Columns beyond those of
documents, whatever their names but for backticks, are carried along by every stage but the last. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplefold.llm.common import MADE, all_columns, read_table, removed, settled, written
from ripplefold.llm.jaccard_join import join_documents
from ripplefold.llm.packing import pack_documents
from ripplefold.llm.quality_rules import judged
from ripplefold.llm.secret_scan import redacted
from ripplefold.llm.toxicity import without_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    whole = docs.select(F.struct(*all_columns(docs)).alias("row"), "text", lang.alias("lang"))
    settled(spark)  # what the driver still holds of earlier jobs
    kept = judged(whole, keep=["row", "lang"]).where("kept").select("row.*")
    settled(spark)  # the plans of the measures, which are written by now
    return kept


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier lets pass."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    numbered = written(docs.select(F.struct(*all_columns(docs)).alias("row"), F.monotonically_increasing_id().alias("number")))
    groups = join_documents(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), width=5, num=80, den=100)
    groups = groups.select(F.col("doc_id").alias("number"), "component_id").join(numbered.select("number", F.col("row.doc_id").alias("id")), "number")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number"))["number"]
    kept = groups.groupBy("component_id").agg(first.alias("number")).select("number")
    return numbered.join(kept, "number", "left_semi").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret found replaced by a mark."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences that hold the documents' pieces."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("packing", packing)]
ORACLE_SQL = None  # SQL can't express the classifier and the tokenizer; tests/llm compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = read_table(spark, sf_dir, "documents"), set(MADE.paths)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        removed(spark, *(MADE.paths - {docs.written_to} - others))  # the stage's input and all that it wrote on its way
        settled(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
