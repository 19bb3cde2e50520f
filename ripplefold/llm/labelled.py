"""A bounded sample of labelled training rows for the classifiers, its features computed in tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, per_class: int, features: Callable, schema: str) -> DataFrame:
    """Feature rows (with `label`) of at most per_class documents of each class, chosen by hash among the
    labelled rows whose crc32(doc_id) mod `modulus` isn't held_out. Null labels and null ids are left out."""
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(remainder(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(per_class).unionByName(known.where("label = 1").orderBy(*order).limit(per_class))
    return _features(docs, chosen, features, schema)


def unlabelled_sample(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, most: int, features: Callable, schema: str) -> DataFrame:
    """The same for at most `most` documents without a label, chosen by hash; their label is null."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    ids = ids.join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    return _features(docs, ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("label", F.lit(None).cast("int")), features, schema)


def _features(docs: DataFrame, chosen: DataFrame, features: Callable, schema: str) -> DataFrame:
    """One row for each chosen id: of repeated ids, that with the least text."""
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the bound of the sample
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.select("doc_id", "text", "label").mapInArrow(features, schema)
