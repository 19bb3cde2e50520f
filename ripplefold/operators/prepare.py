"""Preparing labelled traces: flows, batches, mixtures and samples; choices are by hash, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefold.operators.joins import numbered, ranked
from ripplefold.sources.stored import shared_folder


def draw(key: Column, out_of: int) -> Column:
    """A number below out_of that the key alone determines."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % out_of


def assemble_flows(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("open_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_pkts"), F.sum(value).alias("bytes"))


def split_by(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet in one folder for each value of `kind`, so that whoever picks a kind reads its folder alone. Rows aren't
    shuffled: each task writes the kinds that it holds, however many rows are of one kind. The folders' column is named `part`."""
    path = shared_folder(df.sparkSession, "split")
    parted = df.withColumn("part", F.col(kind).cast("string"))
    parted.write.partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(parted.schema).parquet(path)


def picked(split: DataFrame, kind: str, value: str | None) -> DataFrame:
    """The rows of split_by() of one kind, null included. An empty string lies in the folder of the nulls, and is told apart there."""
    folder = F.col("part").eqNullSafe(F.lit(value or None).cast("string"))
    return split.where(folder & F.col(kind).cast("string").eqNullSafe(F.lit(value).cast("string"))).drop("part")


def indexed(df: DataFrame, within: list[str], order: list[str], name: str = "idx") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("long"))


def batches(df: DataFrame, idx: str, batch: int, count: int, skip: int = 0, step: int = 0) -> DataFrame:
    """`count` samples of `batch` flows, the first after `skip` flows, with `step` flows left out between two."""
    at = F.col(idx) - skip
    sample = F.floor(at / (batch + step))
    return df.where((at >= 0) & (sample < count) & (at % (batch + step) < batch)).withColumn("sample", sample.cast("long"))


def mixed_by_ratio(df: DataFrame, label: str, key: str, positives: int, out_of: int) -> DataFrame:
    """Keeps all negatives and the positives whose key's draw falls under the ratio."""
    return df.where((F.col(label) == 0) | (draw(F.col(key), out_of) < positives))


def rechunked(df: DataFrame, idx: str, sizes: list[int]) -> DataFrame:
    """The same flows cut into samples of each of several sizes."""
    return df.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))).withColumn("sample", F.floor(F.col(idx) / F.col("size")).cast("long"))


def interleaved(df: DataFrame, label: str, idx: str, good: int, bad: int) -> DataFrame:
    """Positions that deal `good` rows of label 0 and `bad` rows of label 1 in turn."""
    width = good + bad
    at = F.when(F.col(label) == 0, F.floor(F.col(idx) / good) * width + F.col(idx) % good).otherwise(F.floor(F.col(idx) / bad) * width + good + F.col(idx) % bad)
    return df.withColumn("slot", at.cast("long"))


def after_trigger(df: DataFrame, keys: list[str], order: list[str], trigger: str) -> DataFrame:
    """Packets of each key from its first triggering packet on."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_on", F.max(F.col(trigger).cast("int")).over(w)).where("_on = 1").drop("_on")


def periodic_samples(df: DataFrame, idx: str, every: int, n: int) -> DataFrame:
    """n packets in a row out of every `every`, from an offset that the sample's number determines."""
    number = F.floor(F.col(idx) / every)
    offset = draw(number, every - n + 1)
    at = F.col(idx) % every
    return df.where((at >= offset) & (at < offset + n)).withColumn("sample", number.cast("long"))


def halves(df: DataFrame, label: str, order: str) -> DataFrame:
    """The first and the second half of each label's rows, by ranks that don't need one task for each label."""
    placed = ranked(df, [label], [order], "_r")
    sizes = F.broadcast(placed.groupBy(label).agg(F.count("*").alias("_n")))
    return placed.join(sizes, label).withColumn("half", F.when(F.col("_r") <= F.ceil(F.col("_n") / 2), 1).otherwise(2)).drop("_r", "_n")


def one_trace_sets(df: DataFrame, label: str, trace: str) -> DataFrame:
    """Each trace as a set of its own: label and a set number, which is the rank of the trace within its label."""
    return ranked(df.select(label, trace).distinct(), [label], [trace], "set")


def merged(df: DataFrame, source: str, idx: str, percents: list[int], rounds: int = 4) -> DataFrame:
    """Lists 0, 1, ... (column `source`, items in the order of idx) as one: each place draws a list by the percentages, and takes its
    next item; a draw of a list that is used up is void. What is left after rounds x all items draws comes last, list by list."""
    spark = df.sparkSession
    total = df.count()
    chosen, upto = F.lit(len(percents) - 1), 0
    bounds = []
    for i, p in enumerate(percents[:-1]):
        upto += p
        bounds.append((i, upto))
    for i, high in reversed(bounds):
        chosen = F.when(F.col("_d") < high, i).otherwise(chosen)
    draws = spark.range(rounds * total).withColumn("_d", draw(F.col("id"), 100)).select("id", chosen.alias(source))
    numbered_draws = ranked(draws, [source], ["id"], "_c")
    placed = df.join(numbered_draws.select(F.col(source).alias("_s"), (F.col("_c") - 1).alias("_i"), F.col("id").alias("_t")), (F.col(source) == F.col("_s")) & (F.col(idx) == F.col("_i")), "left")
    return numbered(placed.withColumn("_t", F.coalesce("_t", F.lit(rounds * total))).drop("_s", "_i"), ["_t", source, idx], "place").drop("_t")
