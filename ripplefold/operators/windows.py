"""Ordered windows over keyed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplefold.functions.expressions import bucket_ms, seconds


def gaps(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Seconds since the previous and to the next packet of the same key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    second = seconds(F.col(order[0]))
    return df.withColumn("since_last", second - F.lag(second).over(w)).withColumn("to_next", F.lead(second).over(w) - second)


def sliding_sum(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, width: int, name: str) -> DataFrame:
    """At each packet, the sum over the last `width` whole seconds: earlier seconds by range, its own by running row."""
    second = df.withColumn("_sec", seconds(F.col(ts)))
    before = Window.partitionBy(*keys).orderBy("_sec").rangeBetween(-(width - 1), -1)
    own = Window.partitionBy(*keys, "_sec").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return second.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)) + F.sum(value).over(own)).drop("_sec")


def traffic_change(df: DataFrame, keys: list[str], ts: str, value: str, width: int) -> DataFrame:
    """Sum of the window before the last minus the last window, at each packet."""
    second = df.withColumn("_sec", seconds(F.col(ts)))
    w = Window.partitionBy(*keys).orderBy("_sec")
    now, then = F.sum(value).over(w.rangeBetween(-(width - 1), 0)), F.sum(value).over(w.rangeBetween(-(2 * width - 1), -width))
    return second.withColumn("change", F.coalesce(then, F.lit(0)) - F.coalesce(now, F.lit(0))).drop("_sec")


def longest_run(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Longest run of successive packets with the flag, by the difference of two row numbers."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = df.withColumn("_n", F.row_number().over(w)).where(flag)
    island = island.withColumn("_island", F.col("_n") - F.row_number().over(w))
    runs = island.groupBy(*keys, "_island").agg(F.count("*").alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("longest"))


def segments(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """A running number that grows where one of `same` changes from one packet to the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*same)
    change = F.when(F.lag(now).over(w).isNull() | (F.lag(now).over(w) != now), 1).otherwise(0)
    return df.withColumn("_change", change).withColumn("segment", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def sample_windows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("sample", F.floor((F.row_number().over(w) - 1) / n).cast("long"))


def tumbling_sums(df: DataFrame, ts: str, value: str, width_ms: int) -> DataFrame:
    """Sums of all buckets between the first and the last, empty ones too."""
    sums = df.groupBy(bucket_ms(F.col(ts), width_ms).alias("bucket")).agg(F.sum(value).alias("total"))
    span = sums.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).where("low is not null")
    every = span.select(F.explode(F.sequence("low", "high", F.lit(width_ms).cast("long"))).alias("bucket"))
    return every.join(sums, "bucket", "left").select("bucket", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
