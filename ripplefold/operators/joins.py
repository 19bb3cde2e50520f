"""Joins over time order: latest, earlier, never, within, and by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ripplefold.functions.expressions import slice_positions
from ripplefold.sources.stored import stored


def seen_before(df: DataFrame, host: str, ts: str, earlier: DataFrame, earlier_host: str, earlier_ts: str) -> DataFrame:
    """Rows whose host was an earlier row's host before: only the earliest time per host matters, so the join is on unique keys."""
    first = earlier.groupBy(F.col(earlier_host).alias("_h")).agg(F.min(earlier_ts).alias("_first"))
    out = df.join(first, df[host] == F.col("_h"), "left")
    return out.withColumn("allowed", F.coalesce(F.col("_first") < F.col(ts), F.lit(False))).drop("_h", "_first")


def never_after(df: DataFrame, keys: list[str], ts: str, later: DataFrame, later_ts: str) -> DataFrame:
    """Rows without a later row of the same keys; only the latest time per key matters."""
    last = later.groupBy(*keys).agg(F.max(later_ts).alias("_last"))
    return df.join(last, keys, "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col(ts))).drop("_last")


def never_before(df: DataFrame, keys: list[str], ts: str, earlier: DataFrame, earlier_ts: str) -> DataFrame:
    first = earlier.groupBy(*keys).agg(F.min(earlier_ts).alias("_first"))
    return df.join(first, keys, "left").where(F.col("_first").isNull() | (F.col("_first") >= F.col(ts))).drop("_first")


def within(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, width_s: int) -> DataFrame:
    """Points inside [start, end) of an interval with the same keys, by an equi join on time buckets and a range test."""
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(second(start) / width_s), F.floor(second(end) / width_s))))
    p = points.withColumn("_b", F.floor(second(at) / width_s))
    return i.join(p, [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def zipped(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Row i with row i. Numbers are dense: range-partitioned ranks come from per-partition counts, not from one sorted task."""
    return numbered(left, left_order, "pos").join(numbered(right, right_order, "pos"), "pos")


def _in_order(parts: DataFrame) -> DataFrame:
    """Range partitions in order, written once, with _id: the partition, and in its lower 33 bits the place there."""
    return stored(parts.withColumn("_id", F.monotonically_increasing_id()))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A dense 0-based number over the whole order, without a single-task window: places within sorted range partitions, with the
    counts of the partitions before as offsets."""
    ranged = _in_order(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_p", F.shiftright("_id", 33))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))  # one row a partition
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_p", "_id", "_before")


def _counting(batches):
    """Adds to sorted rows how many so far in this task have _flag, the task's number, and takes _flag away."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, so_far = TaskContext.get().partitionId(), 0
    for batch in batches:
        own = so_far + np.cumsum(batch.column("_flag").fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        so_far = int(own[-1]) if len(own) else so_far
        kept = [n for n in batch.schema.names if n != "_flag"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(own), pa.array(np.full(len(batch), part, np.int64))], [*kept, "_own", "_p"])


def in_order(df: DataFrame, order: list[str], flag: Column, name: str) -> DataFrame:
    """df with _p, the number of the range partition of the order that a row lies in, and how many rows up to and with each one have
    the flag (1, else 0 or null), over the whole order: counts of range partitions are offsets."""
    fields = StructType([*df.schema.fields, StructField("_own", LongType()), StructField("_p", LongType())])
    ranged = stored(df.withColumn("_flag", flag.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_counting, fields))
    counts = ranged.groupBy("_p").agg(F.max("_own").alias("_c"))  # one row a partition
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before")


def ranked(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """A 1-based rank within few keys, without one task for each: numbers over keys and order, less the first of the key."""
    whole = stored(numbered(df, [*keys, *order], "_n"))
    first = F.broadcast(whole.groupBy(*keys).agg(F.min("_n").alias("_first")))
    return whole.join(first, keys).withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def value_positions(df: DataFrame, fields: list[str]) -> DataFrame:
    """idx, value, pos, n: the sorted distinct values of each field over all rows, as a table rather than as one array."""
    pairs = df.select(F.posexplode(F.array(*fields)).alias("idx", "value")).where("value is not null").distinct()
    placed = ranked(pairs, ["idx"], ["value"], "pos")
    return placed.join(F.broadcast(placed.groupBy("idx").agg(F.count("*").alias("n"))), "idx").select("idx", "value", (F.col("pos") - 1).cast("long").alias("pos"), "n")


def in_slice(df: DataFrame, field: str, bits: str, form: str = "==") -> DataFrame:
    """Rows whose field lies in the dyadic slice of the field's values (== or ->), from its start on (>=) or up to its end (<=);
    none where the slice doesn't exist. Only the slice's bounds, one row, are sent to all tasks."""
    first, last = slice_positions(F.col("n"), bits)
    found = value_positions(df, [field]).where((F.col("pos") >= first) & (F.col("pos") <= last))
    ends = F.broadcast(found.agg(F.min("value").alias("_low"), F.max("value").alias("_high")).where("_low is not null"))
    here = {"==": F.col(field).between(F.col("_low"), F.col("_high")), "->": F.col(field).between(F.col("_low"), F.col("_high")), ">=": F.col(field) >= F.col("_low"), "<=": F.col(field) <= F.col("_high")}[form]
    return df.join(ends).where(here).drop("_low", "_high")


def attach_labels(labels: DataFrame, packets: DataFrame, keys: list[str], label_ts: str, ts: str, timeout_s: int) -> DataFrame:
    """Each packet with the nearest label record of its keys at most timeout_s away (ties: the earlier record)."""
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    l = labels.withColumn("_b", F.explode(F.array(*(F.floor(second(label_ts) / timeout_s) + d for d in (-1, 0, 1)))))  # noqa: E741
    p = packets.withColumn("_b", F.floor(second(ts) / timeout_s))
    gap = F.abs(second(ts) - second(label_ts))
    near = p.join(l, [*keys, "_b"]).where(gap < timeout_s).withColumn("gap", gap).drop("_b")
    best = near.groupBy("pkt_id").agg(F.min_by(F.struct("label_id", "gap"), F.struct("gap", F.col(label_ts), "label_id")).alias("best"))
    return best.select("pkt_id", "best.label_id", "best.gap")


def attach_in_order(labels: DataFrame, packets: DataFrame, keys: list[str], label_ts: str, ts: str, timeout_s: int) -> DataFrame:
    """Packets attached to label records, which are used up in time order: a packet belongs to the current record of its keys if it
    lies less than timeout_s from the record's time or from the last packet attached to it; one that comes later moves on to the next
    record, past those that start too late for it. Packets before their record or after the last are abnormal.

    pkt_id, label_id (null: not attached), status (attached, abnormal, passed, unknown keys) and skipped, the records passed over.
    Rows are sorted by key and time, and each task goes through them once with the records of one key in memory.
    """
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows = labels.select(*keys, F.lit(0).alias("kind"), second(label_ts).alias("at"), F.col("label_id").alias("id")).unionByName(packets.select(*keys, F.lit(1).alias("kind"), second(ts).alias("at"), F.col("pkt_id").alias("id")))
    parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "kind", "at", "id")

    def attach(batches):
        import pyarrow as pa

        key, records, at, end = None, [], 0, None
        for batch in batches:
            out: list[tuple] = []
            for *own, kind, t, i in zip(*(batch.column(c).to_pylist() for c in (*keys, "kind", "at", "id"))):
                if own != key:
                    key, records, at, end = own, [], 0, None
                if kind == 0:
                    records.append((t, i))
                    continue
                here = lambda: abs(records[at][0] - t) < timeout_s or end is not None and abs(end - t) < timeout_s  # noqa: B023, E731
                skipped = 0
                if not records:
                    status = "unknown keys"
                elif at >= len(records):
                    status = "abnormal"
                elif here():
                    status = "attached"
                elif t < records[at][0]:
                    status = "abnormal"
                else:
                    at, end = at + 1, None
                    while at < len(records) and records[at][0] - t >= timeout_s:
                        at, skipped = at + 1, skipped + 1
                    status = "abnormal" if at >= len(records) else "attached" if here() else "passed"
                if status == "attached":
                    end = t
                out.append((i, records[at][1] if status == "attached" else None, status, skipped))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [[]] * 4, kinds)], ["pkt_id", "label_id", "status", "skipped"])

    return ordered.mapInArrow(attach, "pkt_id long, label_id long, status string, skipped long")


def coverage(attached: DataFrame, labels: DataFrame) -> DataFrame:
    """Of attach_in_order: packets without any record of their keys, abnormal ones, records skipped, records without a packet."""
    used = attached.where("label_id is not null").select("label_id").distinct()
    uncovered = labels.select("label_id").join(used, "label_id", "left_anti").agg(F.count("*").alias("uncovered"))
    counts = attached.agg(F.count_if(F.col("status") == "attached").alias("labelled"), F.count_if(F.col("status") == "unknown keys").alias("unlabelled"), F.count_if(F.col("status") == "abnormal").alias("abnormal"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    return counts.join(F.broadcast(uncovered))
