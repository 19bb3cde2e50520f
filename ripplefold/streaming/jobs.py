"""The same queries over streams: file or other sources in, watermarks where time closes a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ripplefold.sources.packets import as_packets
from ripplefold.sources.stored import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """All files that are there come in one batch unless files_per_trigger says otherwise: files needn't follow each other in
    time, and between batches the watermark closes windows that later files may still have rows for."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_packets(event_stream(spark, sf_dir))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now and returns all it wrote; update and complete go by key, latest batch last."""
    spark, home = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    write = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{home}/state")
    if mode == "append":
        query = write.outputMode("append").format("parquet").start(f"{home}/out")
    else:
        query = write.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{home}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{home}/out")


def live_counts(packets: DataFrame, key: str) -> DataFrame:
    return packets.groupBy(key).agg(F.count("*").alias("n"))


def windowed_sums(packets: DataFrame, keys: list[str], width: str, slide: str | None, late: str) -> DataFrame:
    """Sums per key and time window; rows later than the watermark are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(*keys, span.alias("w")).agg(F.sum("len").alias("total")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "total")


def alerts(sums: DataFrame, threshold: int) -> DataFrame:
    return sums.where(F.col("total") > threshold)


STATE = "open boolean, n long, alerted boolean"
CHANGES = "src long, n long, delta long, alert boolean"


def pattern_state(packets: DataFrame, threshold: int) -> DataFrame:
    """Keyed pattern state: per source, the pieces from an opening packet to the next closing one that are complete so far.

    Each batch emits, for the sources it touches, the count, its change (so that sums kept elsewhere can be updated by difference),
    and an alert in the one batch in which the count first goes over the threshold. Packets of a batch are taken in time order."""
    import pandas as pd

    def update(key, frames, state):
        is_open, n, alerted = state.get if state.exists else (False, 0, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "pkt_id"])
        before = n
        for opens, closes in zip(rows["syn"].tolist(), rows["fin"].tolist()):
            if opens:
                is_open = True
            elif closes and is_open:
                is_open, n = False, n + 1
        alert = n > threshold and not alerted
        state.update((is_open, n, alerted or alert))
        yield pd.DataFrame({"src": [key[0]], "n": [n], "delta": [n - before], "alert": [alert]})

    control = packets.where("(syn or fin) and src is not null").select("src", "ts", "pkt_id", "syn", "fin")
    return control.groupBy("src").applyInPandasWithState(update, CHANGES, STATE, "update", "NoTimeout")


NEVER_MS = -(2**63) // 1_000_000  # of a packet without a time
EXPIRING = "src long, n long, delta long, alert boolean, expired boolean"


class Expiring(StatefulProcessor):
    """pattern_state for one source, forgotten once no control packet came for `quiet_s` seconds of event time."""

    def __init__(self, threshold: int, quiet_s: int) -> None:
        self.threshold, self.quiet_ms = threshold, quiet_s * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pattern", "open boolean, n long, alerted boolean, last_ms long")

    def handleInputRows(self, key, rows, timerValues):
        is_open, n, alerted, last = self.state.get() if self.state.exists() else (False, 0, False, None)
        timer, done, alert = last, 0, False
        for r in sorted(rows, key=lambda r: (r.us is None, r.us or 0, r.pkt_id is None, r.pkt_id or 0)):
            at, opens, closes = NEVER_MS if r.us is None else r.us // 1000, r.syn, r.fin
            if last is not None and at - last > self.quiet_ms:
                is_open, n, alerted = False, 0, False
            if opens:
                is_open = True
            elif closes and is_open:
                is_open, n, done = False, n + 1, done + 1
            if n > self.threshold and not alerted:
                alert = alerted = True
            last = max(at, last or at)
        if timer is not None:
            self.handle.deleteTimer(timer + self.quiet_ms)
        self.handle.registerTimer(last + self.quiet_ms)
        self.state.update((is_open, n, alerted, last))
        yield Row(src=key[0], n=n, delta=done, alert=alert, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n = self.state.get()[1]
        self.state.clear()
        yield Row(src=key[0], n=n, delta=0, alert=False, expired=True)

    def close(self) -> None:
        pass


def expiring_state(packets: DataFrame, threshold: int, quiet_s: int, late: str) -> DataFrame:
    """pattern_state with an end: a source without a control packet for over quiet_s seconds starts anew with the next one. Its state is
    dropped, and told of with `expired`, as soon as the watermark is that far past its last packet. The watermark runs `late` behind the latest
    control packet; those behind it are dropped, others are taken in time order within their batch."""
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    control = packets.where("(syn or fin) and src is not null").select("src", F.col("ts").cast("timestamp").alias("ts"), "pkt_id", "syn", "fin").withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return control.groupBy("src").transformWithState(Expiring(threshold, quiet_s), EXPIRING, "Update", "EventTime")


def write_alerts(stream: DataFrame, path: str, checkpoint: str):
    """An append-only alert sink: one row for each offending pair, written once; returns the running query."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("append").format("parquet").start(path)


def alert_rows(packets: DataFrame, limit: int) -> DataFrame:
    """An alert for every packet over the limit: time, both ends, and what it held."""
    return packets.where(F.col("len") > limit).select("pkt_id", "ts", "src", "dst", "len")


def alerts_written(stream: DataFrame) -> DataFrame:
    """Runs the sink over what the source holds now and reads what it wrote."""
    home = shared_folder(stream.sparkSession, "alerts")
    write_alerts(stream, f"{home}/out", f"{home}/state").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/out")
