"""Packet streams: the adapter from the event table, capture files, token traces and label files."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplefold.operators.joins import numbered, zipped
from ripplefold.sources.stored import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_packets(events: DataFrame) -> DataFrame:
    """Events seen as packets: user to target pairs, lengths in cents, flags by event type."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("pkt_id"), "ts", F.col("user_id").alias("src"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("dst"),
        F.round(F.col("value") * 100).cast("long").alias("len"), (kind == "signup").alias("syn"), (kind == "purchase").alias("fin"), (kind == "click").alias("ack"), (kind == "error").alias("rst"), kind.alias("kind"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_packets(table(spark, sf_dir, "events"))


RAW = "file string, pkt_no long, ts_us long, caplen int, linktype int, raw binary"


def _frames(batches):
    """Packet records of whole capture files, one file at a time."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows, at, number = [], 24, 0
            if len(content) < 24:
                continue
            magic = content[:4]
            order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
            nano = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
            linktype = struct.unpack(order + "I", content[20:24])[0]
            while at + 16 <= len(content):
                sec, frac, cap, _ = struct.unpack(order + "IIII", content[at : at + 16])
                rows.append((path, number, sec * 1_000_000 + (frac // 1000 if nano else frac), cap, linktype, content[at + 16 : at + 16 + cap]))
                at, number = at + 16 + cap, number + 1
                if len(rows) == 20_000:
                    yield _framed(rows)
                    rows = []
            if rows:
                yield _framed(rows)


def _framed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["file", "pkt_no", "ts_us", "caplen", "linktype", "raw"])


def read_pcap(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw frames of capture files; a file is the unit of parallel reading, and several make one stream."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(_frames, RAW)


def _number(offset: Column, length: int) -> Column:
    return F.conv(F.hex(F.substring(F.col("raw"), offset + 1, F.lit(length))), 16, 10).cast("long")


def decode_headers(frames: DataFrame) -> DataFrame:
    """IPv4 frames with their address, transport and flag fields; others are left out."""
    ip = F.when(F.col("linktype") == 1, 14).otherwise(0)
    df = frames.withColumn("_ip", ip).where(F.shiftright(_number(F.col("_ip"), 1), 4) == 4)
    l4 = F.col("_ip") + (_number(F.col("_ip"), 1) % 16 * 4).cast("int")
    df = df.withColumn("_l4", l4).withColumn("protocol", _number(F.col("_ip") + 9, 1).cast("int"))
    tcp = F.col("protocol") == 6
    flags = F.when(tcp, _number(F.col("_l4") + 13, 1)).otherwise(0)
    # a TCP header tells its length in words, options included, and has five at least; a cut-off one has no payload anyway
    l4_size = F.when(tcp, F.greatest(F.coalesce(F.shiftright(_number(F.col("_l4") + 12, 1), 4) * 4, F.lit(20)), F.lit(20))).otherwise(8).cast("int")
    bit = lambda mask, name: F.when(flags.bitwiseAND(F.lit(mask).cast("long")) != 0, 1).otherwise(0).alias(name)
    return df.select(
        "file", "pkt_no", F.timestamp_micros("ts_us").alias("ts"), _number(F.col("_ip") + 12, 4).alias("src_ip"), _number(F.col("_ip") + 16, 4).alias("dst_ip"),
        F.when(F.col("protocol").isin(6, 17), _number(F.col("_l4"), 2)).otherwise(0).cast("int").alias("src_port"), F.when(F.col("protocol").isin(6, 17), _number(F.col("_l4") + 2, 2)).otherwise(0).cast("int").alias("dst_port"),
        "protocol", _number(F.col("_ip") + 6, 2).alias("frag"), _number(F.col("_ip") + 4, 2).cast("int").alias("ip_id"), _number(F.col("_ip") + 2, 2).cast("int").alias("len"), _number(F.col("_ip") + 1, 1).cast("int").alias("tos"), _number(F.col("_ip") + 8, 1).cast("int").alias("ttl"),
        bit(2, "syn"), bit(16, "ack"), bit(1, "fin"), bit(4, "rst"), bit(8, "psh"), bit(32, "urg"),
        F.when(tcp, _number(F.col("_l4") + 4, 4)).otherwise(0).alias("seq"), F.when(tcp, _number(F.col("_l4") + 8, 4)).otherwise(0).alias("ack_seq"), F.when(tcp, _number(F.col("_l4") + 14, 2)).otherwise(0).cast("int").alias("win"),
        F.substring(F.col("raw"), F.col("_l4") + 1 + l4_size, F.length("raw")).alias("payload"),
    )


def payload_tokens(df: DataFrame, width: int, n: int, column: str = "payload") -> DataFrame:
    """The first n tokens of `width` bits (1, 2, 4 or 8) of a binary column."""
    per = 8 // width
    byte = lambda i: F.conv(F.hex(F.substring(F.col(column), (F.floor(i / per) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    token = lambda i: (F.floor(byte(i) / F.pow(F.lit(2), (per - 1 - i % per) * width)) % (1 << width)).cast("int")
    return df.withColumn("tokens", F.transform(F.sequence(F.lit(0), F.least(F.length(column) * per, F.lit(n)) - 1), token))


def _trace_parts(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between blank lines, with `head` true for the first of each file, which begins with the two header lines."""
    parts = spark.read.option("lineSep", "\n\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("trace_id"))
    first = F.broadcast(parts.groupBy("file").agg(F.min("trace_id").alias("first")))  # one row a file
    return parts.join(first, "file").withColumn("head", F.col("trace_id") == F.col("first")).drop("first")


def read_traces(spark: SparkSession, path: str, label: int) -> DataFrame:
    """Token traces: blank lines part traces, a line is a packet; each file's two header lines are left out."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    df = _trace_parts(spark, path).withColumn("lines", F.when(F.col("head"), F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(lines))
    return df.select(F.lit(label).alias("label"), "trace_id", F.posexplode("lines").alias("pos", "line")).select("label", "trace_id", "pos", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("long")).alias("features"))


def trace_kinds(spark: SparkSession, path: str) -> DataFrame:
    """idx, kind: what the headers say of each field (0 scalar, 1 ranged, 2 discrete)."""
    heads = _trace_parts(spark, path).where("head").select(F.split(F.trim(F.get(F.split("value", "\n"), 1)), r"\s+").alias("k")).distinct()
    return heads.select(F.posexplode("k").alias("idx", "kind")).select("idx", F.col("kind").cast("int").alias("kind")).distinct()


def trace_texts(traces: DataFrame) -> DataFrame:
    """Each trace as the text that write_traces puts between blank lines."""
    lines = traces.select("label", "trace_id", "pos", F.array_join(F.transform("features", lambda x: x.cast("string")), " ").alias("line"))
    return lines.groupBy("label", "trace_id").agg(F.expr("listagg(line, '\n') within group (order by pos)").alias("text"))


def write_traces(traces: DataFrame, kinds: list[int], path: str) -> None:
    """Part files in order; the header opens the first trace of the first."""
    texts = stored(trace_texts(traces))
    size = texts.agg(F.count("*").alias("n"), F.min(F.struct("label", "trace_id")).alias("first")).first()
    head = f"{size['n']} {len(kinds)}\n{' '.join(map(str, kinds))}\n"
    first = (F.col("label") == size["first"]["label"]) & (F.col("trace_id") == size["first"]["trace_id"]) if size["n"] else F.lit(False)
    ordered = texts.repartitionByRange("label", "trace_id").sortWithinPartitions("label", "trace_id")
    ordered.select(F.when(first, F.concat(F.lit(head), "text")).otherwise(F.col("text")).alias("value")).write.option("lineSep", "\n\n").text(path)


FLOW_LABELS = "flow_id string, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, time string"


def read_flow_labels(spark: SparkSession, path: str, n_features: int, kind: str = "all") -> DataFrame:
    """Labelled flows; kind is all, benign or attack."""
    numbers = ", ".join(f"f{i} double" for i in range(n_features))
    df = spark.read.csv(path, schema=f"{FLOW_LABELS}, {numbers}, label string", mode="PERMISSIVE").where(F.col("src_ip").rlike("^[0-9]"))
    return {"all": df, "benign": df.where("label = 'BENIGN'"), "attack": df.where("label <> 'BENIGN'")}[kind]


def write_attack_rows(flows: DataFrame, path: str) -> None:
    flows.where("label <> 'BENIGN'").write.csv(path)


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(parts, 0).alias("program"), F.get(parts, 1).cast("long").alias("threshold"), (F.get(parts, 2) == "1").alias("tie_is_neg"))


def read_labelled_strings(spark: SparkSession, path: str) -> DataFrame:
    """Strings of one file below a header line, whose last two numbers are how many positive and negative ones there are."""
    lines = numbered(spark.read.text(path).where("value <> ''").withColumn("_at", F.monotonically_increasing_id()), ["_at"], "id").drop("_at")
    counts = F.split(F.trim("value"), r"\s+")
    head = F.broadcast(lines.where("id = 0").select(F.get(counts, F.size(counts) - 2).cast("long").alias("n_pos"), F.get(counts, F.size(counts) - 1).cast("long").alias("n_neg")))
    return lines.where("id > 0").join(head).where("id <= n_pos + n_neg").select("id", (F.col("id") <= F.col("n_pos")).cast("int").alias("label"), F.col("value").alias("text"))


def read_feature_csv(spark: SparkSession, features: str, labels: str) -> DataFrame:
    """pos, features, label: row i of a CSV of numbers with row i below the header of a label CSV (column 1)."""
    rows = spark.read.csv(features)
    values = rows.select(F.array(*rows.columns).cast("array<double>").alias("features"), F.monotonically_increasing_id().alias("_l"))
    marks = spark.read.csv(labels, header=True, enforceSchema=False)
    marks = marks.select(F.col(f"`{marks.columns[1]}`").cast("int").alias("label"), F.monotonically_increasing_id().alias("_r"))
    return zipped(values, ["_l"], marks, ["_r"]).select("pos", "features", "label")


def read_labelled_pcap(spark: SparkSession, capture: str, labels: str) -> DataFrame:
    """Decoded packets of a capture with the label of row i for packet i."""
    marks = spark.read.csv(labels, header=True, enforceSchema=False)
    marks = marks.select(F.col(f"`{marks.columns[1]}`").cast("int").alias("label"), F.monotonically_increasing_id().alias("_r"))
    both = zipped(read_pcap(spark, capture), ["file", "pkt_no"], marks, ["_r"])
    return decode_headers(both.drop("_r", "pos", "label")).join(both.select("file", "pkt_no", "label"), ["file", "pkt_no"])


def union_captures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The frames of all captures as one stream in time order: pkt_id numbers it."""
    return numbered(read_pcap(spark, paths), ["ts_us", "file", "pkt_no"], "pkt_id")


def write_bandwidth(sums: DataFrame, path: str) -> None:
    """The bandwidth record: bucket in milliseconds and bits."""
    sums.select("bucket", (F.col("total") * 8).alias("bits")).write.csv(path)


#: The twenty features of a packet, in order, and their kinds (0 scalar, 1 ranged, 2 discrete).
FEATURES = ["time", "time_since_last", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "frag", "ip_id", "len", "tos", "ttl", "syn", "ack", "fin", "rst", "psh", "urg", "seq", "win"]
FEATURE_KINDS = [0, 0, 1, 1, 1, 1, 2, 0, 0, 0, 2, 0, 2, 2, 2, 2, 2, 2, 0, 0]


def to_features(df: DataFrame) -> DataFrame:
    """df with `features`: the twenty of a packet in order; time counts for nothing, and fields that df lacks are 0."""
    field = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in df.columns and c != "time" else F.lit(0).cast("long")
    return df.withColumn("features", F.array(*map(field, FEATURES)))


def features_of_kind(spark: SparkSession, kinds: list[int]) -> DataFrame:
    """idx, name and kind of the features of these kinds."""
    return spark.createDataFrame(list(zip(range(len(FEATURES)), FEATURES, FEATURE_KINDS)), "idx int, name string, kind int").where(F.col("kind").isin(kinds))


def row_to_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with its numeric columns as one vector."""
    return df.withColumn("features", F.array(*columns).cast("array<double>"))
