"""Connections between two ends: replies to requests, handshakes by numbers, calls and their media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _next(df: DataFrame, keys: list[str], is_asked: Column, is_answer: Column, value: str, name: str) -> DataFrame:
    """Rows that ask, with the value of the first later row of the same keys that answers: one sort per key, no pairs. The order runs
    backwards, where that row is the last one before: a running value, while a frame that ends with the key is read anew for each row."""
    return df.withColumn(name, F.last(F.when(is_answer, F.struct("ts", "pkt_id", F.col(value).alias("number"))), ignorenulls=True).over(_later(keys))).where(is_asked)


def _later(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("pkt_id")).rowsBetween(Window.unboundedPreceding, -1)


def replies(df: DataFrame, is_request: Column, is_reply: Column, numbers: tuple[str, str] | None = None) -> DataFrame:
    """Each request with the first later reply of the other end (reply_id null: none). With numbers (own, acknowledged),
    the reply must acknowledge the request's own number plus one."""
    own, acknowledged = numbers or ("pkt_id", "pkt_id")
    ends = df.withColumn("client", F.when(is_request, F.col("src")).otherwise(F.col("dst"))).withColumn("server", F.when(is_request, F.col("dst")).otherwise(F.col("src")))
    ends = ends.withColumn("number", F.when(is_request, F.col(own)).otherwise(F.col(acknowledged) - 1) if numbers else F.lit(0))
    asked = _next(ends.where(is_request | is_reply), ["client", "server", "number"], is_request, is_reply, own, "reply")
    return asked.select(*df.columns, F.col("reply.pkt_id").alias("reply_id"), F.col("reply.ts").alias("reply_ts"), F.col("reply.number").alias("reply_number"))


def handshakes(df: DataFrame, syn: Column, syn_ack: Column, ack: Column) -> DataFrame:
    """SYN, the other end's SYN-ACK to its number, and the first end's ACK to that one's number: syn_id, src, dst, syn_ack_id
    and ack_id, null where the exchange stopped. Columns seq and ack_seq hold the numbers."""
    first = replies(df, syn, syn_ack, ("seq", "ack_seq")).select("pkt_id", "ts", "src", "dst", "reply_id", "reply_ts", "reply_number")
    # the third step goes in the direction of the first: from the answered SYN on, an ACK of the answer's number plus one
    opened = first.where("reply_id is not null").select("src", "dst", F.col("reply_number").alias("number"), F.col("reply_ts").alias("ts"), F.col("reply_id").alias("pkt_id"), F.lit(True).alias("asks"), F.col("pkt_id").alias("syn_id"))
    acks = df.where(ack).select("src", "dst", (F.col("ack_seq") - 1).alias("number"), "ts", "pkt_id", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("syn_id"))
    done = _next(opened.unionByName(acks), ["src", "dst", "number"], F.col("asks"), ~F.col("asks"), "number", "third").select(F.col("syn_id").alias("_syn"), F.col("third.pkt_id").alias("ack_id"))
    return first.join(done, F.col("pkt_id") == F.col("_syn"), "left").select(F.col("pkt_id").alias("syn_id"), "src", "dst", F.col("reply_id").alias("syn_ack_id"), "ack_id")


def completed(df: DataFrame, keys: list[str], opens: Column, closes: Column) -> DataFrame:
    """Per keys, how often a packet that closes comes right after one that opens, packets of other kinds left out: keys, flows."""
    own = df.where(opens | closes).withColumn("_before", F.lag(opens).over(Window.partitionBy(*keys).orderBy("ts", "pkt_id")))
    return own.groupBy(*keys).agg(F.count_if(closes & F.coalesce("_before", F.lit(False))).alias("flows"))


def lifetimes(df: DataFrame, keys: list[str], opens: Column, closes: Column) -> DataFrame:
    """Each packet that closes, with the seconds since the last one of its keys that opened: keys, pkt_id, life."""
    before = Window.partitionBy(*keys).orderBy("ts", "pkt_id").rowsBetween(Window.unboundedPreceding, -1)
    own = df.where(opens | closes).withColumn("_opened", F.last(F.when(opens, F.col("ts")), ignorenulls=True).over(before)).where(closes & F.col("_opened").isNotNull())
    return own.select(*keys, "pkt_id", (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("_opened").cast("timestamp"))).alias("life"))


def half_open(found: DataFrame, threshold: int = 0) -> DataFrame:
    """Per target and source, handshakes that were answered but never completed, and whether they are over the threshold."""
    open_ = found.groupBy("dst", "src").agg(F.count_if(F.col("syn_ack_id").isNotNull() & F.col("ack_id").isNull()).alias("half_open"))
    return open_.withColumn("alert", F.col("half_open") > threshold)


def calls(df: DataFrame, keys: list[str], invite: Column, answer: Column, confirm: Column, bye: Column) -> DataFrame:
    """Calls that were set up: INVITE, its answer, its confirmation as successive signals of the keys; from the confirmation to
    the next BYE (end_ts null: still on). Signals of other kinds don't count."""
    kind = F.when(invite, "i").when(answer, "a").when(confirm, "c").when(bye, "b")
    w = Window.partitionBy(*keys).orderBy("ts", "pkt_id")
    signals = df.withColumn("_kind", kind).where("_kind is not null").withColumn("_one", F.lag("_kind").over(w)).withColumn("_two", F.lag("_kind", 2).over(w))
    ends = F.last(F.when(F.col("_kind") == "b", F.col("ts")), ignorenulls=True).over(_later(keys))
    return signals.withColumn("end_ts", ends).where("_kind = 'c' and _one = 'a' and _two = 'i'").select(*keys, F.col("pkt_id").alias("call_id"), F.col("ts").alias("start_ts"), "end_ts")


def ongoing(df: DataFrame, keys: list[str], invite: Column, answer: Column, confirm: Column, bye: Column, recent_s: int) -> DataFrame:
    """Connections that were opened within the last recent_s seconds of the stream, seen by the packets of that time alone, and are
    still open: keys, call_id, start_ts."""
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    last = F.broadcast(df.agg(F.max(second("ts")).alias("_last")))  # one row
    recent = df.join(last).where(second("ts") > F.col("_last") - recent_s).drop("_last")
    return calls(recent, keys, invite, answer, confirm, bye).where("end_ts is null").select(*keys, "call_id", "start_ts")


def in_sessions(df: DataFrame, keys: list[str], invite: Column, answer: Column, confirm: Column, bye: Column) -> DataFrame:
    """The packets that are no signals and lie in a connection of their keys, with its call_id: from the confirmation to the next BYE, or
    the next confirmation. Running values only, so that a connection's packets are never held together."""
    kind = F.when(invite, "i").when(answer, "a").when(confirm, "c").when(bye, "b")
    w = Window.partitionBy(*keys).orderBy("ts", "pkt_id")
    kinds = df.withColumn("_kind", kind)
    signals = kinds.where("_kind is not null").withColumn("_one", F.lag("_kind").over(w)).withColumn("_two", F.lag("_kind", 2).over(w))
    mark = F.when((F.col("_kind") == "c") & (F.col("_one") == "a") & (F.col("_two") == "i"), F.struct(F.col("pkt_id").alias("id"))).when(F.col("_kind") == "b", F.struct(F.lit(None).cast("long").alias("id")))
    both = signals.withColumn("_mark", mark).drop("_one", "_two").unionByName(kinds.where("_kind is null").withColumn("_mark", F.lit(None).cast("struct<id:bigint>")))
    last = F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("call_id", last["id"]).where("_kind is null and call_id is not null").drop("_kind", "_mark")


def sip_fields(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with method, code, call_id, user and media_port read from SIP messages; null where they aren't there."""
    text = F.col(payload).cast("string")
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return df.select(
        "*", found(r"^(INVITE|ACK|BYE|CANCEL|OPTIONS|REGISTER|PRACK|UPDATE|INFO) ").alias("method"), found(r"^SIP/2\.0 ([0-9]{3})").cast("int").alias("code"),
        found(r"(?im)^(?:Call-ID|i):[ \t]*([^\r\n]+?)[ \t]*$").alias("call_id"), found(r"(?im)^(?:From|f):[^\r\n]*?sips?:([^@>;\r\n]+)").alias("user"), found(r"(?m)^m=audio ([0-9]+)").cast("int").alias("media_port"),
    )
