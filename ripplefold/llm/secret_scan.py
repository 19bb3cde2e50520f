"""Operator 5, secret scans with multipart credential linking; DataFrame functions only.

Strong candidates stand for themselves: assignments of a password-like name, access identifiers, long hex
runs. Weak ones are endpoints (addresses, host names with a scheme) and opaque tokens; an interval join
within a document keeps an endpoint only with a strong candidate at most `reach` characters away, and an
opaque token only with an access identifier or an endpoint kept that way. Weak candidates that overlap a
strong one add nothing.

Contract: spans count code points, end exclusive, ordered by start, then by kind as in KINDS, then by end; ties of
start and kind can't occur within a kind, as its matches don't overlap. A null or empty text has no spans. Repeated
rows give repeated results; a null doc_id is kept. An empty table gives no rows. Input columns may have any
name: they travel in one struct. Weak spans are joined to their rows by a 64-bit hash of doc_id and text: two unlike rows
of one hash would share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import all_columns, forget, written

# The patterns and least lengths of the base rule, then those of the weak candidates.
KINDS = ("assign", "access", "hex", "endpoint", "opaque")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ENDPOINT = r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._~:/?#@%&=+-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?"
OPAQUE = r"[A-Za-z0-9+/]{32,}={0,2}"
REACH = 200
BROADCAST_SPANS = 500_000
SPAN = "array<struct<start: bigint, rank: int, end: bigint>>"


def _spans(kind: str, pattern: str, least_value: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans: where the pieces between matches end tells where matches start."""
    q = pattern.replace("\\", "\\\\").replace("'", "\\'")
    value = f"length(get(regexp_extract_all(_t, '{q}', 2), i)) >= {least_value}" if least_value else "true"
    found = f"""
        transform(array(struct(transform(regexp_extract_all(_t, '{q}', 0), m -> length(m)) as m, transform(split(_t, '{q}', -1), p -> length(p)) as p)), x ->
            transform(sequence(0, size(x.m) - 1), i -> struct(
                cast(aggregate(slice(x.p, 1, i + 1), 0, (a, y) -> a + y) + aggregate(slice(x.m, 1, i), 0, (a, y) -> a + y) as bigint) as start,
                {KINDS.index(kind)} as rank, x.m[i] as len, {value} as good)))[0]"""
    return F.expr(f"case when _t rlike '{q}' then transform(filter({found}, s -> s.good), s -> struct(s.start as start, s.rank as rank, s.start + s.len as end)) else cast(array() as {SPAN}) end")


def _text(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', array({names})[s.rank], cast(s.start as string), cast(s.end as string))), ',')")


def _in_scopes(df: DataFrame, span: str, reach: int, more: int = 0) -> DataFrame:
    """df once for each stretch of `reach` characters that the span, widened by `more` on both sides, touches."""
    return df.withColumn("scope", F.explode(F.sequence(F.floor((F.col(f"{span}.start") - more) / reach), F.floor((F.col(f"{span}.end") + more) / reach))))


def _near(weak: DataFrame, strong: DataFrame, reach: int, most_gap: int) -> DataFrame:
    """The distinct (key, w) with a strong span of the same key at most most_gap away (below 0: overlapping): an interval join in scopes."""
    gap = F.greatest("w.start", "b.start") - F.least("w.end", "b.end")
    return _in_scopes(weak, "w", reach).join(_in_scopes(strong, "b", reach, max(most_gap, 0)), ["key", "scope"]).where(gap <= most_gap).select("key", "w").distinct()


def scanned(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """row (a struct of all columns of docs), base and spans (arrays of start, rank of the kind, end) for every row of docs."""
    df = docs.select(F.struct(*all_columns(docs)).alias("row"), F.coalesce("text", F.lit("")).alias("_t"), F.xxhash64("doc_id", "text").alias("key"))
    df = df.withColumn("base", F.array_sort(F.concat(_spans("assign", ASSIGN, 6), _spans("access", ACCESS), _spans("hex", HEX))))
    weak = F.when(F.size("base") > 0, F.concat(_spans("endpoint", ENDPOINT), _spans("opaque", OPAQUE))).otherwise(F.expr(f"cast(array() as {SPAN})"))
    table = written(df.select("row", "key", "base", weak.alias("weak")))
    parts = written(table.where(F.size("weak") > 0).select("key", "base", "weak").dropDuplicates(["key"]))
    strong = parts.select("key", F.explode("base").alias("b"))
    loose = parts.select("key", F.explode("weak").alias("w"))
    loose = written(loose.join(_near(loose, strong, reach, -1), ["key", "w"], "left_anti"))
    endpoints = written(_near(loose.where(F.col("w.rank") == KINDS.index("endpoint")), strong, reach, reach))
    anchors = strong.where(F.col("b.rank") == KINDS.index("access")).unionByName(endpoints.select("key", F.col("w").alias("b")))
    opaque = _near(loose.where(F.col("w.rank") == KINDS.index("opaque")), anchors, reach, reach)
    linked = written(endpoints.unionByName(opaque).groupBy("key").agg(F.collect_list("w").alias("linked")))
    size = linked.agg(F.sum(F.size("linked") + 2).alias("n")).first()["n"] or 0
    side = F.broadcast(linked) if size <= BROADCAST_SPANS else linked
    forget(parts, loose, endpoints)
    return table.join(side, "key", "left").select(
        "row", "base", F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked"))).alias("spans")
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    found = scanned(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `text` replaced by mark (overlapping spans together) and n_chars, where there is one, counted anew."""
    text = "row.text"
    clean = F.expr(f"""
        aggregate(spans, struct(cast(array() as array<string>) as done, 0L as at),
            (a, s) -> struct(case when s.start >= a.at then array_append(a.done, concat(substring({text}, cast(a.at + 1 as int), cast(s.start - a.at as int)), '{mark}')) else a.done end as done, greatest(a.at, s.end) as at),
            a -> concat(array_join(a.done, ''), substring({text}, cast(a.at + 1 as int))))""")
    found = scanned(docs).select("row", F.when(F.size("spans") > 0, clean).otherwise(F.col(text)).alias("clean"))
    kinds = dict(docs.dtypes)
    replaced = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").eqNullSafe(F.col(text)), F.col("row.n_chars")).otherwise(F.length("clean")).cast(kinds["n_chars"])} if "n_chars" in kinds else {"text": F.col("clean")}
    return found.select(*(replaced.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
