"""The registered queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplefold.functions import expressions as E
from ripplefold.operators import aggregates as A
from ripplefold.operators import chunks as K
from ripplefold.operators import joins as J
from ripplefold.operators import patterns as Q
from ripplefold.operators import prepare as D
from ripplefold.operators import scoring as L
from ripplefold.operators import windows as W
from ripplefold.plans import extended, swept, valued
from ripplefold.sources.packets import packets, table, trace_texts
from ripplefold.streaming import jobs as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PK = """(SELECT event_id AS pkt_id, ts, user_id AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS dst, CAST(round(value * 100) AS BIGINT) AS len,
 event_type = 'signup' AS syn, event_type = 'purchase' AS fin, event_type = 'click' AS ack, event_type = 'error' AS rst, event_type AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"""
#: Symbols of a packet: s for syn, f for fin, a for ack, r for rst, o for the rest.
SYM_SQL = "CASE WHEN syn THEN 's' WHEN fin THEN 'f' WHEN ack THEN 'a' WHEN rst THEN 'r' ELSE 'o' END"
SYMBOLS = "sfaro"


def sym():
    return Q.symbol({"s": F.col("syn"), "f": F.col("fin"), "a": F.col("ack"), "r": F.col("rst")})


def add(name: str, build, sql: str | None = None) -> None:
    """Registers build(packets) under name, with the SQL whose {pk} is the packet view."""
    QUERIES[name] = lambda spark, sf_dir: build(packets(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql.replace("{pk}", PK)


def add_on(name: str, build, sql: str | None = None) -> None:
    """Registers build(spark, sf_dir)."""
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql.replace("{pk}", PK)


# aggregations
add("a01_count", lambda p: A.count_by(p, ["kind"]), "SELECT kind, count(*) AS n FROM {pk} GROUP BY kind")
add("a02_bytes_per_pair", lambda p: A.sum_by(p, ["src", "dst"], "len", "bytes"), "SELECT src, dst, sum(len)::BIGINT AS bytes FROM {pk} GROUP BY src, dst")
add("a03_count_by_src", lambda p: A.count_by(p, ["src"]), "SELECT src, count(*) AS n FROM {pk} GROUP BY src")
add("a04_heavy_hitters", lambda p: A.heavy_hitters(p, ["src", "dst"], "len", 50_000), "SELECT src, dst, sum(len)::BIGINT AS total FROM {pk} GROUP BY src, dst HAVING sum(len) > 50000")
add("a05_super_spreaders", lambda p: A.super_spreaders(p, "src", "dst", 20), "SELECT src, count(DISTINCT dst) AS partners FROM {pk} GROUP BY src HAVING count(DISTINCT dst) > 20")
add("a06_distinct_sources", lambda p: p.agg(F.count_distinct("src").alias("n")), "SELECT count(DISTINCT src) AS n FROM {pk}")
add("a07_heavy_hitters_sketch", lambda p: A.heavy_hitters_sketch(p, "src", 60), "SELECT src, count(*) AS n FROM {pk} WHERE src IS NOT NULL GROUP BY src HAVING count(*) > 60")
add("a09_frequency", lambda p: A.frequency_by(p, "src").select("src", "n", F.round("share", 9).alias("share")), "SELECT src, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM {pk} GROUP BY src")
add("a10_entropy", lambda p: A.entropy(p, "src"), "WITH c AS (SELECT count(*) AS n FROM {pk} GROUP BY src) SELECT round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM c")
add("a11_flow_size_share", lambda p: A.share_between(p, ["src", "dst"], "len", 10_000, 100_000), "WITH c AS (SELECT sum(len) AS t FROM {pk} GROUP BY src, dst) SELECT count(*) FILTER (t > 10000 AND t < 100000) AS inside, count(*) AS pairs, round(count(*) FILTER (t > 10000 AND t < 100000) / count(*), 6) AS share FROM c")
add("a12_agg_stack", lambda p: A.agg_stack(p, [("max", "src"), ("sum", "dst")], "len"), "WITH a AS (SELECT src, dst, sum(len) AS v FROM {pk} GROUP BY src, dst), b AS (SELECT src, sum(v) AS v FROM a GROUP BY src) SELECT max(v)::BIGINT AS len FROM b")
add("a13_aggregators", lambda p: p.groupBy("kind").agg(*(A.defined(op, "len").alias(op + "_len") for op in ("sum", "max", "min")), F.round(A.defined("avg", "len"), 6).alias("avg_len")), "SELECT kind, sum(len)::BIGINT AS sum_len, max(len) AS max_len, min(len) AS min_len, round(avg(len), 6) AS avg_len FROM {pk} GROUP BY kind")


def _combined(p):
    b = A.merge_bounds(p, ["kind"], "len", "len").agg(F.min("lower").alias("l1"), F.max("upper").alias("u1"), F.max("lower").alias("l2"), F.min("upper").alias("u2"))
    out = []
    for op, name in (("+", "add"), ("-", "sub"), ("*", "mul"), ("/", "div")):
        low, high = A.combine(op, F.col("l1"), F.col("u1"), F.col("l2"), F.col("u2"))
        out += [low.cast("long").alias(f"{name}_lower"), high.cast("long").alias(f"{name}_upper")]
    return b.select(*out)


add("a14_combine", _combined, """WITH m AS (SELECT min(len) AS lo, max(len) AS hi FROM {pk} GROUP BY kind), b AS (SELECT min(lo) AS l1, max(hi) AS u1, max(lo) AS l2, min(hi) AS u2 FROM m)
SELECT l1 + l2 AS add_lower, u1 + u2 AS add_upper, CASE WHEN u1 - l2 >= 0 THEN greatest(l1 - u2, 0) END AS sub_lower, CASE WHEN u1 - l2 >= 0 THEN u1 - l2 END AS sub_upper,
 l1 * l2 AS mul_lower, u1 * u2 AS mul_upper, CASE WHEN l2 <> 0 THEN floor(l1 / u2)::BIGINT END AS div_lower, CASE WHEN l2 <> 0 THEN floor(u1 / l2)::BIGINT END AS div_upper FROM b""")
add("a15_merge_bounds", lambda p: A.merge_bounds(p, ["src"], "len", "len"), "SELECT src, min(len) AS lower, max(len) AS upper FROM {pk} GROUP BY src")
add("a16_trace_stats", A.trace_stats, """SELECT count(*) AS packets, count(*) FILTER (syn) AS syns, count(*) FILTER (fin) AS fins, count(*) FILTER (ack) AS acks, count(*) FILTER (rst) AS rsts, count(DISTINCT src) AS sources,
 count(DISTINCT dst) AS targets, count(DISTINCT (src, dst)) AS pairs, sum(len)::BIGINT AS bytes, (SELECT count(*) FROM (SELECT src FROM {pk} UNION SELECT dst FROM {pk})) AS hosts FROM {pk}""")
add("a17_distinct_hosts", lambda p: p.select("src").union(p.select("dst")).distinct().agg(F.count("*").alias("hosts")), "SELECT count(*) AS hosts FROM (SELECT src FROM {pk} UNION SELECT dst FROM {pk})")
add("a18_label_profile", lambda p: A.label_profile(p, "kind", "ts"), "SELECT kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM {pk} GROUP BY kind")
add("a20_score_histogram", lambda p: A.count_by(A.count_by(p, ["src", "kind"], "upper"), ["kind", "upper"]), "WITH c AS (SELECT src, kind, count(*) AS upper FROM {pk} GROUP BY src, kind) SELECT kind, upper, count(*) AS n FROM c GROUP BY kind, upper")
add("a22_duplicate_acks", lambda p: A.duplicates(p.where("ack"), ["src"], "dst"), "WITH c AS (SELECT src, dst, count(*) AS n FROM {pk} WHERE ack GROUP BY src, dst) SELECT src, count(*) FILTER (n >= 2) AS repeated FROM c GROUP BY src")
add("a23_heavy_users", lambda p: A.heavy_users(p, "src", "len", 1.2), "WITH c AS (SELECT src, sum(len) AS total FROM {pk} GROUP BY src) SELECT src, total::BIGINT AS total FROM c WHERE total * (SELECT count(*) FROM c) > 1.2 * (SELECT sum(total) FROM c)")

# predicates
for _name, _predicate, _sql in (
    ("p01_equal", lambda: F.col("dst") == F.col("src") - 1, "dst = src - 1"), ("p02_not_equal", lambda: F.col("kind") != "view", "kind <> 'view'"), ("p03_greater_less", lambda: (F.col("len") > 5000) & (F.col("len") < 9000), "len > 5000 AND len < 9000"),
    ("p04_all_of", lambda: E.all_of(F.col("syn"), F.col("len") > 100), "syn AND len > 100"), ("p05_any_of", lambda: E.any_of(F.col("syn"), F.col("fin")), "syn OR fin"), ("p06_negation", lambda: ~F.col("ack"), "NOT ack"), ("p07_wildcard", lambda: E.anything(), "TRUE"),
    ("p08_unknown", lambda: E.any_of(E.unknown(), F.col("syn")) & ~(E.unknown() & F.col("fin")), "(NULL OR syn) AND NOT (NULL AND fin)"), ("p11_filter", lambda: F.col("len") >= 200, "len >= 200"), ("p12_gate", lambda: F.col("kind").isin("click", "view"), "kind IN ('click', 'view')"), ("p13_control_gate", lambda: F.col("syn") | F.col("fin"), "syn OR fin"),
):
    add(_name, lambda p, f=_predicate: p.where(f()).select("pkt_id"), f"SELECT pkt_id FROM {{pk}} WHERE {_sql}")
add("p14_choose", lambda p: p.select("pkt_id", E.choose(F.col("syn"), F.col("len"), -F.col("len")).alias("v")), "SELECT pkt_id, CASE WHEN syn THEN len ELSE -len END AS v FROM {pk}")
add("p15_member", lambda p: p.select("pkt_id", F.struct("src", "dst").alias("last")).select("pkt_id", "last.src"), "SELECT pkt_id, src FROM {pk}")


add("p19_flow_length", lambda p: A.count_by(p, ["src", "dst"]).where(F.col("n").between(2, 5)), "SELECT src, dst, count(*) AS n FROM {pk} GROUP BY src, dst HAVING count(*) BETWEEN 2 AND 5")

# windows and time
add("w01_w02_gaps", lambda p: W.gaps(p, ["src"], ["ts", "pkt_id"]).select("pkt_id", "since_last", "to_next"), "SELECT pkt_id, sec - lag(sec) OVER w AS since_last, lead(sec) OVER w - sec AS to_next FROM {pk} WINDOW w AS (PARTITION BY src ORDER BY ts, pkt_id)")
add("w03_sliding_sum", lambda p: W.sliding_sum(p, ["src"], "ts", "pkt_id", "len", 3600, "recent").select("pkt_id", "recent"), "SELECT pkt_id, (coalesce(sum(len) OVER (PARTITION BY src ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING), 0) + sum(len) OVER (PARTITION BY src, sec ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING))::BIGINT AS recent FROM {pk}")
add("w04_traffic_change", lambda p: W.traffic_change(p, ["src"], "ts", "len", 3600).select("pkt_id", "change"), "SELECT pkt_id, (coalesce(sum(len) OVER (PARTITION BY src ORDER BY sec RANGE BETWEEN 7199 PRECEDING AND 3600 PRECEDING), 0) - coalesce(sum(len) OVER (PARTITION BY src ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW), 0))::BIGINT AS change FROM {pk}")
add("w05_recent", lambda p: p.join(F.broadcast(p.agg(F.max("ts").alias("end_ts")))).where(E.seconds(F.col("ts")) > E.seconds(F.col("end_ts")) - 86_400).select("pkt_id"), "SELECT pkt_id FROM {pk} WHERE sec > (SELECT max(sec) FROM {pk}) - 86400")
add("w06_longest_run", lambda p: W.longest_run(p, ["src"], ["ts", "pkt_id"], "ack"), "WITH a AS (SELECT src, ack, row_number() OVER (PARTITION BY src ORDER BY ts, pkt_id) AS n, ts, pkt_id FROM {pk}), b AS (SELECT src, n - row_number() OVER (PARTITION BY src ORDER BY ts, pkt_id) AS g FROM a WHERE ack), c AS (SELECT src, g, count(*) AS r FROM b GROUP BY src, g) SELECT src, max(r) AS longest FROM c GROUP BY src")
add("w07_segments", lambda p: W.segments(p, ["src"], ["ts", "pkt_id"], ["kind"]).select("pkt_id", "segment"), "WITH a AS (SELECT pkt_id, src, ts, CASE WHEN lag(kind) OVER (PARTITION BY src ORDER BY ts, pkt_id) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS c FROM {pk}) SELECT pkt_id, sum(c) OVER (PARTITION BY src ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM a")
add("w09_sample_windows", lambda p: W.sample_windows(p, ["src"], ["ts", "pkt_id"], 10).groupBy("src", "sample").agg(F.count("*").alias("n")), "WITH a AS (SELECT src, (row_number() OVER (PARTITION BY src ORDER BY ts, pkt_id) - 1) // 10 AS sample FROM {pk}) SELECT src, sample, count(*) AS n FROM a GROUP BY src, sample")
add("w10_clock_repair", lambda p: p.select("pkt_id", F.when(F.hour("ts") < 8, F.col("ts") + F.expr("interval 11 hours")).otherwise(F.col("ts") - F.expr("interval 1 hour")).alias("fixed")), "SELECT pkt_id, CASE WHEN hour(ts) < 8 THEN ts + INTERVAL 11 HOUR ELSE ts - INTERVAL 1 HOUR END AS fixed FROM {pk}")
add("t01_tumbling", lambda p: W.tumbling_sums(p, "ts", "len", 3_600_000), "WITH s AS (SELECT epoch_ms(date_trunc('hour', ts)) AS b, sum(len) AS t FROM {pk} GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(b) FROM s), (SELECT max(b) FROM s), 3600000)) AS bucket) SELECT bucket, coalesce(t, 0)::BIGINT AS total FROM g LEFT JOIN s ON b = bucket")

# patterns
_flow = Q.seq(Q.one("s"), Q.star(Q.but("f")), Q.one("f"))
_enc = f"WITH e AS (SELECT src, string_agg({SYM_SQL}, '' ORDER BY ts, pkt_id) AS x FROM {{pk}} GROUP BY src)"
_has = Q.contains(Q.one("s"), Q.star(Q.but("f")), Q.one("r"))
add("q01_match", lambda p: Q.match(p, ["src"], ["ts", "pkt_id"], sym(), _has), _enc + " SELECT src, regexp_full_match(x, '.*s[^f]*r.*') AS matched FROM e")
add("q02_alternation", lambda p: Q.match(p, ["src"], ["ts", "pkt_id"], sym(), Q.contains(Q.one("s"), Q.alt(Q.one("s"), Q.one("r")), Q.one("f"))), _enc + " SELECT src, regexp_full_match(x, '.*s[sr]f.*') AS matched FROM e")
add("q03_parametric", lambda p: Q.match(p.select("ts", "pkt_id", "syn", "fin", "ack", "rst", F.explode(F.array("src", "dst")).alias("x")), ["x"], ["ts", "pkt_id"], sym(), Q.contains(Q.one("s"), Q.one("f"))), f"WITH b AS (SELECT src AS x, ts, pkt_id, {SYM_SQL} AS c FROM {{pk}} UNION ALL SELECT dst, ts, pkt_id, {SYM_SQL} FROM {{pk}}), e AS (SELECT x, string_agg(c, '' ORDER BY ts, pkt_id) AS t FROM b GROUP BY x) SELECT x, regexp_full_match(t, '.*sf.*') AS matched FROM e")
add("q05_match_value", lambda p: Q.match(p, ["src"], ["ts", "pkt_id"], sym(), _has).select("src", F.when(F.col("matched"), 1).alias("v")), _enc + " SELECT src, CASE WHEN regexp_full_match(x, '.*s[^f]*r.*') THEN 1 END AS v FROM e")
add("q06_iterate", lambda p: Q.count_matches(p, ["src"], ["ts", "pkt_id"], sym(), _flow), _enc + " SELECT src, len(regexp_extract_all(x, 's[^f]*f')) AS n FROM e")
add("q07_split", lambda p: Q.encoded(p, ["src"], ["ts", "pkt_id"], sym()).select("src", F.when(F.instr("symbols", "r") > 0, F.length(F.regexp_replace(F.expr("substring(symbols, 1, instr(symbols, 'r'))"), "[^s]", "")) + F.length(F.regexp_replace(F.expr("substring(symbols, instr(symbols, 'r') + 1)"), "[^f]", ""))).cast("long").alias("v")), _enc + " SELECT src, CASE WHEN instr(x, 'r') > 0 THEN length(regexp_replace(substr(x, 1, instr(x, 'r')), '[^s]', '', 'g')) + length(regexp_replace(substr(x, instr(x, 'r') + 1), '[^f]', '', 'g')) END AS v FROM e")
add("q08_agg_over", lambda p: Q.count_matches(p, ["src"], ["ts", "pkt_id"], sym(), _flow).agg(F.max("n").alias("most"), F.sum("n").alias("flows")), _enc + " SELECT max(len(regexp_extract_all(x, 's[^f]*f'))) AS most, sum(len(regexp_extract_all(x, 's[^f]*f')))::BIGINT AS flows FROM e")
add("q09_pipe", lambda p: A.count_by(p.where("len > 5000").where("syn or fin"), ["src"]), "SELECT src, count(*) AS n FROM {pk} WHERE len > 5000 AND (syn OR fin) GROUP BY src")
add("q01_match_by_fold", lambda p: Q.match_by_fold(p, ["src"], ["ts", "pkt_id"], sym(), _has, SYMBOLS), _enc + " SELECT src, regexp_full_match(x, '.*s[^f]*r.*') AS matched FROM e")
add("q12_match_chunked", lambda p: K.match_chunked(p, ["src"], ["ts", "pkt_id"], sym(), _has, SYMBOLS), _enc + " SELECT src, regexp_full_match(x, '.*s[^f]*r.*') AS matched FROM e")


def _flow_num(p):
    ctl = p.where("syn or fin")
    w = Window.partitionBy("src").orderBy("ts", "pkt_id")
    return ctl.withColumn("prev", F.lag("syn").over(w)).groupBy("src").agg(F.count_if(F.col("fin") & F.coalesce("prev", F.lit(False))).alias("flows"))


add("q13_completed_flows", _flow_num, "WITH c AS (SELECT src, fin, lag(syn) OVER (PARTITION BY src ORDER BY ts, pkt_id) AS prev FROM {pk} WHERE syn OR fin) SELECT src, count(*) FILTER (fin AND coalesce(prev, FALSE)) AS flows FROM c GROUP BY src")


def _flow_life(p):
    w = Window.partitionBy("src").orderBy("ts", "pkt_id").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("syn"), F.col("ts")), ignorenulls=True).over(w)
    return p.where("syn or fin").withColumn("opened", opened).where("fin and opened is not null").select("pkt_id", (E.seconds(F.col("ts")) - E.seconds(F.col("opened"))).alias("life"))


add("q14_flow_life", _flow_life, "WITH c AS (SELECT pkt_id, fin, sec, last_value(CASE WHEN syn THEN sec END IGNORE NULLS) OVER (PARTITION BY src ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM {pk} WHERE syn OR fin) SELECT pkt_id, sec - o AS life FROM c WHERE fin AND o IS NOT NULL")
add("q18_transitions", lambda p: p.withColumn("prev", F.lag("kind").over(Window.partitionBy("src").orderBy("ts", "pkt_id"))).groupBy("src").agg(F.count_if((F.col("prev") == "view") & (F.col("kind") == "click")).alias("requests")), "WITH c AS (SELECT src, kind, lag(kind) OVER (PARTITION BY src ORDER BY ts, pkt_id) AS prev FROM {pk}) SELECT src, count(*) FILTER (prev = 'view' AND kind = 'click') AS requests FROM c GROUP BY src")
add("q19_ongoing", lambda p: Q.match(p, ["src"], ["ts", "pkt_id"], sym(), Q.seq(Q.star(Q.anyone()), Q.one("s"), Q.star(Q.but("f")))).where("matched").select("src"), _enc + " SELECT src FROM e WHERE regexp_full_match(x, '.*s[^f]*')")
add_on("q20_word_count", lambda s, d: table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit("the")).cast("long").alias("n")), "SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n FROM documents")

# joins
add("j03_canonical_direction", lambda p: A.sum_by(p.withColumn("low", F.least("src", "dst")).withColumn("high", F.greatest("src", "dst")), ["low", "high"], "len"), "SELECT least(src, dst) AS low, greatest(src, dst) AS high, sum(len)::BIGINT AS total FROM {pk} GROUP BY 1, 2")


def _inside(p):
    w = Window.partitionBy("src").orderBy("ts", "pkt_id")
    calls = p.where("syn or fin").withColumn("end_ts", F.lead(F.when(F.col("fin"), F.col("ts"))).over(w)).where("syn and end_ts is not null").select("src", F.col("pkt_id").alias("call_id"), F.col("ts").alias("start_ts"), "end_ts")
    return J.within(calls, p.select("src", "ts", "len"), ["src"], "start_ts", "end_ts", "ts", 86_400).groupBy("call_id").agg(F.sum("len").alias("total"))


add("j05_interval_join", _inside, "WITH c AS (SELECT src, pkt_id AS call_id, ts AS a, lead(CASE WHEN fin THEN ts END) OVER (PARTITION BY src ORDER BY ts, pkt_id) AS b, syn FROM {pk} WHERE syn OR fin) SELECT call_id, sum(p.len)::BIGINT AS total FROM c JOIN {pk} p ON p.src = c.src AND p.ts >= c.a AND p.ts < c.b WHERE c.syn AND c.b IS NOT NULL GROUP BY call_id")
add("j06_own_aggregate", lambda p: p.select("pkt_id", F.sum("len").over(Window.partitionBy("src", "dst").orderBy("ts", "pkt_id").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far")), "SELECT pkt_id, sum(len) OVER (PARTITION BY src, dst ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM {pk}")
add("j07_seen_before", lambda p: J.seen_before(p, "dst", "ts", p.where("syn"), "src", "ts").select("pkt_id", "allowed"), "WITH f AS (SELECT src AS h, min(ts) AS t FROM {pk} WHERE syn GROUP BY src) SELECT pkt_id, coalesce(t < ts, FALSE) AS allowed FROM {pk} LEFT JOIN f ON h = dst")
add("j08_never_after", lambda p: J.never_after(p.where("syn"), ["src", "dst"], "ts", p, "ts").select("pkt_id"), "SELECT pkt_id FROM {pk} a WHERE syn AND NOT EXISTS (SELECT 1 FROM {pk} b WHERE b.src = a.src AND b.dst = a.dst AND b.ts > a.ts)")
add("j09_never_before", lambda p: J.never_before(p.where("fin"), ["src", "dst"], "ts", p.where("syn"), "ts").select("pkt_id"), "SELECT pkt_id FROM {pk} a WHERE fin AND NOT EXISTS (SELECT 1 FROM {pk} b WHERE b.syn AND b.src = a.src AND b.dst = a.dst AND b.ts < a.ts)")
add("j02_positional_zip", lambda p: J.zipped(p.where("syn").select(F.col("pkt_id").alias("left_id")), ["left_id"], p.where("fin").select(F.col("pkt_id").alias("right_id")), ["right_id"]), "WITH a AS (SELECT pkt_id AS left_id, row_number() OVER (ORDER BY pkt_id) - 1 AS pos FROM {pk} WHERE syn), b AS (SELECT pkt_id AS right_id, row_number() OVER (ORDER BY pkt_id) - 1 AS pos FROM {pk} WHERE fin) SELECT pos, left_id, right_id FROM a JOIN b USING (pos)")
add("j01_attach_labels", lambda p: J.attach_labels(p.where("syn").select("src", F.col("pkt_id").alias("label_id"), F.col("ts").alias("label_ts")), p.where("not syn"), ["src"], "label_ts", "ts", 86_400), """WITH l AS (SELECT src, pkt_id AS label_id, ts AS lt, sec AS ls FROM {pk} WHERE syn), j AS (SELECT p.pkt_id, l.label_id, abs(p.sec - l.ls) AS gap, row_number() OVER (PARTITION BY p.pkt_id ORDER BY abs(p.sec - l.ls), l.lt, l.label_id) AS r
 FROM {pk} p JOIN l ON l.src = p.src AND abs(p.sec - l.ls) < 86400 WHERE NOT p.syn) SELECT pkt_id, label_id, gap FROM j WHERE r = 1""")
add("a21_coverage", lambda p: J.attach_labels(p.where("syn").select("src", F.col("pkt_id").alias("label_id"), F.col("ts").alias("label_ts")), p.where("not syn"), ["src"], "label_ts", "ts", 86_400).agg(F.count("*").alias("labelled"), F.count_distinct("label_id").alias("records")), """WITH l AS (SELECT src, pkt_id AS label_id, ts AS lt, sec AS ls FROM {pk} WHERE syn), j AS (SELECT p.pkt_id, l.label_id, row_number() OVER (PARTITION BY p.pkt_id ORDER BY abs(p.sec - l.ls), l.lt, l.label_id) AS r
 FROM {pk} p JOIN l ON l.src = p.src AND abs(p.sec - l.ls) < 86400 WHERE NOT p.syn) SELECT count(*) AS labelled, count(DISTINCT label_id) AS records FROM j WHERE r = 1""")
add("q21_orphans", lambda p: A.super_spreaders(J.never_after(p.where("syn"), ["src", "dst"], "ts", p, "ts"), "src", "dst", 2), "SELECT src, count(DISTINCT dst) AS partners FROM {pk} a WHERE syn AND NOT EXISTS (SELECT 1 FROM {pk} b WHERE b.src = a.src AND b.dst = a.dst AND b.ts > a.ts) GROUP BY src HAVING count(DISTINCT dst) > 2")
add("q22_unsolicited", lambda p: A.super_spreaders(J.never_before(p.where("fin"), ["src", "dst"], "ts", p.where("syn"), "ts"), "dst", "src", 2), "SELECT dst, count(DISTINCT src) AS partners FROM {pk} a WHERE fin AND NOT EXISTS (SELECT 1 FROM {pk} b WHERE b.syn AND b.src = a.src AND b.dst = a.dst AND b.ts < a.ts) GROUP BY dst HAVING count(DISTINCT src) > 2")
add("q23_firewall", lambda p: J.seen_before(p, "dst", "ts", p.where("syn"), "src", "ts").select("pkt_id", F.when(F.col("allowed"), "allow").otherwise("drop").alias("action")), "WITH f AS (SELECT src AS h, min(ts) AS t FROM {pk} WHERE syn GROUP BY src) SELECT pkt_id, CASE WHEN t < ts THEN 'allow' ELSE 'drop' END AS action FROM {pk} LEFT JOIN f ON h = dst")

# order and sets
add("o01_order", lambda p: p.select("pkt_id", "ts").orderBy("ts", "pkt_id"), "SELECT pkt_id, ts FROM {pk}")
add("o03_first_flows", lambda p: D.indexed(A.count_by(p, ["src", "dst"]), ["src"], ["dst"]).where("idx < 3").select("src", "dst", "idx"), "WITH c AS (SELECT DISTINCT src, dst FROM {pk}) SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS idx FROM c QUALIFY idx < 3")
add("u01_union", lambda p: A.count_by(p.where("syn").unionByName(p.where("fin")), ["kind"]), "SELECT kind, count(*) AS n FROM {pk} WHERE syn OR fin GROUP BY kind")
add("u02_distinct", lambda p: p.select("src", "kind").distinct(), "SELECT DISTINCT src, kind FROM {pk}")

# trace preparation
_flows_sql = "f AS (SELECT src, dst, min(ts) AS open_ts, max(ts) AS end_ts, count(*) AS n_pkts, sum(len)::BIGINT AS bytes FROM {pk} GROUP BY src, dst)"
_flows = lambda p: D.assemble_flows(p, ["src", "dst"], "ts", "len")
_idx_sql = f"WITH {_flows_sql}, i AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY open_ts, dst) - 1 AS idx FROM f)"
_idx = lambda p: D.indexed(_flows(p), ["src"], ["open_ts", "dst"])
add("d01_flows", _flows, f"WITH {_flows_sql} SELECT * FROM f")
add("d02_split_by_kind", lambda p: A.count_by(p.where("kind <> 'view'"), ["src", "kind"]).where("kind = 'error'"), "SELECT src, kind, count(*) AS n FROM {pk} WHERE kind = 'error' GROUP BY src, kind")
add("d03_batches", lambda p: D.batches(_idx(p), "idx", 4, 5, 2, 1).select("src", "dst", "sample"), _idx_sql + " SELECT src, dst, (idx - 2) // 5 AS sample FROM i WHERE idx >= 2 AND (idx - 2) // 5 < 5 AND (idx - 2) % 5 < 4")
add("d06_rechunk", lambda p: D.rechunked(_idx(p), "idx", [2, 5]).groupBy("src", "size", "sample").agg(F.count("*").alias("n")), _idx_sql + " SELECT src, s AS size, idx // s AS sample, count(*) AS n FROM i, (VALUES (2), (5)) v(s) GROUP BY src, s, idx // s")
add("d07_interleave", lambda p: D.interleaved(D.indexed(p.withColumn("label", F.col("rst").cast("int")), ["src", "label"], ["ts", "pkt_id"]), "label", "idx", 3, 1).select("pkt_id", "slot"), "WITH i AS (SELECT pkt_id, rst, row_number() OVER (PARTITION BY src, rst ORDER BY ts, pkt_id) - 1 AS idx FROM {pk}) SELECT pkt_id, CASE WHEN NOT rst THEN idx // 3 * 4 + idx % 3 ELSE idx * 4 + 3 END AS slot FROM i")
add("d08_after_trigger", lambda p: D.after_trigger(p, ["src"], ["ts", "pkt_id"], "syn").select("pkt_id"), "SELECT pkt_id FROM (SELECT pkt_id, max(syn::INT) OVER (PARTITION BY src ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS o FROM {pk}) WHERE o = 1")
add("d11_one_class", lambda p: D.indexed(p.where("rst"), ["src"], ["ts", "pkt_id"]).where("idx between 2 and 6").select("pkt_id"), "SELECT pkt_id FROM (SELECT pkt_id, row_number() OVER (PARTITION BY src ORDER BY ts, pkt_id) - 1 AS i FROM {pk} WHERE rst) WHERE i BETWEEN 2 AND 6")
add("s06_trace_texts", lambda p: trace_texts(p.select(F.lit(1).alias("label"), F.col("src").alias("trace_id"), F.col("pkt_id").alias("pos"), F.array("dst", "len").alias("features"))), "SELECT 1 AS label, src AS trace_id, string_agg(dst || ' ' || len, chr(10) ORDER BY pkt_id) AS text FROM {pk} GROUP BY src")

# scoring
_prog = [(i, i * 2000, i * 2000 + 2999) for i in range(5)]
_prog_sql = "g AS (SELECT * FROM (VALUES " + ", ".join(map(str, _prog)) + ") v(program_id, low, high))"
_score_sql = f"WITH {_prog_sql}, t AS (SELECT src AS trace_id, src % 2 AS label, len AS x FROM {{pk}}), s AS (SELECT program_id, label, trace_id, count(*) FILTER (x BETWEEN low AND high) AS upper FROM t CROSS JOIN g GROUP BY ALL)"


def _scores(p):
    programs = p.sparkSession.createDataFrame(_prog, "program_id int, low long, high long")
    return L.grid(p.select(F.col("src").alias("trace_id"), (F.col("src") % 2).alias("label"), F.col("len").alias("x")), programs, ["label", "trace_id"])


add("l01_scores", _scores, _score_sql + " SELECT program_id, label, trace_id, upper FROM s")
add("l02_classified", lambda p: L.classified(_scores(p), F.lit(8), F.lit(True)).select("program_id", "trace_id", "positive"), _score_sql + " SELECT program_id, trace_id, upper > 8 AS positive FROM s")
add("l03_accuracy", lambda p: L.accuracy(L.classified(_scores(p), F.lit(8), F.lit(True))), _score_sql + " SELECT program_id, round(avg((upper > 8)::INT) FILTER (label = 1), 6) AS tpr, round(avg((upper <= 8)::INT) FILTER (label = 0), 6) AS tnr FROM s GROUP BY program_id")
_pairs_sql = _score_sql + """, p AS (SELECT program_id, upper AS pos, row_number() OVER (PARTITION BY program_id ORDER BY upper, trace_id) AS ip FROM s WHERE label = 1), n AS (SELECT program_id, upper AS neg, row_number() OVER (PARTITION BY program_id ORDER BY upper DESC, trace_id) AS ineg FROM s WHERE label = 0),
 z AS (SELECT program_id, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM s GROUP BY program_id), k AS (SELECT program_id, np, nn, unnest(range(1, greatest(np, nn) + 1)) AS i FROM z),
 j AS (SELECT k.program_id, k.i, pos, neg FROM k JOIN p ON p.program_id = k.program_id AND p.ip = ceil(k.i * np / greatest(np, nn)) JOIN n ON n.program_id = k.program_id AND n.ineg = ceil(k.i * nn / greatest(np, nn)))"""
add("j11_rank_pairs", lambda p: L.rank_pairs(_scores(p)), _pairs_sql + " SELECT program_id, i, pos, neg FROM j")
add("l04_thresholds", lambda p: L.thresholds(_scores(p)), _pairs_sql + " SELECT program_id, count(*) FILTER (pos <= neg) AS invalid, arg_min(floor((pos + neg) / 2)::BIGINT, i) FILTER (pos > neg) AS threshold FROM j GROUP BY program_id")
add("l07_roc", lambda p: L.roc(_scores(p)), _score_sql + ", c AS (SELECT program_id, upper, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY program_id, upper) SELECT program_id, upper, round(sum(p) OVER d / sum(p) OVER w, 6) AS tpr, round(sum(n) OVER d / sum(n) OVER w, 6) AS fpr FROM c WINDOW d AS (PARTITION BY program_id ORDER BY upper DESC), w AS (PARTITION BY program_id)")
add("l07_auc", lambda p: L.area(_scores(p)), _score_sql + ", a AS (SELECT program_id, upper AS u FROM s WHERE label = 1), b AS (SELECT program_id, upper AS u FROM s WHERE label = 0) SELECT a.program_id, round(avg(CASE WHEN a.u > b.u THEN 1.0 WHEN a.u = b.u THEN 0.5 ELSE 0.0 END), 6) AS auc FROM a JOIN b USING (program_id) GROUP BY a.program_id")
add_on("l12_regex_acceptance", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id").withColumn("hit", F.col("text").rlike("(idiot|moron|loser)")).groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")), "SELECT toxic, count(*) AS n, count(*) FILTER (regexp_matches(text, '(idiot|moron|loser)')) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY toxic")

# functions
add("f01_f03_arithmetic", lambda p: p.select("pkt_id", (F.col("len") + F.col("src") * 2 - F.col("dst")).alias("v"), F.round(F.ln(F.col("len") + 1), 6).alias("log"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")), "SELECT pkt_id, len + src * 2 - dst AS v, round(ln(len + 1), 6) AS log, least(src, dst) AS lo, greatest(src, dst) AS hi FROM {pk}")
add("f04_f05_addresses", lambda p: p.select("pkt_id", E.ip_to_text(F.col("src") * 65_537 + F.col("dst")).alias("ip")).withColumn("back", E.ip_to_long(F.col("ip"))), "WITH a AS (SELECT pkt_id, src * 65537 + dst AS x FROM {pk}) SELECT pkt_id, concat_ws('.', (x >> 24) & 255, (x >> 16) & 255, (x >> 8) & 255, x & 255) AS ip, x & 4294967295 AS back FROM a")
add("f10_time_bucket", lambda p: A.count_by(p.select(E.bucket_ms(F.col("ts"), 60_000).alias("bucket")), ["bucket"]), "SELECT epoch_ms(date_trunc('minute', ts)) AS bucket, count(*) AS n FROM {pk} GROUP BY 1")

# streams over the event table
add_on("r01_live_counts", lambda s, d: R.drained(R.live_counts(R.packet_stream(s, d), "src"), "update").groupBy("src").agg(F.max_by("n", "batch").alias("n")), "SELECT src, count(*) AS n FROM {pk} GROUP BY src")
add_on("r06_same_query", lambda s, d: R.drained(R.packet_stream(s, d).where("syn or fin").select("pkt_id", "src")), "SELECT pkt_id, src FROM {pk} WHERE syn OR fin")
add_on("r07_tumbling_stream", lambda s, d: R.drained(R.windowed_sums(R.packet_stream(s, d), [], "1 hour", None, "1 hour"), "update").groupBy("window_start").agg(F.max_by("total", "batch").alias("total")), "SELECT date_trunc('hour', ts) AS window_start, sum(len)::BIGINT AS total FROM {pk} GROUP BY 1")
add_on("r03_sliding_stream", lambda s, d: R.drained(R.windowed_sums(R.packet_stream(s, d), ["src"], "2 hours", "1 hour", "2 hours"), "update").groupBy("src", "window_start").agg(F.max_by("total", "batch").alias("total")), "SELECT src, w AS window_start, sum(len)::BIGINT AS total FROM (SELECT src, len, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM {pk}) GROUP BY src, w")

extended.register(add, add_on, _scores, _score_sql, _pairs_sql)
valued.register(add)
swept.register(add)
