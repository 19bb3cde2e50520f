"""Further registered queries: slices, connections, values over patterns, preparation, learning and keyed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefold.functions import expressions as E
from ripplefold.operators import aggregates as A
from ripplefold.operators import chunks as K
from ripplefold.operators import connections as C
from ripplefold.operators import joins as J
from ripplefold.operators import patterns as Q
from ripplefold.operators import prepare as D
from ripplefold.operators import scoring as L
from ripplefold.operators import values as V
from ripplefold.sources.packets import FEATURES, row_to_features, table, to_features
from ripplefold.sources.stored import stored
from ripplefold.streaming import jobs as R

ORDER = ["ts", "pkt_id"]


def _positions(field: str) -> str:
    return f"WITH v AS (SELECT {field}, row_number() OVER (ORDER BY {field}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {field} FROM {{pk}} WHERE {field} IS NOT NULL)), w AS (SELECT {field}, i, n, CASE WHEN n > 1 AND length(bin(n - 1)) > 2 THEN 1 << (length(bin(n - 1)) - 2) ELSE 1 END AS g FROM v), b AS (SELECT min({field}) AS lo, max({field}) AS hi FROM w WHERE i >= g AND i <= least(2 * g - 1, n - 1))"


def slices(add) -> None:
    for name, form, where in (("p09_dyadic_slice", "==", "src BETWEEN lo AND hi"), ("p09_slice_in", "->", "src BETWEEN lo AND hi"), ("p09_slice_from", ">=", "src >= lo"), ("p09_slice_upto", "<=", "src <= hi")):
        add(name, lambda p, form=form: J.in_slice(p, "src", "101", form).select("pkt_id"), _positions("src") + f" SELECT pkt_id FROM {{pk}}, b WHERE {where}")
    bits = ["1", "10", "11", "101", "1101", "11111111"]

    def valid(p):
        sizes = J.value_positions(p, ["src", "dst", "kind_no"]).select("idx", "n").distinct()
        return sizes.select("idx", F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), E.slice_exists(F.col("n"), b).alias("valid")) for b in bits))).alias("s")).select("idx", "s.bits", "s.valid")

    add("p10_valid_slices", lambda p: valid(p.withColumn("kind_no", F.length("kind").cast("long"))), "WITH s AS (SELECT 0 AS idx, count(DISTINCT src) AS n FROM {pk} UNION ALL SELECT 1, count(DISTINCT dst) FROM {pk} UNION ALL SELECT 2, count(DISTINCT length(kind)) FROM {pk}), d AS (SELECT idx, n, CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END AS d FROM s) SELECT idx, bits, place * (CASE WHEN d > k THEN 1 << (d - k)::INT ELSE 1 END) < n AS valid FROM d, (VALUES " + ", ".join(f"('{b}', {int(b[1:] or '0', 2)}, {len(b) - 1})" for b in bits) + ") v(bits, place, k)")
    add("a19_value_ranges", lambda p: J.value_positions(p, ["src", "dst"]), "SELECT 0 AS idx, v AS value, row_number() OVER (ORDER BY v) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT src AS v FROM {pk} WHERE src IS NOT NULL) UNION ALL SELECT 1, v, row_number() OVER (ORDER BY v) - 1, count(*) OVER () FROM (SELECT DISTINCT dst AS v FROM {pk} WHERE dst IS NOT NULL)")


#: Packets of twenty hosts with sequence numbers, derived from the events: signup is SYN or INVITE, purchase SYN-ACK or 200, click ACK, error BYE, view media.
ENDS_SQL = "k AS (SELECT pkt_id, ts, kind, src % 20 AS src, dst % 20 AS dst, len, sec % 5 AS seq, len % 5 + 1 AS ack_seq FROM {pk} WHERE src IS NOT NULL AND dst IS NOT NULL)"
SHAKES_SQL = "WITH " + ENDS_SQL + """, f AS (SELECT s.pkt_id AS syn_id, s.src, s.dst, r.pkt_id AS syn_ack_id, r.ts AS rts, r.seq AS rseq FROM k s LEFT JOIN k r ON r.kind = 'purchase' AND r.src = s.dst AND r.dst = s.src AND r.ack_seq - 1 = s.seq AND (r.ts > s.ts OR r.ts = s.ts AND r.pkt_id > s.pkt_id)
 WHERE s.kind = 'signup' QUALIFY row_number() OVER (PARTITION BY s.pkt_id ORDER BY r.ts, r.pkt_id) = 1),
 h AS (SELECT f.syn_id, f.src, f.dst, f.syn_ack_id, a.pkt_id AS ack_id FROM f LEFT JOIN k a ON a.kind = 'click' AND a.src = f.src AND a.dst = f.dst AND a.ack_seq - 1 = f.rseq AND (a.ts > f.rts OR a.ts = f.rts AND a.pkt_id > f.syn_ack_id) QUALIFY row_number() OVER (PARTITION BY f.syn_id ORDER BY a.ts, a.pkt_id) = 1)"""
CALLS_SQL = "WITH " + ENDS_SQL + """, g AS (SELECT *, lag(kind) OVER w AS one, lag(kind, 2) OVER w AS two FROM k WHERE kind <> 'view' WINDOW w AS (PARTITION BY src, dst ORDER BY ts, pkt_id)),
 c AS (SELECT g.src, g.dst, g.pkt_id AS call_id, g.ts AS start_ts, (SELECT min(b.ts) FROM k b WHERE b.kind = 'error' AND b.src = g.src AND b.dst = g.dst AND (b.ts > g.ts OR b.ts = g.ts AND b.pkt_id > g.pkt_id)) AS end_ts FROM g WHERE kind = 'click' AND one = 'purchase' AND two = 'signup')"""


def _ends(p):
    known = p.where("src is not null and dst is not null")
    return known.select("pkt_id", "ts", "kind", (F.col("src") % 20).alias("src"), (F.col("dst") % 20).alias("dst"), "len", (E.seconds(F.col("ts")) % 5).alias("seq"), (F.col("len") % 5 + 1).alias("ack_seq"))


def _is(kind: str):
    return F.col("kind") == kind


def connections(add) -> None:
    add("j03_replies", lambda p: C.replies(_ends(p), _is("signup"), _is("purchase")).select("pkt_id", "reply_id"), "WITH " + ENDS_SQL + " SELECT s.pkt_id, r.pkt_id AS reply_id FROM k s LEFT JOIN k r ON r.kind = 'purchase' AND r.src = s.dst AND r.dst = s.src AND (r.ts > s.ts OR r.ts = s.ts AND r.pkt_id > s.pkt_id) WHERE s.kind = 'signup' QUALIFY row_number() OVER (PARTITION BY s.pkt_id ORDER BY r.ts, r.pkt_id) = 1")
    shakes = lambda p: C.handshakes(_ends(p), _is("signup"), _is("purchase"), _is("click"))
    add("j04_handshake", shakes, SHAKES_SQL + " SELECT * FROM h")
    add("q15_half_open", lambda p: C.half_open(shakes(p), 1), SHAKES_SQL + " SELECT dst, src, count(*) FILTER (syn_ack_id IS NOT NULL AND ack_id IS NULL) AS half_open, count(*) FILTER (syn_ack_id IS NOT NULL AND ack_id IS NULL) > 1 AS alert FROM h GROUP BY dst, src")
    calls = lambda p: C.calls(_ends(p), ["src", "dst"], _is("signup"), _is("purchase"), _is("click"), _is("error"))
    add("q16_sip_calls", lambda p: A.count_by(calls(p), ["src"], "calls"), CALLS_SQL + " SELECT src, count(*) AS calls FROM c GROUP BY src")

    signs = lambda: (_is("signup"), _is("purchase"), _is("click"), _is("error"))
    recent_sql = "WITH " + ENDS_SQL.replace("FROM {pk} WHERE", "FROM {pk} WHERE sec > (SELECT max(sec) FROM {pk} WHERE src IS NOT NULL AND dst IS NOT NULL) - 172800 AND") + CALLS_SQL.removeprefix("WITH " + ENDS_SQL)
    add("q19_ongoing_recent", lambda p: C.ongoing(_ends(p), ["src", "dst"], *signs(), 172_800), recent_sql + " SELECT src, dst, call_id, start_ts FROM c WHERE end_ts IS NULL")
    mails = lambda p: C.in_sessions(_ends(p), ["src", "dst"], *signs()).groupBy("call_id", "src", "dst").agg(F.count("*").alias("mails"), F.round(F.avg("len"), 6).alias("mean_len"))
    add("q20_mails_per_connection", mails, "WITH " + ENDS_SQL + """, g AS (SELECT *, lag(kind) OVER w AS one, lag(kind, 2) OVER w AS two FROM k WHERE kind <> 'view' WINDOW w AS (PARTITION BY src, dst ORDER BY ts, pkt_id)),
 m AS (SELECT src, dst, ts, pkt_id, CASE WHEN kind = 'click' AND one = 'purchase' AND two = 'signup' THEN pkt_id WHEN kind = 'error' THEN -1 END AS mark, FALSE AS mail, len FROM g UNION ALL SELECT src, dst, ts, pkt_id, NULL, TRUE, len FROM k WHERE kind = 'view'),
 r AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY src, dst ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call_id FROM m)
SELECT call_id, src, dst, count(*) AS mails, round(avg(len), 6) AS mean_len FROM r WHERE mail AND call_id >= 0 GROUP BY call_id, src, dst""")

    def usage(p):
        media = J.within(calls(p).where("end_ts is not null"), _ends(p).where(_is("view")).select("src", "dst", "ts", "len"), ["src", "dst"], "start_ts", "end_ts", "ts", 86_400)
        return media.groupBy("src").agg(F.sum(F.col("len") + 14).alias("bytes")).withColumn("alert", F.col("bytes") > 50_000)

    add("q17_sip_usage", usage, CALLS_SQL + " SELECT c.src, sum(k.len + 14)::BIGINT AS bytes, sum(k.len + 14) > 50000 AS alert FROM c JOIN k ON k.src = c.src AND k.dst = c.dst AND k.kind = 'view' AND k.ts >= start_ts AND k.ts < end_ts GROUP BY c.src")
    records = lambda p: p.where("syn and pkt_id % 3 = 0").select("src", F.col("pkt_id").alias("label_id"), F.col("ts").alias("label_ts"))
    attached = lambda p: J.attach_in_order(records(p), p.where("not syn"), ["src"], "label_ts", "ts", 86_400)
    add("j01_attach_in_order", attached)
    add("a21_coverage_in_order", lambda p: J.coverage(attached(p), records(p)))
    proto = lambda p: p.withColumn("version", F.when(F.col("pkt_id") % 10 == 0, 6).otherwise(4)).withColumn("protocol", F.when(F.col("src") % 3 == 0, 6).when(F.col("src") % 3 == 1, 17).otherwise(1)).withColumn("src_port", 5050 + F.col("dst") % 20).withColumn("dst_port", F.lit(53))
    view = "v AS (SELECT *, CASE WHEN pkt_id % 10 = 0 THEN 6 ELSE 4 END AS version, CASE src % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS protocol, 5050 + dst % 20 AS src_port, 53 AS dst_port FROM {pk})"
    add("p12_sip_gate", lambda p: proto(p).where(E.is_sip(F.col("protocol"), F.col("src_port"), F.col("dst_port"))).select("pkt_id"), f"WITH {view} SELECT pkt_id FROM v WHERE protocol = 17 AND (src_port = 5060 OR dst_port = 5060)")
    distinct = {"srcips": ("src", ""), "dstips": ("dst", ""), "tcpsrcips": ("src", " AND protocol = 6"), "tcpsrcs": ("src_port", " AND protocol = 6"), "tcpdsts": ("dst_port", " AND protocol = 6"), "udpsrcs": ("src_port", " AND protocol = 17"), "udpdsts": ("dst_port", " AND protocol = 17")}
    add("a16_trace_counters", lambda p: A.trace_counters(proto(p)), f"WITH {view} SELECT count(*) AS packets, count(*) FILTER (version = 4) AS ipv4, count(*) FILTER (version = 6) AS ipv6, count(*) FILTER (version = 4 AND protocol = 6) AS tcp, count(*) FILTER (version = 4 AND protocol = 17) AS udp, count(*) FILTER (version = 4 AND protocol NOT IN (6, 17)) AS other, " + ", ".join(f"count(DISTINCT {c}) FILTER (version = 4{w}) AS {n}" for n, (c, w) in distinct.items()) + ", (SELECT count(*) FROM (SELECT src FROM v WHERE version = 4 UNION SELECT dst FROM v WHERE version = 4)) AS ips FROM v")


PIECES_SQL = "WITH a AS (SELECT {keys}, len, syn, fin, ts, pkt_id, coalesce(sum(fin::INT) OVER (PARTITION BY {keys} ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {pk}), o AS (SELECT {keys}, g, min(pkt_id) FILTER (syn AND r = 1) AS first_id, max(n) FILTER (syn AND r = 1) AS start_n, bool_or(fin) AS done FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, g, syn ORDER BY ts, pkt_id) AS r, row_number() OVER (PARTITION BY {keys}, g ORDER BY ts, pkt_id) AS n FROM a) GROUP BY {keys}, g), m AS (SELECT *, row_number() OVER (PARTITION BY {keys}, g ORDER BY ts, pkt_id) AS n FROM a), s AS (SELECT {keys}, g, sum(len) AS v FROM m JOIN o USING ({keys}, g) WHERE done AND n >= start_n GROUP BY {keys}, g)"


def over_patterns(add) -> None:
    add("q06_iterate_values", lambda p: V.iterate(p, ["src"], ORDER, F.col("syn"), F.col("fin"), "len", "sum", "max"), PIECES_SQL.replace("{keys}", "src") + " SELECT src, coalesce(max(v), 0)::BIGINT AS value FROM (SELECT DISTINCT src FROM {pk}) LEFT JOIN s USING (src) GROUP BY src")
    add("q06_iterate_least", lambda p: V.iterate(p, ["src"], ORDER, F.col("syn"), F.col("fin"), "len", "max", "min"), PIECES_SQL.replace("{keys}", "src").replace("sum(len) AS v", "max(len) AS v") + " SELECT src, coalesce(min(v), 1048576)::BIGINT AS value FROM (SELECT DISTINCT src FROM {pk}) LEFT JOIN s USING (src) GROUP BY src")
    add("q07_split_values", lambda p: V.split(p, ["src"], ORDER, F.col("rst"), (F.col("syn"), "len", "sum"), (F.col("fin"), "len", "max"), "sum"), "WITH a AS (SELECT *, coalesce(max(rst::INT) OVER (PARTITION BY src ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM {pk}) SELECT src, CASE WHEN bool_or(rst) THEN (coalesce(sum(len) FILTER (syn AND rest = 0), 0) + coalesce(max(len) FILTER (fin AND rest = 1), 0))::BIGINT END AS value FROM a GROUP BY src")
    add("q08_agg_over_values", lambda p: V.agg_over(V.iterate(p, ["src", "dst"], ORDER, F.col("syn"), F.col("fin"), "len", "sum", "sum"), ["src"], "max"), PIECES_SQL.replace("{keys}", "src, dst") + ", t AS (SELECT src, dst, coalesce(sum(v), 0) AS v FROM (SELECT DISTINCT src, dst FROM {pk}) LEFT JOIN s USING (src, dst) GROUP BY src, dst) SELECT src, max(v)::BIGINT AS value FROM t GROUP BY src")
    add("q09_pipe_state", lambda p: A.count_by(V.while_open(p, ["src"], ORDER, F.col("syn"), F.col("fin")), ["src"]), "WITH a AS (SELECT src, last_value(CASE WHEN syn THEN 1 WHEN fin THEN 0 END IGNORE NULLS) OVER (PARTITION BY src ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM {pk}) SELECT src, count(*) AS n FROM a WHERE o = 1 GROUP BY src")
    add("q04_shared_packets", lambda p: V.shared_counts(p, ["src"], ORDER, F.col("rst")), "WITH a AS (SELECT src, ts, pkt_id, rst, sum(rst::INT) OVER (ORDER BY ts, pkt_id) - rst::INT AS c FROM {pk}) SELECT src, arg_min(c, (ts, pkt_id))::BIGINT AS at_start, (SELECT count(*) FROM {pk} WHERE rst) AS in_all FROM a GROUP BY src")
    may_be = lambda: F.when(F.col("kind") == "view", F.array(F.lit(0), F.lit(1))).when(F.col("syn"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    add("q10_q11_bounds", lambda p: V.bounds(p, ["src"], ORDER, may_be(), [1, 0], Q.contains(Q.one("s")), "so"), "WITH a AS (SELECT src, count(*) FILTER (syn) AS s, count(*) FILTER (kind = 'view') AS u FROM {pk} GROUP BY src) SELECT src, CASE WHEN s + u > 0 THEN greatest(s, 1) END AS lower, CASE WHEN s + u > 0 THEN s + u END AS upper FROM a")
    flow = Q.seq(Q.one("s"), Q.star(Q.but("f")), Q.one("f"))
    sym = lambda: Q.symbol({"s": F.col("syn"), "f": F.col("fin"), "a": F.col("ack"), "r": F.col("rst")})
    add("q12_count_chunked", lambda p: K.count_chunked(p, ["src"], ORDER, sym(), flow, "sfaro"), "WITH e AS (SELECT src, string_agg(CASE WHEN syn THEN 's' WHEN fin THEN 'f' ELSE 'o' END, '' ORDER BY ts, pkt_id) AS x FROM {pk} GROUP BY src) SELECT src, len(regexp_extract_all(x, 's[^f]*f')) AS n FROM e")


def flows(add) -> None:
    ends = lambda p: p.where("src is not null and dst is not null")
    pair, control = ["src", "dst"], lambda: (F.col("syn"), F.col("fin"))
    rows = "WITH c AS (SELECT * FROM {pk} WHERE (syn OR fin) AND src IS NOT NULL AND dst IS NOT NULL)"
    add("q13_flows_of_two_ends", lambda p: C.completed(ends(p), pair, *control()), rows + ", l AS (SELECT src, dst, fin, lag(syn) OVER (PARTITION BY src, dst ORDER BY ts, pkt_id) AS prev FROM c) SELECT src, dst, count(*) FILTER (fin AND coalesce(prev, FALSE)) AS flows FROM l GROUP BY src, dst")
    add("q14_lives_of_two_ends", lambda p: C.lifetimes(ends(p), pair, *control()), rows + ", l AS (SELECT src, dst, pkt_id, fin, sec, last_value(CASE WHEN syn THEN sec END IGNORE NULLS) OVER (PARTITION BY src, dst ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM c) SELECT src, dst, pkt_id, sec - o AS life FROM l WHERE fin AND o IS NOT NULL")


def preparation(add, add_on) -> None:
    fields = {"src_ip": "src", "dst_ip": "dst", "len": "len", "syn": "syn::INT", "ack": "ack::INT", "fin": "fin::INT", "rst": "rst::INT"}
    add("p16_features", lambda p: to_features(p.withColumnRenamed("src", "src_ip").withColumnRenamed("dst", "dst_ip")).select("pkt_id", F.array_join(F.col("features").cast("array<string>"), " ").alias("features")), "SELECT pkt_id, concat_ws(' ', " + ", ".join(f"coalesce({fields[f]}, 0)" if f in fields else "0" for f in FEATURES) + ") AS features FROM {pk}")
    add("p18_row_features", lambda p: row_to_features(p, ["len", "src", "dst"]).select("pkt_id", (F.get("features", 0) + F.get("features", 1) + 2 * F.get("features", 2)).alias("v")), "SELECT pkt_id, (len + src + 2 * dst)::DOUBLE AS v FROM {pk}")
    add("d04_mix", lambda p: D.mixed_by_ratio(p.withColumn("label", F.col("rst").cast("int")), "label", "pkt_id", 1, 3).select("pkt_id", "label"), "SELECT pkt_id, rst::INT AS label FROM {pk} WHERE NOT rst OR ('0x' || substr(md5(pkt_id::VARCHAR), 1, 8))::BIGINT % 3 < 1")
    add("d02_split_written", lambda p: D.picked(D.split_by(p.select("pkt_id", "src", "dst", "kind"), "kind"), "kind", "error"), "SELECT pkt_id, src, dst, kind FROM {pk} WHERE kind = 'error'")
    add("d09_periodic", lambda p: D.periodic_samples(D.indexed(p, ["src"], ORDER), "idx", 10, 3).select("pkt_id", "sample"), "WITH i AS (SELECT pkt_id, row_number() OVER (PARTITION BY src ORDER BY ts, pkt_id) - 1 AS idx FROM {pk}), o AS (SELECT pkt_id, idx // 10 AS sample, idx % 10 AS spot, ('0x' || substr(md5((idx // 10)::VARCHAR), 1, 8))::BIGINT % 8 AS lo FROM i) SELECT pkt_id, sample FROM o WHERE spot >= lo AND spot < lo + 3")

    def merged(p):
        lists = J.ranked(p.where("syn or fin").select("pkt_id", F.col("fin").cast("int").alias("source")), ["source"], ["pkt_id"], "idx")
        return D.merged(lists.withColumn("idx", F.col("idx") - 1), "source", "idx", [30, 70]).select("place", "pkt_id")

    add("d05_merge", merged, """WITH l AS (SELECT pkt_id, fin::INT AS source, row_number() OVER (PARTITION BY fin ORDER BY pkt_id) AS c FROM {pk} WHERE syn OR fin), t AS (SELECT unnest(range(0, 4 * (SELECT count(*) FROM l))) AS id),
 d AS (SELECT id, CASE WHEN ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 100 < 30 THEN 0 ELSE 1 END AS source FROM t), r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS c FROM d)
 SELECT row_number() OVER (ORDER BY coalesce(id, 4 * (SELECT count(*) FROM l)), l.source, l.c) - 1 AS place, pkt_id FROM l LEFT JOIN r ON r.source = l.source AND r.c = l.c""")
    add("d10_halves", lambda p: D.halves(p, "kind", "pkt_id").select("pkt_id", "half"), "SELECT pkt_id, ntile(2) OVER (PARTITION BY kind ORDER BY pkt_id) AS half FROM {pk}")
    add("d10_one_trace_sets", lambda p: D.one_trace_sets(p.where("src is not null").withColumn("label", F.col("src") % 2), "label", "src"), 'SELECT label, src, row_number() OVER (PARTITION BY label ORDER BY src) AS "set" FROM (SELECT DISTINCT src % 2 AS label, src FROM {pk} WHERE src IS NOT NULL)')
    add("w08_rank", lambda p: J.ranked(p.select("pkt_id", "kind", (-F.col("len")).alias("down")), ["kind"], ["down", "pkt_id"], "r").select("pkt_id", "r"), "SELECT pkt_id, row_number() OVER (PARTITION BY kind ORDER BY len DESC, pkt_id) AS r FROM {pk}")
    days = lambda p: stored(A.partner_sketches(p.where("src is not null").withColumn("day", F.to_date("ts")), ["src", "day"], "dst"))
    add("a08_partner_estimates", lambda p: A.partners_of(days(p), ["src"]), "SELECT src, count(DISTINCT dst) AS partners FROM {pk} WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src")
    text = lambda: F.concat(F.date_format("ts", "d/M/yyyy "), F.when(F.hour("ts") % 12 == 0, 12).otherwise(F.hour("ts") % 12).cast("string"), F.date_format("ts", ":mm"))
    add("w10_f09_clock", lambda p: p.select("pkt_id", E.seconds(E.clock_12(text())).alias("fixed")), "WITH h AS (SELECT pkt_id, date_trunc('day', ts) AS d, CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END AS h, minute(ts) AS m FROM {pk}) SELECT pkt_id, (epoch(d) + h * 3600 + m * 60 + CASE WHEN h < 8 THEN 39600 ELSE -3600 END)::BIGINT AS fixed FROM h")
    add("a08_super_spreaders_approx", lambda p: A.super_spreaders(p, "src", "dst").join(A.super_spreaders_approx(p, "src", "dst").withColumnRenamed("partners", "about"), "src").select("src", (F.abs(F.col("about") - F.col("partners")) <= 1 + 0.2 * F.col("partners")).alias("close")), "SELECT DISTINCT src, TRUE AS close FROM {pk} WHERE src IS NOT NULL AND dst IS NOT NULL")


def learning(add, add_on, scores, score_sql: str, pairs_sql: str) -> None:
    bounded = lambda p: scores(p).withColumn("lower", F.floor(F.col("upper") * 3 / 4).cast("long"))
    add("l05_acceptable", lambda p: L.acceptable(bounded(p), 0.4), pairs_sql.replace("row_number() OVER (PARTITION BY program_id ORDER BY upper DESC, trace_id)", "row_number() OVER (PARTITION BY program_id ORDER BY upper * 3 // 4 DESC, trace_id)").replace("upper AS neg", "upper * 3 // 4 AS neg") + " SELECT program_id, count(*) FILTER (pos <= neg) AS invalid, count(*) AS pairs, count(*) FILTER (pos <= neg) <= 0.6 * count(*) AS accepted FROM j GROUP BY program_id")
    undefined = lambda p: bounded(p).withColumn("lower", F.when(F.col("upper") > 0, F.col("lower"))).withColumn("upper", F.when(F.col("upper") > 0, F.col("upper")))  # noqa: E731  no packet in the range: no match
    to_null = lambda sql: sql.replace("AS upper FROM t CROSS", "AS u FROM t CROSS").replace(" GROUP BY ALL)", " GROUP BY ALL), s AS (SELECT program_id, label, trace_id, CASE WHEN u > 0 THEN u ELSE -1 END AS upper, CASE WHEN u > 0 THEN u * 3 // 4 ELSE -1 END AS lower FROM s0)").replace(", s AS (SELECT program_id, label, trace_id, count(*)", ", s0 AS (SELECT program_id, label, trace_id, count(*)")
    by_lower = lambda sql: sql.replace("row_number() OVER (PARTITION BY program_id ORDER BY upper DESC, trace_id)", "row_number() OVER (PARTITION BY program_id ORDER BY lower DESC, trace_id)").replace("upper AS neg", "lower AS neg")
    bad = "pos <= neg OR pos < 0 OR neg < 0"
    add("l05_undefined", lambda p: L.acceptable(undefined(p), 0.4), to_null(by_lower(pairs_sql)) + f" SELECT program_id, count(*) FILTER ({bad}) AS invalid, count(*) AS pairs, count(*) FILTER ({bad}) <= 0.6 * count(*) AS accepted FROM j GROUP BY program_id")
    verdicts = lambda p: scores(p).select("program_id", "label", "trace_id", ((F.col("upper") > 8) == (F.col("label") == 1)).alias("right"))
    rounds = "".join(f""", r{i} AS (SELECT v.label, v.trace_id, v.ok, w{i - 1}.weight, avg(CASE WHEN v.ok THEN w{i - 1}.weight ELSE 0 END) OVER () >= 0.45 AS accepted FROM v JOIN w{i - 1} ON v.label IS NOT DISTINCT FROM w{i - 1}.label AND v.trace_id IS NOT DISTINCT FROM w{i - 1}.trace_id WHERE program_id = {i - 1} AND v.trace_id IS NOT NULL),
 w{i} AS (SELECT label, trace_id, CASE WHEN accepted AND ok THEN (0.8 + weight) / 2 ELSE weight END AS weight, accepted FROM r{i})""" for i in (1, 2, 3))
    add("l06_weighted_rounds", lambda p: L.weighted_rounds(verdicts(p.where("src is not null")), [0, 1, 2], 0.45, 0.8).withColumn("weight", F.round("weight", 6)), score_sql + ", v AS (SELECT program_id, label, trace_id, (upper > 8) = (label = 1) AS ok FROM s), w0 AS (SELECT DISTINCT label, trace_id, 1.0::DOUBLE AS weight FROM v)" + rounds + " " + " UNION ALL ".join(f"SELECT {i} AS round, accepted, label, trace_id, round(weight, 6) AS weight FROM w{i}" for i in (1, 2, 3)))
    add("l08_budget", lambda p: L.best_under(scores(p), 0.3), score_sql + ", c AS (SELECT program_id, upper, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY program_id, upper), r AS (SELECT program_id, upper, round(sum(p) OVER d / sum(p) OVER w, 6) AS tpr, round(sum(n) OVER d / sum(n) OVER w, 6) AS fpr FROM c WINDOW d AS (PARTITION BY program_id ORDER BY upper DESC), w AS (PARTITION BY program_id)) SELECT program_id, max(tpr) AS tpr, min(upper) AS least_score FROM r WHERE fpr <= 0.3 GROUP BY program_id")
    add("l09_l10_sweep", lambda p: L.sweep(p.where("src is not null and dst is not null").select((F.col("src") % 2).alias("label"), F.col("src").alias("trace_id"), "len", "dst"), ["len", "dst"], 2))
    add("l11_result_vectors", lambda p: L.result_vectors(scores(p)).select("trace_id", F.array_join(F.col("results").cast("array<string>"), " ").alias("results")), score_sql + " SELECT trace_id, string_agg(upper::VARCHAR, ' ' ORDER BY program_id) AS results FROM s GROUP BY trace_id")
    patterns = ["(idiot|moron|loser)", "[#$%&]{3}", "(?s)^.{0,400}$", "[0-9]{4}"]

    def accepted(s, d):
        both = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("toxic", *(F.col("text").rlike(x).alias(f"hit{i}") for i, x in enumerate(patterns)))  # a fixed list of candidates
        counts = both.agg(F.count("*").alias("n"), *(F.count_if((F.col("toxic") == 1) & F.col(f"hit{i}")).alias(f"pos{i}") for i in range(len(patterns))), *(F.count_if((F.col("toxic") == 0) & ~F.col(f"hit{i}")).alias(f"neg{i}") for i in range(len(patterns))))
        return counts.select(F.explode(F.array(*(F.struct(F.lit(i).alias("candidate"), F.col(f"pos{i}").alias("true_pos"), F.col(f"neg{i}").alias("true_neg"), "n") for i in range(len(patterns))))).alias("c")).select("c.*")

    add_on("l12_regex_candidates", accepted, "SELECT candidate, count(*) FILTER (toxic = 1 AND regexp_matches(text, pattern)) AS true_pos, count(*) FILTER (toxic = 0 AND NOT regexp_matches(text, pattern)) AS true_neg, count(*) AS n FROM documents JOIN labels USING (doc_id), (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(patterns)) + ") v(candidate, pattern) GROUP BY candidate")


COUNT_SQL = "WITH e AS (SELECT src, string_agg(CASE WHEN syn THEN 's' ELSE 'f' END, '' ORDER BY ts, pkt_id) AS x FROM {pk} WHERE (syn OR fin) AND src IS NOT NULL GROUP BY src), c AS (SELECT src, len(regexp_extract_all(x, 's+f')) AS n FROM e)"


def streams(add_on) -> None:
    def expiring(s, d):
        seen = R.drained(R.expiring_state(R.packet_stream(s, d), 3, 86_400, "1 hour"), "update")
        return seen.groupBy("src").agg(F.max(F.when(~F.col("expired"), F.col("n"))).alias("n"), F.bool_or("expired").alias("expired"))

    since = """WITH z AS (SELECT src, ts, pkt_id, syn, coalesce(ts - lag(ts) OVER (PARTITION BY src ORDER BY ts, pkt_id) > INTERVAL 1 DAY, FALSE) AS gap FROM {pk} WHERE (syn OR fin) AND src IS NOT NULL),
 y AS (SELECT *, sum(gap::INT) OVER (PARTITION BY src ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS g FROM z), e AS (SELECT src, g, string_agg(CASE WHEN syn THEN 's' ELSE 'f' END, '' ORDER BY ts, pkt_id) AS x FROM y GROUP BY src, g),
 c AS (SELECT src, len(regexp_extract_all(x, 's+f')) AS n FROM e QUALIFY g = max(g) OVER (PARTITION BY src))"""
    add_on("r02_expiring_state", expiring, since + ", l AS (SELECT src, max(ts) AS last FROM {pk} WHERE (syn OR fin) AND src IS NOT NULL GROUP BY src) SELECT src, n, last + INTERVAL 1 DAY <= (SELECT max(last) FROM l) - INTERVAL 1 HOUR AS expired FROM c JOIN l USING (src)")
    changes = lambda s, d: R.drained(R.pattern_state(R.packet_stream(s, d), 3), "update")
    add_on("r02_pattern_state", lambda s, d: changes(s, d).groupBy("src").agg(F.max_by("n", "batch").alias("n")), COUNT_SQL + " SELECT src, n FROM c")
    add_on("r04_alert_once", lambda s, d: changes(s, d).where("alert").select("src"), COUNT_SQL + " SELECT src FROM c WHERE n > 3")
    add_on("r05_deltas", lambda s, d: changes(s, d).groupBy("src").agg(F.sum("delta").alias("n")), COUNT_SQL + " SELECT src, n FROM c")
    add_on("s13_alert_sink", lambda s, d: R.alerts_written(R.alert_rows(R.packet_stream(s, d), 20_000)), "SELECT pkt_id, ts, src, dst, len FROM {pk} WHERE len > 20000")


def register(add, add_on, scores, score_sql: str, pairs_sql: str) -> None:
    slices(add)
    connections(add)
    over_patterns(add)
    flows(add)
    preparation(add, add_on)
    learning(add, add_on, scores, score_sql, pairs_sql)
    streams(add_on)
