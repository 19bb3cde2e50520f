"""Slices, connections, values over patterns, learning and streams against brute force on small tables."""

import itertools
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from ripplefold.functions import expressions as E
from ripplefold.operators import chunks as K
from ripplefold.operators import connections as C
from ripplefold.operators import joins as J
from ripplefold.operators import patterns as Q
from ripplefold.operators import scoring as L
from ripplefold.operators import values as V
from ripplefold.sources import packets as S
from ripplefold.streaming import jobs as R


@pytest.mark.parametrize("n,bits,want", [(150, "101", (64, 127)), (100, "101", (32, 63)), (8, "101", (2, 3)), (64, "101", (16, 31)), (150, "11", (128, 149)), (5, "11", (4, 4)), (1, "1", (0, 0)), (100, "1", (0, 99)), (3, "1101", (5, 2))])
def test_slice_positions(spark, n, bits, want):
    first, last = E.slice_positions(F.lit(n), bits)
    row = spark.range(1).select(first, last, E.slice_exists(F.lit(n), bits)).first()
    assert (row[0], row[1]) == want and row[2] == (want[0] < n)


@pytest.mark.parametrize("form,want", [("==", range(32, 64)), ("->", range(32, 64)), (">=", range(32, 100)), ("<=", range(64))])
def test_in_slice(spark, form, want):
    df = spark.range(100).select((F.col("id") * 7 + 3).alias("x")).unionByName(spark.range(5).select(F.lit(None).cast("long").alias("x")))
    assert sorted(r.x for r in J.in_slice(df, "x", "101", form).collect()) == [7 * i + 3 for i in want]
    assert J.in_slice(df.where("x < 12"), "x", "1101", form).count() == 0


#: The stream of two binary fields that the pattern forms are shown on.
STREAM = "01 11 01 11 00 10 01 11 01 11 00 10 01 01 00".split()


def rows_of(spark, words):
    rows = [(k, i, c, (i * 7 + k) % 11) for k, w in enumerate(words) for i, c in enumerate(w)]
    return spark.createDataFrame(rows, "k int, pos int, c string, v int")


def test_values_over_the_stream(spark):
    df = spark.createDataFrame([(1, i, x[0] == "1", x[1] == "1", i) for i, x in enumerate(STREAM)], "k int, pos int, a boolean, b boolean, v int")
    at = lambda found: found.first()["value"]
    opens, closes = ~F.col("a") & F.col("b"), ~F.col("a") & ~F.col("b")
    pieces, start = [], None
    for i, x in enumerate(STREAM):
        if start is None and x == "01":
            start = i
        if start is not None and x == "00":
            pieces.append(range(start, i + 1))
            start = None
    for inner, outer in itertools.product(("sum", "max", "min"), repeat=2):
        folds = {"sum": sum, "max": max, "min": min}
        assert at(V.iterate(df, ["k"], ["pos"], opens, closes, "v", inner, outer)) == folds[outer](folds[inner](p) for p in pieces)
    assert at(V.iterate(df, ["k"], ["pos"], F.lit(False), closes, "v", "sum", "min")) == 1 << 20
    cut = STREAM.index("00")
    assert at(V.split(df, ["k"], ["pos"], closes, (F.col("b"), "v", "sum"), (F.col("a"), "v", "max"), "sum")) == sum(i for i in range(cut + 1) if STREAM[i][1] == "1") + max(i for i in range(cut + 1, 15) if STREAM[i][0] == "1")
    assert at(V.split(df, ["k"], ["pos"], F.lit(False), (F.lit(True), "v", "sum"), (F.lit(True), "v", "sum"), "sum")) is None


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_counts_by_chunks(spark, chunk, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", chunk)
    rnd = random.Random(chunk)
    words = ["".join(rnd.choice("sfo") for _ in range(rnd.randint(1, 60))) for _ in range(12)]
    pattern = Q.seq(Q.one("s"), Q.star(Q.but("f")), Q.one("f"))
    got = K.count_chunked(rows_of(spark, words), ["k"], ["pos"], F.col("c"), pattern, "sfo").collect()
    assert {r.k: r.n for r in got} == {k: len(re.findall("s[^f]*f", w)) for k, w in enumerate(words)}
    for refused in (Q.seq(Q.one("s"), Q.one("f")), Q.star(Q.one("s")), Q.seq(Q.one("s"), Q.star(Q.anyone())), Q.seq(Q.one("s"), Q.star(Q.one("f")))):
        with pytest.raises(ValueError):
            K.counted(refused, "sfo")


def test_bounds(spark):
    """Every reading of unknown packets, by enumeration."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("sfo?!") for _ in range(rnd.randint(1, 6))) for _ in range(25)]
    codes = {"s": [0], "f": [1], "o": [2], "?": [0, 2], "!": [0, 1, 2]}
    pattern, weight = Q.seq(Q.star(Q.anyone()), Q.one("s"), Q.star(Q.but("f")), Q.one("f")), [1, 3, 0]
    may_be = F.array()
    for c, x in codes.items():
        may_be = F.when(F.col("c") == c, F.array(*map(F.lit, x))).otherwise(may_be)
    got = {r.k: (r.lower, r.upper) for r in V.bounds(rows_of(spark, words), ["k"], ["pos"], may_be, weight, pattern, "sfo").collect()}
    for k, w in enumerate(words):
        sums = [sum(weight[x] for x in reading) for reading in itertools.product(*(codes[c] for c in w)) if re.fullmatch(".*s[^f]*f", "".join("sfo"[x] for x in reading))]
        assert got[k] == ((min(sums), max(sums)) if sums else (None, None))


def test_shared_and_filtered_packets(spark):
    words = ["sofo", "fso", "oo"]
    df = spark.createDataFrame([(k, i * 3 + k, c) for k, w in enumerate(words) for i, c in enumerate(w)] + [(9, 4, "g"), (9, 7, "g")], "k int, pos int, c string")
    got = {r.k: (r.at_start, r.in_all) for r in V.shared_counts(df, ["k"], ["pos"], F.col("c") == "g").collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 9: (0, 2)}
    kept = V.while_open(df, ["k"], ["pos"], F.col("c") == "s", F.col("c") == "f").collect()
    assert sorted((r.k, r.pos) for r in kept) == [(0, 3), (0, 6), (1, 7)]


def test_attached_in_order(spark):
    rnd = random.Random(6)
    labels = sorted((rnd.randrange(3), rnd.randrange(400), 1000 + i) for i in range(14))
    packets = sorted((rnd.randrange(4), rnd.randrange(500), i) for i in range(150))
    want = {}
    for key in range(4):
        own, at, end = sorted((t, i) for k, t, i in labels if k == key), 0, None
        for _, t, i in [p for p in packets if p[0] == key]:
            near = lambda: abs(own[at][0] - t) < 30 or end is not None and abs(end - t) < 30  # noqa: B023, E731
            label, status, skipped = None, "attached", 0
            if not own:
                status = "unknown keys"
            elif at == len(own):
                status = "abnormal"
            elif not near():
                if t < own[at][0]:
                    status = "abnormal"
                else:
                    at, end = at + 1, None
                    while at < len(own) and own[at][0] - t >= 30:
                        at, skipped = at + 1, skipped + 1
                    status = "abnormal" if at == len(own) else "attached" if near() else "passed"
            if status == "attached":
                label, end = own[at][1], t
            want[i] = (label, status, skipped)
    time = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    records = time(spark.createDataFrame(labels, "k int, label_ts long, label_id long"), "label_ts")
    found = J.attach_in_order(records, time(spark.createDataFrame(packets, "k int, ts long, pkt_id long"), "ts"), ["k"], "label_ts", "ts", 30)
    assert {r.pkt_id: (r.label_id, r.status, r.skipped) for r in found.collect()} == want
    report = J.coverage(found, records).first()
    assert report.unlabelled == sum(x[1] == "unknown keys" for x in want.values()) and report.uncovered == len({x[2] for x in labels} - {x[0] for x in want.values()})


def test_sip(spark):
    text = ["INVITE sip:b@x SIP/2.0\r\nFrom: <sip:ann@x.org>;tag=1\r\nCall-ID: 77@x\r\n\r\nm=audio 4000 RTP/AVP 0\r\n", "SIP/2.0 200 OK\r\nCall-ID: 77@x\r\n", "ACK sip:b@x SIP/2.0\r\n", "not sip", None]
    rows = C.sip_fields(spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, payload string")).orderBy("i").collect()
    assert [(r.method, r.code, r.call_id, r.user, r.media_port) for r in rows] == [("INVITE", None, "77@x", "ann", 4000), (None, 200, "77@x", None, None), ("ACK", None, None, None, None), (None,) * 5, (None,) * 5]


def test_learning(spark):
    scores = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(4)], "label int, trace_id int, right boolean")
    weights = scores.select("label", "trace_id", F.lit(1.0).alias("weight"))
    first = L.weighted_round(scores, weights, 0.5, 0.8)
    assert sorted((r.accepted, r.weight) for r in first.collect()) == [(True, 0.9), (True, 0.9), (True, 1.0), (True, 1.0)]
    assert sorted((r.accepted, r.weight) for r in L.weighted_round(scores, first, 0.5, 0.8).collect()) == [(False, 0.9), (False, 0.9), (False, 1.0), (False, 1.0)]
    traces = spark.createDataFrame([(int(t < 20), t, (90 if t < 20 else 10) + t % 2, t % 5) for t in range(40) for _ in range(3)], "label int, trace_id int, len long, dst long")
    best = L.sweep(traces, ["len", "dst"], 2).orderBy("place").first()
    assert (best.tpr, best.tnr) == (1.0, 1.0) and best.program_id.startswith("0:")
    parts = "terms int, joins int, wildcards int, open_parts int, favoured int, nested boolean"
    assert [r.complexity for r in L.complexity(spark.createDataFrame([(3, 2, 1, 1, 3, False), (3, 2, 0, 0, 0, True)], parts)).collect()] == [1440, 2000]


def test_pairs(spark):
    """Runs of pairs against pairing by hand, with ties, unlike class sizes, undefined results and a program of one class."""
    rnd = random.Random(3)
    rows = [(p, int(rnd.random() < share), t, rnd.choice([None, *range(6)])) for p, share in enumerate((0.5, 0.1, 0.9, 0.0)) for t in range(40)]
    df = spark.createDataFrame(rows, "program_id int, label int, trace_id int, upper int").withColumn("lower", F.col("upper") - 1)
    got = {(r.program_id, r.i): (r.pos, r.neg) for r in L.rank_pairs(df, "upper", "lower").collect()}
    want, invalid = {}, {}
    for p in range(3):
        pos = sorted(-1 if u is None else u for q, label, _, u in rows if q == p and label == 1)
        neg = sorted((-1 if u is None else u - 1 for q, label, _, u in rows if q == p and label == 0), reverse=True)
        m = max(len(pos), len(neg))
        want |= {(p, i): (pos[-(-i * len(pos) // m) - 1], neg[-(-i * len(neg) // m) - 1]) for i in range(1, m + 1)}
        invalid[p] = sum(a <= b or a < 0 or b < 0 for (q, _), (a, b) in want.items() if q == p)
    assert got == want
    assert {r.program_id: (r.invalid, r.pairs) for r in L.acceptable(df, 0.5).collect()} == {p: (n, sum(q == p for q, _ in want)) for p, n in invalid.items()}


def test_feature_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2\n3,4\n5,6\n")
    (tmp_path / "y.csv").write_text("n,x\n0,1\n1,0\n2,1\n")
    rows = S.read_feature_csv(spark, str(tmp_path / "x.csv"), str(tmp_path / "y.csv")).orderBy("pos").collect()
    assert [(r.features, r.label) for r in rows] == [([1.0, 2.0], 1), ([3.0, 4.0], 0), ([5.0, 6.0], 1)]
    assert [r.name for r in S.features_of_kind(spark, [1]).orderBy("idx").collect()] == ["src_ip", "src_port", "dst_ip", "dst_port"]
    frame = b"\0" * 12 + b"\x08\0" + struct.pack(">BBHHHBBHII", 0x45, 0, 28, 1, 0, 64, 17, 0, 1, 2) + struct.pack(">HHHH", 9, 53, 8, 0)
    for name, times in (("a", (5, 9)), ("b", (7,))):
        (tmp_path / f"{name}.pcap").write_bytes(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", t, 0, len(frame), len(frame)) + frame for t in times))
    (tmp_path / "marks.csv").write_text("n,x\n0,1\n1,0\n")
    both = S.union_captures(spark, [str(tmp_path / "a.pcap"), str(tmp_path / "b.pcap")]).orderBy("pkt_id").collect()
    assert [r.ts_us // 1_000_000 for r in both] == [5, 7, 9]
    marked = S.read_labelled_pcap(spark, str(tmp_path / "a.pcap"), str(tmp_path / "marks.csv")).orderBy("pkt_no").collect()
    assert [(r.label, r.dst_port) for r in marked] == [(1, 53), (0, 53)]
    flows = spark.createDataFrame([("a", "BENIGN"), ("b", "DoS")], "flow_id string, label string")
    S.write_attack_rows(flows, str(tmp_path / "attacks"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "attacks")).collect()] == [("b", "DoS")]
    S.write_bandwidth(spark.createDataFrame([(0, 3)], "bucket long, total long"), str(tmp_path / "bits"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "bits")).collect()] == [("0", "24")]


def test_traces_of_two_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name, body in (("a", "1 2\n0 2\n5 6\n7 8\n\n"), ("b", "2 2\n0 2\n1 2\n\n3 4\n\n")):
        (tmp_path / "t" / name).write_text(body)
    rows = S.read_traces(spark, str(tmp_path / "t"), 1).collect()
    assert sorted(tuple(r.features) for r in rows) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    assert sorted(tuple(r) for r in S.trace_kinds(spark, str(tmp_path / "t")).collect()) == [(0, 0), (1, 2)]


def test_state_over_batches(spark, tmp_path):
    """One file a batch: counts and deltas add up, each alert comes once; rows behind the watermark are dropped."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id").toPandas()
    cuts = [0, 200, 450, 700, len(events)]
    home = tmp_path / "events.parquet"
    home.mkdir()
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        events[a:b].to_parquet(home / f"part-{i}.parquet", coerce_timestamps="us")
        import os

        os.utime(home / f"part-{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    stream = S.as_packets(R.event_stream(spark, str(tmp_path), 1))
    out = R.drained(R.pattern_state(stream, 1), "update").cache()
    assert out.select("batch").distinct().count() > 1
    want, is_open = {}, {}
    for r in S.packets(spark, str(tmp_path)).where("syn or fin").orderBy("ts", "pkt_id").collect():
        want.setdefault(r.src, 0)
        if r.syn:
            is_open[r.src] = True
        elif is_open.pop(r.src, False):
            want[r.src] += 1
    assert {r.src: r.n for r in out.groupBy("src").agg(F.max_by("n", "batch").alias("n")).collect()} == want
    assert {r.src: r.n for r in out.groupBy("src").agg(F.sum("delta").alias("n")).collect()} == want
    assert sorted(r.src for r in out.where("alert").collect()) == sorted(k for k, n in want.items() if n > 1)
    late = events[:1].assign(event_id=10**6, value=12345.0)
    late.to_parquet(home / "part-9.parquet", coerce_timestamps="us")
    os.utime(home / "part-9.parquet", (1_700_001_000,) * 2)
    sums = R.drained(R.windowed_sums(S.as_packets(R.event_stream(spark, str(tmp_path), 1)), [], "1 hour", None, "1 hour"), "update")
    first = sums.groupBy("window_start").agg(F.max_by("total", "batch").alias("total")).orderBy("window_start").first()
    assert first.total < 1_234_500
