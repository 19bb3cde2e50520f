"""Capture files built byte by byte, and token traces written and read back."""

import struct

from pyspark.sql import functions as F

from ripplefold.sources import packets as S


def frame(src, dst, sport, dport, flags, seq, payload=b"", options=b"", words=None):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, (5 + len(options) // 4 if words is None else words) << 4, flags, 512, 0, 0) + options + payload
    ip = struct.pack(">BBHHHBBHII", 0x45, 3, 20 + len(tcp), 77, 0, 64, 6, 0, src, dst) + tcp
    return b"\0" * 12 + b"\x08\0" + ip


def test_payload_behind_options(spark):
    """Options of TCP are no payload; a header length under five words, and frames cut off within the header."""
    whole = frame(1, 2, 3, 4, 24, 5, b"data", b"\1\1\x08\x0a" + bytes(8))
    cases = [whole, frame(1, 2, 3, 4, 24, 5, b"data"), frame(1, 2, 3, 4, 24, 5, b"data", words=0), frame(1, 2, 3, 4, 24, 5, b"", bytes(40)), whole[:40], whole[:56]]
    raw = spark.createDataFrame([("f", i, 0, len(f), 1, bytearray(f)) for i, f in enumerate(cases)], S.RAW)
    assert [bytes(r.payload) for r in S.decode_headers(raw).orderBy("pkt_no").collect()] == [b"data", b"data", b"data", b"", b"", b""]


def test_capture(spark, tmp_path):
    frames = [frame(0x0A000001, 0xC0A80001, 1234, 80, 2, 4_000_000_000), frame(0xC0A80001, 0x0A000001, 80, 1234, 18, 7, b"hi"), b"\0" * 14 + b"\x60" + b"\0" * 60]
    body = b"".join(struct.pack("<IIII", 100 + i, 5, len(f), len(f)) + f for i, f in enumerate(frames))
    (tmp_path / "a.pcap").write_bytes(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body)
    raw = S.read_pcap(spark, str(tmp_path / "*.pcap"))
    assert raw.count() == 3
    rows = S.decode_headers(raw).orderBy("pkt_no").collect()
    assert [(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.syn, r.ack, r.seq, r.ttl, r.tos, r.win) for r in rows] == [(0x0A000001, 0xC0A80001, 1234, 80, 1, 0, 4_000_000_000, 64, 3, 512), (0xC0A80001, 0x0A000001, 80, 1234, 1, 1, 7, 64, 3, 512)]
    assert bytes(rows[1].payload) == b"hi"
    bits = S.payload_tokens(S.decode_headers(raw).where("pkt_no = 1"), 4, 4).select("tokens").first()[0]
    assert bits == [6, 8, 6, 9]


def test_traces(spark, tmp_path):
    rows = [(1, 0, 0, [1, 2]), (1, 0, 1, [3, 4]), (1, 1, 0, [5, 6])]
    traces = spark.createDataFrame(rows, "label int, trace_id long, pos int, features array<long>")
    S.write_traces(traces, [0, 2], str(tmp_path / "t"))
    back = S.read_traces(spark, str(tmp_path / "t"), 1)
    got = back.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pos", "features"))).alias("x")).collect()
    assert sorted([[tuple(p.features) for p in r.x] for r in got]) == [[(1, 2), (3, 4)], [(5, 6)]]


def test_lists(spark, tmp_path):
    (tmp_path / "p").write_text("max(sum(x)) 12 1\nf 3 0\n")
    assert [tuple(r) for r in S.read_programs(spark, str(tmp_path / "p")).collect()] == [("max(sum(x))", 12, True), ("f", 3, False)]
    (tmp_path / "s").write_text("2 2 1\nab\ncd\nef\n")
    assert sorted(tuple(r) for r in S.read_labelled_strings(spark, str(tmp_path / "s")).collect()) == [(1, 1, "ab"), (2, 1, "cd"), (3, 0, "ef")]
    (tmp_path / "f.csv").write_text("id,src,sp,dst,dp,proto,time,x,Label\na,1.2.3.4,1,5.6.7.8,2,6,t,0.5,BENIGN\nb,1.2.3.4,1,5.6.7.8,2,6,t,1.5,DoS\n")
    assert S.read_flow_labels(spark, str(tmp_path / "f.csv"), 1, "attack").select("flow_id", "f0").first()[:] == ("b", 1.5)
