"""Capture files by byte ranges and as growing streams give each packet once."""

import random
import struct

import pytest

from ripplefold.sources import captures as C
from ripplefold.sources.packets import decode_headers, read_pcap


def records(n, order="<", nano=False, seed=1):
    rnd, out = random.Random(seed), []
    for i in range(n):
        frame = bytes(12) + b"\x08\0" + struct.pack(">BBHHHBBHII", 0x45, 0, 28, i % 65_536, 0, 64, 17, 0, 1, 2) + struct.pack(">HHHH", 9, 53, 8, 0) + rnd.randbytes(rnd.choice([0, 0, 30, 900]))
        if i % 5 == 0:  # a payload that looks like a record's header
            frame += struct.pack(order + "IIII", 1_700_000_000 + i, 5, 40, 40)
        out.append(struct.pack(order + "IIII", 1_700_000_000 + i, 123_456_789 if nano else 123_456, len(frame), len(frame)) + frame)
    return out


def header(order="<", nano=False):
    return struct.pack(order + "IHHIIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65_535, 1)


@pytest.mark.parametrize("order,nano", [("<", False), (">", True)])
def test_ranges(spark, tmp_path, order, nano):
    packets = records(400, order, nano)
    (tmp_path / "a.pcap").write_bytes(header(order, nano) + b"".join(packets))
    (tmp_path / "b.pcap").write_bytes(header(order, nano) + packets[0] + packets[1][:20])  # the last record is cut off
    (tmp_path / "c.pcap").write_bytes(b"short")
    (tmp_path / "d.pcap").write_bytes(header(order, nano))
    whole = [tuple(r) for r in C.read_captures(spark, f"{tmp_path}/*.pcap").select("file", "at", "ts_us", "raw", "pkt_no").orderBy("pkt_no").collect()]
    assert len(whole) == 401 and [r[3] for r in whole[:400]] == [p[16:] for p in packets] and {r[2] % 1_000_000 for r in whole} == {123_456}
    for width in (700, 5000, 100_000):
        parts = C.read_captures(spark, f"{tmp_path}/*.pcap", width)
        assert [tuple(r) for r in parts.select("file", "at", "ts_us", "raw", "pkt_no").orderBy("pkt_no").collect()] == whole
    assert C.CaptureReader({"path": f"{tmp_path}/a.pcap", "splitbytes": 5000}).partitions()[3].start == 15_000
    old = read_pcap(spark, f"{tmp_path}/a.pcap")
    assert sorted(bytes(r.raw) for r in old.collect()) == sorted(bytes(r[3]) for r in whole[:400])
    assert decode_headers(C.read_captures(spark, f"{tmp_path}/a.pcap", 5000)).count() == 400


def test_growing_file(spark, tmp_path):
    packets, path = records(60), tmp_path / "live.pcap"
    data = header() + b"".join(packets)
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    for end in (10, 24, 1000, 1007, len(data) // 2, len(data) - 3, len(data), len(data)):  # also within a record
        path.write_bytes(data[:end])
        C.capture_stream(spark, str(path), 2000).writeStream.trigger(availableNow=True).option("checkpointLocation", state).format("parquet").start(out).awaitTermination()
    got = spark.read.parquet(out).orderBy("at").collect()
    assert [bytes(r.raw) for r in got] == [p[16:] for p in packets]
