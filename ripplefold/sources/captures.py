"""Capture files of any size as a data source: byte ranges that find record borders again, and files that still grow.

Executors open the files themselves, so the path must be mounted alike on the driver and all of them; files in a
store that only Spark's readers reach are read whole by read_pcap. Within a file, `at`, the byte where a packet's
record starts, gives the order.
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ripplefold.operators.joins import numbered

FRAMES = "file string, at long, ts_us long, caplen int, linktype int, raw binary"
HEAD, RECORD = 24, 16
# The first bytes of a capture file, with byte order and whether fractions are nanoseconds.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\xc3\xd4": (">", False), b"\xa1\xb2\x3c\x4d": (">", True)}
CHAIN = 6  # so many records in a row must look right where a border is searched
YEARS = 2 * 365 * 86_400  # a packet this far from the first one in time is taken for no packet where a border is searched
BATCH = 4096


@dataclass
class Capture:
    """An open file with what its header says, and the second of its first packet."""

    file: object
    size: int
    order: str
    nano: bool
    most: int
    linktype: int
    first: int

    @staticmethod
    def opened(path: str) -> Capture | None:
        """None for a file without a whole header, or of another kind."""
        file = open(path, "rb")  # noqa: SIM115  closed by the caller
        head = file.read(HEAD + RECORD)
        if len(head) < HEAD or head[:4] not in MAGIC:
            file.close()
            return None
        order, nano = MAGIC[head[:4]]
        most, linktype = struct.unpack(order + "II", head[16:24])
        first = struct.unpack(order + "I", head[24:28])[0] if len(head) == HEAD + RECORD else 0
        return Capture(file, os.fstat(file.fileno()).st_size, order, nano, max(most, 262_144), linktype, first)

    def head(self, at: int) -> tuple[int, int, int, int] | None:
        """Second, fraction, held and whole length of the record at a byte; None where the file holds no whole record header."""
        self.file.seek(at)
        raw = self.file.read(RECORD)
        return struct.unpack(self.order + "IIII", raw) if len(raw) == RECORD else None

    def may_be(self, head: tuple[int, int, int, int]) -> bool:
        sec, frac, held, whole = head
        return frac < (1_000_000_000 if self.nano else 1_000_000) and held <= self.most and held <= whole and whole < 1 << 26 and abs(sec - self.first) < YEARS

    def border(self, at: int, end: int) -> int:
        """The first record that starts at a byte of [at, end): where a chain of headers looks right; end if there is none."""
        if at <= HEAD:
            return min(HEAD, end)
        block_at, block = at, b""
        for start in range(at, end):
            if start + RECORD > block_at + len(block):
                self.file.seek(start)
                block_at, block = start, self.file.read(1 << 20)
                if len(block) < RECORD:
                    return end
            here, n = start, 0
            head = struct.unpack_from(self.order + "IIII", block, start - block_at)
            while head is not None and self.may_be(head) and n < CHAIN:
                here, n = here + RECORD + head[2], n + 1
                if here >= self.size:
                    break
                head = self.head(here)
            if n == CHAIN or n and (here >= self.size or head is None):  # or the file ends on the way, within a record too
                return start
        return end

    def borders(self, at: int, end: int, width: int) -> list[int]:
        """From a border on, record borders at least `width` apart, the last being the end of the last record that is whole before `end`."""
        found = [at]
        while (head := self.head(at)) is not None and at + RECORD + head[2] <= end:
            at += RECORD + head[2]
            if at - found[-1] >= width:
                found.append(at)
        return found if found[-1] == at else [*found, at]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    exact: bool  # whether start is a border already


def ranges(path: str, start: int, end: int, width: int) -> list[Range]:
    return [Range(path, a, min(a + width, end), a == start) for a in range(start, end, width)]


def frames(part: Range):
    """The packets whose records start in the range, as Arrow batches."""
    capture = Capture.opened(part.path)
    if capture is None:
        return
    with capture.file:
        at = max(part.start, HEAD) if part.exact else capture.border(part.start, part.end)
        rows: list[tuple] = []
        capture.file.seek(at)
        while at < part.end:
            head = capture.file.read(RECORD)
            if len(head) < RECORD:
                break
            sec, frac, held, _ = struct.unpack(capture.order + "IIII", head)
            raw = capture.file.read(held)
            if len(raw) < held:
                break
            rows.append((part.path, at, sec * 1_000_000 + (frac // 1000 if capture.nano else frac), held, capture.linktype, raw))
            at += RECORD + held
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [c.split()[0] for c in FRAMES.split(", ")])


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"], int(options.get("splitbytes", 128 << 20))

    def partitions(self) -> list[Range]:
        return [r for path in sorted(glob.glob(self.path)) for r in ranges(path, 0, os.path.getsize(path), self.width)] or [Range("", 0, 0, True)]

    def read(self, partition: Range):
        if partition.path:
            yield from frames(partition)


class CaptureStream(DataSourceStreamReader):
    """Offsets are the bytes read of each file, which always end a record: a record still being written waits for the next batch. The
    driver reads the new records' headers for that, and cuts ranges at their borders."""

    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"], int(options.get("splitbytes", 128 << 20))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in sorted(glob.glob(self.path)):
            capture = Capture.opened(path)
            if capture is not None:
                with capture.file:
                    self.known[path] = capture.borders(max(HEAD, self.known.get(path, 0)), capture.size, self.width)[-1]
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, to in sorted(end.items()):
            capture = Capture.opened(path)
            if capture is not None:
                with capture.file:
                    cuts = capture.borders(max(HEAD, start.get(path, 0)), to, self.width)
                out += [Range(path, a, b, True) for a, b in zip(cuts, cuts[1:])]
        return out or [Range("", 0, 0, True)]

    def read(self, partition: Range):
        if partition.path:
            yield from frames(partition)


class CaptureSource(DataSource):
    """spark.read.format("capture").load(path), or readStream; option splitBytes is the width of a byte range."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> CaptureReader:
        return CaptureReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream({k.lower(): v for k, v in self.options.items()})


def read_captures(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """Raw frames as FRAMES, with pkt_no over each file's order of bytes; a file is read by as many tasks as it has ranges."""
    spark.dataSource.register(CaptureSource)
    found = spark.read.format("capture").option("splitBytes", split_bytes).load(path)
    return numbered(found, ["file", "at"], "pkt_no")


def capture_stream(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """The same frames as a stream of files that may grow, without pkt_no."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").option("splitBytes", split_bytes).load(path)
