"""Operator 13, substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself. Its blocks are indexed by segments: every window of `width` words belongs
to the least of its k-word hashes, and the windows in a row that share one are a segment, whose place
follows from its words alone, so that a repeated passage has the same segments wherever it stands. A text is
parsed against all blocks at once by looking its segments up in that index: a segment that occurs again is
taken whole, and segments that go on at the same place of the same source become one factor. Where a
factor ends, segments differ though single windows may still repeat; there every window of the segments
that share the hash is looked up by itself. Factors of at least `width` words are the duplicate spans.

Segments and windows are counted by partial aggregates and found again by joins on their hashes, so that a passage
which a third of all texts share has one row for each task that counts it, and no task holds all its texts. A
repeated segment's windows enter the second index once, from the first text only.

Contract: a window is removed with all its words if its word sequence starts at another place of any text,
the same one too; windows are judged on the input. A null or empty text has no words; one with fewer than
`width` words keeps all. Rows that repeat are different texts, and so remove each other. Words are compared by
64-bit hashes of their bytes, and segments and windows by 64-bit hashes of those. A null doc_id is kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import forget, settled, written
from ripplefold.llm.words import EXACT, FIRST, mixed, signed, starts_of, text_blocks

WIDTH = 35
SEED = 12
SEGMENTS = "seed long, segment long, row long, start int, starts int"
WINDOWS = "hash long, row long, start int, repeated boolean"
FACTOR = "struct<start:int,length:int,source:long,source_start:int>"
KEPT = f"row long, doc_id long, n_words long, n_removed long, kept string, factors array<{FACTOR}>"


class Rolling:
    """Hashes of any spans of a block's words, from prefix sums of the words' hashes times powers."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, FIRST)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(FIRST), -1, 1 << 64)))]), dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:n], dtype=np.uint64)])

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words from first up to but not with last; spans of unlike lengths have unlike hashes."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[last] - self.sums[first]) * self.inverse[first], (last - first).astype(np.uint64))


def least_of_each(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` entries the place of its least one, the first of equals."""
    place = np.arange(len(x))
    have = 1
    while have < width:  # of the runs of `have` entries, those `step` apart cover the runs of have + step
        step = min(have, width - have)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(x[b] < x[a], b, a)
        have += step
    return place


def _segments(width: int, k: int):
    def run(batches):
        for batch, block in text_blocks(batches):
            n = len(block.starts)
            if n < width:
                continue
            text_of = np.repeat(np.arange(len(batch)), block.counts)
            whole = text_of[: n - width + 1] == text_of[width - 1 :]
            at, rolling = np.arange(n), Rolling(block.hashes(value=EXACT))
            seeds = rolling.spans(at[: n - k + 1], at[: n - k + 1] + k)
            least = least_of_each(seeds, width - k + 1)
            begins = whole.copy()
            begins[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (text_of[1 : n - width + 1] != text_of[: n - width])
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(whole)) - 1
            last = np.minimum(last, np.append(np.flatnonzero(~whole), len(whole))[np.searchsorted(np.flatnonzero(~whole), first)] - 1)
            row, offset = batch.column("row").to_numpy(), starts_of(block.counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(seeds[least[first]])), pa.array(signed(rolling.spans(first, last + width))), pa.array(row[text_of[first]]),
                pa.array((first - offset[text_of[first]]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
            ], [c.split()[0] for c in SEGMENTS.split(", ")])

    return run


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 and so on, counts[i] of each."""
    return np.repeat(starts - starts_of(counts)[:-1], counts) + np.arange(int(counts.sum()))


def _windows(width: int):
    """The windows of the segments listed in `segments`, by themselves."""

    def run(batches):
        for batch, block in text_blocks(batches):
            rolling, offset = Rolling(block.hashes(value=EXACT)), starts_of(block.counts)
            listed = batch.column("segments")
            own = listed.flatten()
            text_of = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy(zero_copy_only=False))
            start, starts, repeated = (own.field(c).to_numpy(zero_copy_only=False) for c in ("start", "starts", "repeated"))
            place, of = _spread(start, starts), np.repeat(text_of, starts)
            first = place + offset[of]
            row = batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(signed(rolling.spans(first, first + width))), pa.array(row[of]), pa.array(place.astype(np.int32)), pa.array(np.repeat(repeated, starts))], [c.split()[0] for c in WINDOWS.split(", ")])

    return run


def factors_of(start: np.ndarray, starts: np.ndarray, source: np.ndarray, source_start: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Repeated windows as factors (start, length, source, its start), from the left: a factor takes in the windows that go on where
    it ends, in its own text and in its source."""
    out: list[list[int]] = []
    for i in np.argsort(start, kind="stable").tolist():
        a, n, s, b = int(start[i]), int(starts[i]), int(source[i]), int(source_start[i])
        if out and out[-1][2] == s and out[-1][0] + out[-1][1] - width + 1 == a and a - out[-1][0] == b - out[-1][3]:
            out[-1][1] += n
        else:
            out.append([a, n + width - 1, s, b])
    return [tuple(x) for x in out]


def _kept(width: int):
    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                columns: list[list] = [[] for _ in range(6)]
                for row, doc_id, text, found in zip(*(batch.column(c).slice(k, 256).to_pylist() for c in ("row", "doc_id", "text", "found"))):
                    words = (text or "").encode().split()  # of bytes: at these six characters only
                    factors = factors_of(*(np.array([f[c] for f in found], np.int64) for c in ("start", "starts", "source", "source_start")), width) if found else []
                    keep = np.ones(len(words), bool)
                    for a, n, _, _ in factors:
                        keep[a : a + n] = False
                    kept = b" ".join(compress(words, keep.tolist()) if factors else words).decode()
                    for c, x in zip(columns, (row, doc_id, len(words), len(words) - int(keep.sum()), kept, [dict(zip(("start", "length", "source", "source_start"), f)) for f in factors])):
                        c.append(x)
                factor = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), factor]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["row", "doc_id", "n_words", "n_removed", "kept", "factors"])

    return run


def indexed(rows: DataFrame, key: str, *more) -> DataFrame:
    """By key how often it occurs, and the first and another place, for the sources of factors."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.first("row").alias("source"), F.first("start").alias("source_start"), F.last("row").alias("other"), F.last("start").alias("other_start"), *more)


def placed(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key the index holds, with the source: the first place, or the other one where the first is the row itself."""
    itself = (F.col("row") == F.col("source")) & (F.col("start") == F.col("source_start"))
    both = rows.join(index.select(key, "source", "source_start", "other", "other_start"), key)
    return both.select("row", "start", "starts", F.when(itself, F.col("other")).otherwise(F.col("source")).alias("source"), F.when(itself, F.col("other_start")).otherwise(F.col("source_start")).alias("source_start"))


def without_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_words, n_removed, kept (the text that is left, its words joined by one space) and factors for each row of
    docs. Factors are the repeated passages: start and length in words, and the row and place of a source."""
    spark = docs.sparkSession
    texts = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "zstd")
    segments = texts.select("row", "text").mapInArrow(_segments(width, seed), SEGMENTS)
    shared = written(segments.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"))
    common = written(segments.join(shared, "seed"))
    settled(spark)
    by_segment = written(indexed(common, "segment", F.first("seed").alias("seed"), F.first("starts").alias("starts")))
    # a hash whose segments all repeat is done with; otherwise its segments' windows are looked up by themselves
    uneven = written(by_segment.groupBy("seed").agg(F.min("n").alias("least")).where("least = 1").select("seed"))  # written for the same reason as by_window
    apart = by_segment.join(uneven, "seed").select(F.col("source").alias("row"), F.struct(F.col("source_start").alias("start"), "starts", (F.col("n") > 1).alias("repeated")).alias("segment"))
    listed = apart.groupBy("row").agg(F.collect_list("segment").alias("segments"))  # at most one for each word of a text
    windows = written(texts.select("row", "text").join(listed, "row").mapInArrow(_windows(width), WINDOWS))
    settled(spark)
    by_window = written(indexed(windows, "hash", F.max("repeated").alias("repeated")).where("n > 1 or repeated"))  # so that both sides of the join are shuffled, and a window with very many rows can be split
    single = placed(windows.where("not repeated").withColumn("starts", F.lit(1)), by_window, "hash")
    found = written(placed(common, by_segment.where("n > 1"), "segment").unionByName(single))
    forget(shared, common, by_segment, uneven, windows, by_window)
    settled(spark)
    gathered = found.groupBy("row").agg(F.collect_list(F.struct("start", "starts", "source", "source_start")).alias("found"))  # the same bound
    return texts.join(gathered, "row", "left").mapInArrow(_kept(width), KEPT)
