"""Operator 1, language-model scoring with a log-frequency Bloom filter.

Counts of single tokens and of token pairs are gathered over the whole training part, hash bucket by
hash bucket. Each bucket turns its counts into a segment of one Bloom filter: an n-gram with count c is
entered under the levels 1..q, where q = 1 + floor(log(c) / log(step)). The same task probes its segment
level after level, until one is missing, for all n-grams that any text holds, and sends the levels back to
the parts of the corpus that asked. No task and no driver ever holds the whole filter.

A level stands for the counts from count_of(level) to most_of(level). The probability of a token after another
takes the least count of the pair and the greatest of the token before, and mixes in the single-token estimate with a
fixed weight; that estimate discounts every known token and spreads what it gains evenly over as many unknown tokens
as there are known ones, and one more. So the probabilities after any token sum to 1 at most, but for the filter's
false positives (`bits_per_entry`).

Contract: the filter takes `bits_per_entry` for each entry, whatever the size of the corpus. Null or empty
texts have one token, the end. A null doc_id counts as a training row. Repeated rows give repeated
results. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import buckets_for, packed, remainder, unpacked, written
from ripplefold.llm.words import Block, mixed, starts_of, text_blocks

END = np.uint64(0x5E4D3C2B1A090807)
HASHES = 4
STEP = 1.4
DISCOUNT = 0.75
PAIR_WEIGHT = 200.0
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GATHERED = "kind string, bucket int, flush long, n long, v long, blob binary"


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(STEP) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The smallest count that has this level; 0 for level 0."""
    return np.where(levels > 0, np.ceil(STEP ** (np.maximum(levels, 1) - 1.0) - 1e-9), 0.0)


def most_of(levels: np.ndarray) -> np.ndarray:
    """The greatest count that has this level; 0 for level 0."""
    return np.where(levels > 0, np.maximum(count_of(levels + 1) - 1, count_of(levels)), 0.0)


def alone(count: np.ndarray, n_train: int, n_types: int) -> np.ndarray:
    """The single-token probability by (quantised) count; 0 is an unknown token."""
    unknown = DISCOUNT * n_types / max(n_train, 1) / (n_types + 1) if n_train else 1.0
    return np.where(count > 0, np.maximum(count - DISCOUNT, 0.0) / max(n_train, 1), unknown)


def after(pair: np.ndarray, before: np.ndarray, single: np.ndarray, weight: float) -> np.ndarray:
    """The probability of a token after another, by the pair's count, that of the token before, and the token's own probability."""
    return (pair + weight * single) / (before + weight)


def bit_places(keys: np.ndarray, level: int, n_bits: np.ndarray | int) -> np.ndarray:
    """HASHES places in 0..n_bits-1 for each n-gram under one level."""
    with np.errstate(over="ignore"):
        a = mixed(keys, np.uint64(level + 11))
        b = (a >> np.uint64(32)) | np.uint64(1)
        mask = np.uint64(0xFFFFFFFF)
        size = np.asarray(n_bits, np.uint64)
        return np.stack([(((a + b * np.uint64(i * i + i)) & mask) * size) >> np.uint64(32) for i in range(HASHES)])


def filter_segment(keys: np.ndarray, counts: np.ndarray, bits_per_entry: float, most_bits: int = 2**32) -> np.ndarray:
    """The filter's bytes for one bucket's n-grams."""
    levels = level_of(counts)
    n_bits = int(max(64, levels.sum() * bits_per_entry)) // 8 * 8
    if n_bits > most_bits:
        raise ValueError(f"a filter segment needs {n_bits} bits, over {most_bits}; use more buckets")
    bits = np.zeros(n_bits, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        bits[bit_places(keys[levels >= j], j, n_bits).ravel()] = True
    return np.packbits(bits, bitorder="little")


class LogFrequencyFilter:
    """Quantised counts by repeated membership probes, up to the highest level that was entered, where that is given."""

    def __init__(self, content: bytes, sizes: list[int], top: int = 2 * int(level_of(np.array([2**62]))[0])) -> None:
        self.bits, self.top = np.frombuffer(content, np.uint8), top
        self.sizes = np.array(sizes, np.uint64) * np.uint64(8)
        self.starts = starts_of(self.sizes)[:-1].astype(np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        at = bucket_of(keys, len(self.sizes))
        size, start = self.sizes[at], self.starts[at]
        level, live, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(live) and j <= self.top:
            places, who = bit_places(keys[live], j, size[live]) + start[live], np.arange(len(live))
            for p in places:
                p = p[who]
                who = who[(self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            live = live[who]
            level[live] = j
            j += 1
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return count_of(self.levels(keys))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(17)) % np.uint64(n)).astype(np.int64)


def by_bucket(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts keys bucket by bucket, and where each bucket starts in it."""
    at = at.astype(np.uint16 if n < 65536 else np.uint32)
    order = np.argsort(at, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])


def squeezed(keys: np.ndarray, n: int) -> np.ndarray:
    """One bucket's ascending keys, of n buckets, without what the bucket tells: differences (modulo 2^64), byte by byte, for the compressor."""
    x = (keys >> np.uint64(17)) // np.uint64(n) << np.uint64(17) | keys & np.uint64(0x1FFFF)
    x[1:] -= x[:-1].copy()
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)


def restored(planes: np.ndarray, n: int, bucket: int) -> np.ndarray:
    x = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    return ((x >> np.uint64(17)) * np.uint64(n) + np.uint64(bucket)) << np.uint64(17) | x & np.uint64(0x1FFFF)


def with_ends(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, each text followed by its end; how many tokens each text has."""
    return np.insert(block.hashes(), starts_of(block.counts)[1:], END), block.counts + 1


def _pairs(hashed: np.ndarray) -> np.ndarray:
    return mixed(np.concatenate([[END], hashed[:-1]]), hashed)


def _gather(n_buckets: int, flush_tokens: int = 1_200_000):
    """Per bucket: the n-grams of a part of the task and how often its training texts hold them; per part: its texts as tokens."""

    def flush(parts: list[tuple], number: int):
        hashed, lengths, train, ids = (np.concatenate(x) for x in zip(*parts))
        learns = np.repeat(train, lengths)
        seen, token = np.unique(hashed, return_inverse=True)
        single = np.bincount(token[learns], minlength=len(seen))
        pair, which = np.unique(_pairs(hashed), return_inverse=True)
        pair_n = np.bincount(which[learns], minlength=len(pair))
        o1, s1 = by_bucket(bucket_of(seen, n_buckets), n_buckets)
        o2, s2 = by_bucket(bucket_of(pair, n_buckets), n_buckets)
        out = []
        for b in range(n_buckets):
            mine, two = o1[s1[b] : s1[b + 1]], o2[s2[b] : s2[b + 1]]
            if len(mine) or len(two):
                out.append(("part", b, number, 0, 0, packed(squeezed(seen[mine], n_buckets), single[mine].astype(np.uint32), squeezed(pair[two], n_buckets), pair_n[two].astype(np.uint32))))
        # tokens go by falling frequency, so that most of their upper bytes are 0; equally frequent ones stand by key
        common = np.argsort(-np.bincount(token), kind="stable")
        rank = np.empty(len(seen), np.uint32)
        rank[common] = np.arange(len(seen), dtype=np.uint32)
        ranks = rank[token]
        out.append(("docs", number % n_buckets, number, 0, 0, packed(ids, train, lengths, squeezed(seen[common], 1), ranks.astype(np.uint8), (ranks >> 8).astype(np.uint8), (ranks >> 16).astype(np.uint16))))
        return record(out)

    def run(batches):
        parts, size = [], 0
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        for batch, block in text_blocks(batches, 1_000_000):
            hashed, lengths = with_ends(block)
            parts.append((hashed, lengths, np.array(batch.column("train").to_pylist(), bool), np.array(batch.column("doc_id").to_pylist(), object)))
            size += len(hashed)
            if size >= flush_tokens:
                yield flush(parts, number)
                parts, size, number = [], 0, number + 1
        if parts:
            yield flush(parts, number)

    return run


def record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["kind", "bucket", "flush", "n", "v", "blob"])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    all_counts = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.empty(0, np.int64)
    return all_keys[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def _count(n_buckets: int, bits_per_entry: float, probe: int = 200_000):
    """One bucket: counts of all tasks, its filter segment, and for each part the counts and levels of its n-grams."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts, out = [], []
        for kind, flush, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "flush", "blob"))):
            if kind == "docs":
                out.append(("docs", bucket, flush, 0, 0, blob))
            else:
                parts.append((flush, blob))
        counted = [unpacked(blob) for _, blob in parts]
        one, n_one = _summed([restored(p[0], n_buckets, bucket) for p in counted], [p[1] for p in counted])
        two, n_two = _summed([restored(p[2], n_buckets, bucket) for p in counted], [p[3] for p in counted])
        del counted
        entered, times = np.concatenate([one[n_one > 0], two[n_two > 0]]), np.concatenate([n_one[n_one > 0], n_two[n_two > 0]])
        segment = filter_segment(entered, times, bits_per_entry)
        grams = LogFrequencyFilter(segment.tobytes(), [len(segment)], int(level_of(times).max(initial=0)))
        del entered, times, n_two
        probed = lambda keys: np.concatenate([np.empty(0, np.uint8), *(grams.levels(keys[i : i + probe]).astype(np.uint8) for i in range(0, len(keys), probe))])
        level_one, level_two = probed(one), probed(two)
        out.append(("filter", bucket, 0, int(n_one.sum()), int((n_one > 0).sum()), None))
        for flush, blob in parts:
            keys, _, pairs, _ = unpacked(blob)
            at = np.searchsorted(one, restored(keys, n_buckets, bucket))
            out.append(("levels", bucket, flush, 0, 0, packed(n_one[at], level_one[at], level_two[np.searchsorted(two, restored(pairs, n_buckets, bucket))])))
        return pa.Table.from_batches([record(out)])

    return run


def _score(n_buckets: int, n_train: int, n_types: int, pair_weight: float):
    """The texts of one part, from the counts and levels that all buckets sent back."""

    def run(table: pa.Table) -> pa.Table:
        found, docs = {}, None
        for kind, bucket, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "blob"))):
            if kind == "docs":
                docs = unpacked(blob)
            else:
                found[bucket] = blob
        ids, train, lengths, seen, low, middle, high = docs
        seen = restored(seen, 1, 0)
        token = low.astype(np.int64) | middle.astype(np.int64) << 8 | high.astype(np.int64) << 16
        # the keys that went to a bucket went in ascending order, and so come back
        place = np.argsort(seen, kind="stable")
        pair, which = np.unique(_pairs(seen[token]), return_inverse=True)
        o1, s1 = by_bucket(bucket_of(seen[place], n_buckets), n_buckets)
        o2, s2 = by_bucket(bucket_of(pair, n_buckets), n_buckets)
        count, level, level_two = np.zeros(len(seen)), np.zeros(len(seen), np.int64), np.zeros(len(pair), np.int64)
        for b, blob in found.items():
            mine = place[o1[s1[b] : s1[b + 1]]]
            count[mine], level[mine], level_two[o2[s2[b] : s2[b + 1]]] = unpacked(blob)
        starts = starts_of(lengths)[:-1]
        total = np.add.reduceat(np.log10(count + 1.0)[token], starts)
        known = np.add.reduceat((count > 0)[token].astype(np.int64), starts)
        single = count_of(level)
        own = alone(single, n_train, n_types)[token]
        before = most_of(level)
        before = np.concatenate([before[np.flatnonzero(seen == END)], before[token[:-1]]])
        both = np.where(before > 0, count_of(level_two)[which], 0.0)
        both = np.minimum(both, np.minimum(single[token], before))
        p = after(both, before, own, pair_weight)
        score = np.add.reduceat(np.log10(np.clip(p, 1e-300, 1.0)), starts)
        return pa.table({"doc_id": pa.array(ids.tolist(), pa.int64()), "held_out": ~train, "n_tokens": lengths.astype(np.int64), "n_known": known, "log_counts": total, "score": score})

    return run


def score_documents(docs: DataFrame, held_out_remainder: int = 2, modulus: int = 7, bits_per_entry: float = 8.0, pair_weight: float = PAIR_WEIGHT, chars_per_bucket: int = 8_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id"), modulus) != held_out_remainder).alias("train"))
    n_buckets = buckets_for(texts, "text", chars_per_bucket)
    parts = texts.mapInArrow(_gather(n_buckets), GATHERED)
    spark = docs.sparkSession
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the n-grams sent to the buckets, the greatest shuffle, go before the levels are sent back
    try:
        gathered = written(parts.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_count(n_buckets, bits_per_entry), GATHERED))
    finally:
        spark.conf.set(CLEANUP, was)
    totals = gathered.where("kind = 'filter'").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, n_types = totals["n"] or 0, totals["v"] or 0
    scored = gathered.where("kind <> 'filter'").repartition(n_buckets, "flush").groupBy("flush").applyInArrow(
        _score(n_buckets, n_train, n_types, pair_weight), "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"
    )
    per_token = math.log10(n_train + n_types + 1)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score",
    )
