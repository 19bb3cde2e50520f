"""Operator 7, BPE encoding and decoding with tree concatenation.

Long texts are cut into leaves of equal length, wherever that falls, and the leaves are encoded in
parallel, each in any task. The codes of two neighbouring halves are then joined, level by level up the
tree: a window around the join is encoded anew and grows until it repeats two successive
words' tokens of the left half and those of two words of the right half in place; everything between comes
from the window. Inside a leaf, as in shorter texts, each different word is encoded once per task.

Contract: ids are those of the whole text under the tokenizer (add_special_tokens=False), and decoded is
the library's decode of them. A null or empty text has no ids and decodes to an empty text. Repeated rows
give repeated results; a null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.bpe_words import WordCodes, signs_apart, vocabulary
from ripplefold.llm.common import packed, unpacked, written
from ripplefold.llm.words import Block, starts_of, text_blocks

LEAF_CHARS = 16_384
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codes:
    """The ids of data[low:high] and, word by word, the bytes that each word covers in the whole text and how many ids it has."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, low: int, high: int) -> None:
        self.ids, self.starts, self.ends, self.counts, self.low, self.high = ids, starts, ends, counts, low, high
        self.at = starts_of(counts)

    def part(self, first: int, last: int) -> tuple[np.ndarray, ...]:
        """Ids, starts, ends and counts of the words first..last-1."""
        return self.ids[self.at[first] : self.at[last]], self.starts[first:last], self.ends[first:last], self.counts[first:last]


def encoded(codes: WordCodes, data: bytes, low: int, high: int) -> Codes:
    raw = np.frombuffer(data, np.uint8)[low:high]
    block = signs_apart(Block(raw, np.array([0, len(raw)])))
    slots = codes.slots(block)
    return Codes(codes.ids(slots), block.starts + low, block.ends() + low, codes.lengths[slots], low, high)


def _agreeing(a: Codes, b: Codes, may: np.ndarray) -> list[tuple[int, int]]:
    """Words i of a (of those that may) that, with their successors, are the same words in the same places as two of b."""
    at = np.searchsorted(b.starts, a.starts)
    ok = at < len(b.starts)
    ok[ok] = (b.starts[at[ok]] == a.starts[ok]) & (b.ends[at[ok]] == a.ends[ok]) & (b.counts[at[ok]] == a.counts[ok])
    ok &= may
    out = []
    for i in np.flatnonzero(ok[:-1] & ok[1:]).tolist():
        j = int(at[i])
        if at[i + 1] == j + 1 and np.array_equal(a.ids[a.at[i] : a.at[i + 2]], b.ids[b.at[j] : b.at[j + 2]]):
            out.append((i, j))
    return out


def _character(data: bytes, at: int, step: int) -> int:
    """The nearest start of a character from `at` on, going by step."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def joined(codes: WordCodes, data: bytes, left: Codes, right: Codes, window: int = 64) -> Codes:
    """The codes of data[left.low:right.high]. Words at a border of the window or at the cut may be cut short and don't count."""
    cut = left.high
    while True:
        low, high = _character(data, max(left.low, cut - window), -1), _character(data, min(right.high, cut + window), 1)
        mid = encoded(codes, data, low, high)
        keep_left, from_mid, to_mid, keep_right, done = 0, 0, len(mid.counts), len(right.counts), True
        if low > left.low and len(mid.counts):
            found = _agreeing(mid, left, (mid.starts > low + 1) & (mid.ends < cut))
            done = bool(found)
            if done:
                from_mid, keep_left = found[0]
        elif low > left.low:
            done = False
        if done and high < right.high:
            found = _agreeing(mid, right, (mid.starts > cut + 1) & (mid.ends < high)) if len(mid.counts) else []
            done = bool(found) and found[-1][0] >= from_mid
            if done:
                to_mid, keep_right = found[-1]
        if done:
            pieces = [left.part(0, keep_left), mid.part(from_mid, to_mid), right.part(keep_right, len(right.counts))]
            return Codes(*(np.concatenate(x) for x in zip(*pieces)), left.low, right.high)
        window *= 2


def tree(codes: WordCodes, data: bytes, parts: list[Codes]) -> Codes:
    """Neighbours are joined two by two until one is left."""
    while len(parts) > 1:
        parts = [joined(codes, data, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def digests(codes: WordCodes, ids: np.ndarray) -> tuple[int, str, str]:
    """How many ids, and the hashes of their numbers and of what they decode to (their strings between spaces, as there is no decoder)."""
    ids = ids.tolist()
    numbers, strings = b" ".join(map(codes.digits.__getitem__, ids)), b" ".join(map(codes.token.__getitem__, ids))
    return len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(strings).hexdigest()


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _short(sent):
    def run(batches):
        codes = WordCodes(sent.value)
        for batch, block in text_blocks(batches):
            slots = codes.slots(signs_apart(block))
            ids = codes.ids(slots)
            at = starts_of(codes.lengths[slots])[starts_of(block.counts)] if len(slots) else np.zeros(len(batch) + 1, np.int64)
            yield _result([(doc_id, *digests(codes, ids[at[i] : at[i + 1]])) for i, doc_id in enumerate(batch.column("doc_id").to_pylist())])

    return run


def _leaves(sent):
    def run(batches):
        codes = WordCodes(sent.value)
        for batch in batches:
            blobs = []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                own = encoded(codes, data, 0, len(data))
                blobs.append(packed(np.frombuffer(data, np.uint8), own.ids.astype(np.uint32), own.starts.astype(np.uint32), (own.ends - own.starts).astype(np.uint32), own.counts.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("low"), pa.array(blobs, pa.binary())], ["doc_id", "row", "low", "blob"])

    return run


def _trees(sent):
    made = []  # one table of codes for all groups of a task

    def run(table: pa.Table) -> pa.Table:
        if not made:
            made.append(WordCodes(sent.value))
        codes, parts, base, texts = made[0], [], 0, []
        for leaf in sorted(table.select(["low", "blob"]).to_pylist(), key=lambda x: x["low"]):
            data, ids, starts, lengths, counts = unpacked(leaf["blob"])
            starts = starts.astype(np.int64) + base
            parts.append(Codes(ids, starts, starts + lengths, counts.astype(np.int64), base, base + len(data)))
            texts.append(data.tobytes())
            base += len(data)
        ids = tree(codes, b"".join(texts), parts).ids
        return pa.Table.from_batches([_result([(table.column("doc_id")[0].as_py(), *digests(codes, ids))])])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    texts = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    short = texts.where(~is_long).mapInArrow(_short(sent), RESULT)
    rows = written(texts.where(is_long).withColumn("row", F.monotonically_increasing_id()))
    low = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(leaf_chars))).alias("low")
    leaves = rows.select("doc_id", "row", low, "text").withColumn("text", F.substring(F.col("text"), F.col("low") + 1, F.lit(leaf_chars)))
    n = max(8, rows.sparkSession.sparkContext.defaultParallelism * 2)
    coded = leaves.withColumn("low", F.col("low").cast("long")).repartition(n, "row", "low").mapInArrow(_leaves(sent), "doc_id long, row long, low long, blob binary")
    return short.unionByName(coded.groupBy("row").applyInArrow(_trees(sent), RESULT))
