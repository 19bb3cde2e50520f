"""Operator 9, hierarchical multi-length packing.

Documents are routed to tiers of context lengths. A document's whole longest windows stand alone; what is
left goes to the smallest tier that holds it. Each tier's sequences start from a document of that tier and
fill the gap from the shorter tiers, whole documents first and then a cut one; only when nothing shorter
is left does a tier cut its own. The last remains of a task become sequences of power-of-two lengths.
Every sequence belongs to a step group, and groups of a task get about the same number of tokens.

Contract: each id of each document lies in exactly one piece; sequences are gapless, at most `longest`
long, and of a tier's or another power-of-two length, so that none needs padding. A null or empty text
has one id, the end. Repeated rows are packed again; a null doc_id is kept; other columns are ignored; an
empty table gives no rows. sequence_id is unique over all tasks.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ripplefold.llm.bpe_words import WordCodes, signs_apart, vocabulary
from ripplefold.llm.words import starts_of, text_blocks

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16_384
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def packed_sequences(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), given the documents' lengths."""
    longest = tiers[-1]
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
    out = []

    def route(piece: tuple[int, int, int]) -> None:
        waiting[next(i for i, t in enumerate(tiers) if piece[2] <= t)].append(piece)

    for doc, n in enumerate(lengths):
        whole = n // longest * longest
        out += [[(doc, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            route((doc, whole, n - whole))
    for w in waiting:  # the longest first within a tier, so that gaps stay small
        w.sort(key=lambda x: (x[2], x[0]))
    for tier in range(len(tiers) - 1, -1, -1):
        while waiting[tier]:
            first = waiting[tier].pop()
            sequence, gap = [first], tiers[tier] - first[2]
            while gap:
                below = next((waiting[i] for i in range(tier, -1, -1) if waiting[i] and (i < tier and waiting[i][0][2] <= gap)), None)
                if below is not None:  # the longest of that tier that fits
                    low, high = 0, len(below)
                    while high - low > 1:
                        mid = (low + high) // 2
                        low, high = (mid, high) if below[mid][2] <= gap else (low, mid)
                    piece = below.pop(low)
                else:
                    source = next((waiting[i] for i in range(tier + 1) if waiting[i]), None)
                    if source is None:
                        break
                    doc, start, n = source.pop()
                    piece = (doc, start, min(n, gap))
                    if n > gap:
                        route_back = (doc, start + gap, n - gap)
                        at = next(i for i, t in enumerate(tiers) if route_back[2] <= t)
                        keys = waiting[at]
                        low, high = 0, len(keys)
                        while low < high:
                            mid = (low + high) // 2
                            low, high = (mid + 1, high) if keys[mid][2] < route_back[2] else (low, mid)
                        keys.insert(low, route_back)
                sequence.append(piece)
                gap -= piece[2]
            if not gap:
                out.append(sequence)
                continue
            # nothing is left to fill with: power-of-two sequences
            rest = sum(x[2] for x in sequence)
            while rest:
                size = 1 << (rest.bit_length() - 1)
                part, need = [], size
                while need:
                    doc, start, n = sequence.pop(0)
                    part.append((doc, start, min(n, need)))
                    if n > need:
                        sequence.insert(0, (doc, start + need, n - need))
                    need -= part[-1][2]
                out.append(part)
                rest -= size
    return out


def step_groups(sizes: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence; the largest go first, each to the group with the fewest tokens."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // tokens)))]
    group = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        group[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return group


def _pack(sent, tiers: tuple[int, ...], end_id: int, flush_tokens: int = 4_000_000):
    def flush(ids_of: list[np.ndarray], names: list, first: int, group0: int):
        lengths = [len(x) for x in ids_of]
        sequences = packed_sequences(lengths, tiers)
        sizes = [sum(x[2] for x in s) for s in sequences]
        groups = step_groups(sizes)
        columns: list[list] = [[] for _ in range(9)]
        for number, (sequence, size, group) in enumerate(zip(sequences, sizes, groups)):
            offset = 0
            for doc, start, n in sequence:
                row = (names[doc], start, n, zlib.crc32(ids_of[doc][start : start + n].tobytes()), lengths[doc], first + number, offset, size, group0 + group)
                for c, x in zip(columns, row):
                    c.append(x)
                offset += n
        fields = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], fields), len(sequences), max(groups, default=-1) + 1

    def run(batches):
        codes = WordCodes(sent.value)
        first = group0 = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        ids_of, names, size = [], [], 0
        for batch, block in text_blocks(batches):
            slots = codes.slots(signs_apart(block))
            ids, lengths = codes.ids(slots), codes.lengths[slots]
            at = starts_of(lengths)[starts_of(block.counts)] if len(slots) else np.zeros(len(batch) + 1, np.int64)
            for i, name in enumerate(batch.column("doc_id").to_pylist()):
                ids_of.append(np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4"))
                names.append(name)
            size += int(at[-1]) + len(batch)
            if size >= flush_tokens:
                out, n, g = flush(ids_of, names, first, group0)
                yield out
                first, group0, ids_of, names, size = first + n, group0 + g, [], [], 0
        if names:
            yield flush(ids_of, names, first, group0)[0]

    return run


def pack_documents(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group for every piece."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    return docs.select("doc_id", "text").mapInArrow(_pack(sent, tiers, end_id), PIECES)
