"""Words `[^\\x20\\x09-\\x0D]+` of whole texts as 64-bit hashes, a block of texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FIRST, SECOND, THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SPACES = (9, 10, 11, 12, 13, 32)


def _byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte: A-Z have those of a-z, and white space has 0."""
    value = np.random.default_rng(20240229).integers(1, 2**63, 256, np.int64).astype(np.uint64)
    value[65:91] = value[97:123]
    value[list(SPACES)] = 0
    return value


VALUE = _byte_values()
IS_WORD = VALUE != 0
EXACT = VALUE.copy()  # the same with A-Z as themselves
EXACT[65:91] = np.random.default_rng(20240301).integers(1, 2**63, 26, np.int64).astype(np.uint64)


def mixed(a: np.ndarray, b) -> np.ndarray:
    """A hash of the ordered pair of two 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = a * FIRST + (b ^ (b >> np.uint64(31))) * SECOND
        x ^= x >> np.uint64(33)
        x *= THIRD
        return x ^ (x >> np.uint64(29))


class Block:
    """The words of a block of texts: one hash each, A-Z taken as a-z; `offsets` are those of the texts in `data`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        is_word = IS_WORD[data]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        inside = offsets[:-1][offsets[:-1] < len(data)]
        begins[inside] = is_word[inside]
        self.start_at(np.flatnonzero(begins))

    def start_at(self, starts: np.ndarray) -> None:
        """Takes these places, which are sorted, for the starts of the words."""
        self.starts = starts
        self.counts = np.diff(np.searchsorted(starts, self.offsets))  # words of each text

    def ends(self) -> np.ndarray:
        """Where each word ends: at white space, at the next word, or where its text ends."""
        space = np.flatnonzero(~IS_WORD[self.data])
        space = np.append(space, len(self.data))[np.searchsorted(space, self.starts)] if len(self.starts) else np.empty(0, np.int64)
        following = np.append(self.starts[1:], len(self.data))[: len(self.starts)]
        return np.minimum(np.minimum(space, following), self.offsets[np.searchsorted(self.offsets, self.starts, side="right")]).astype(np.int64)

    def taken(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of these words, one after the other, and the offsets of each."""
        space = np.append(np.flatnonzero(~IS_WORD[self.data]), len(self.data))
        first = self.starts[words]
        following = np.append(self.starts, len(self.data))[words + 1]
        end = np.minimum(np.minimum(space[np.searchsorted(space, first)], following), self.offsets[np.searchsorted(self.offsets, first, side="right")])
        offsets = starts_of(end - first)
        return self.data[np.repeat(first - offsets[:-1], end - first) + np.arange(offsets[-1])], offsets

    def _sums(self, terms: np.ndarray) -> np.ndarray:
        return np.add.reduceat(terms, self.starts) if len(self.starts) else np.empty(0, terms.dtype)

    def _places(self) -> np.ndarray:
        spans = np.diff(np.concatenate([self.starts, [len(self.data)]]))
        place = np.zeros(len(self.data), np.int64)
        if len(self.starts):
            place[self.starts[0]:] = np.arange(len(self.data) - self.starts[0]) - np.repeat(self.starts - self.starts[0], spans)
        return place

    def hashes(self, prefix: int = 0, value: np.ndarray = VALUE) -> np.ndarray:
        """By word; with prefix, of its first so many bytes only; with value=EXACT, A-Z are themselves."""
        place = self._places()
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max(initial=0)), np.uint64(0xD6E8FEB86659FD93))]), dtype=np.uint64)
            terms = value[self.data] * powers[place]
            if prefix:
                terms[place >= prefix] = 0
            return mixed(self._sums(terms), np.uint64(prefix + 1))

    def sums(self, by_byte: np.ndarray) -> np.ndarray:
        """By word, the sum of by_byte[b] over its bytes."""
        return self._sums(by_byte[self.data])


def text_blocks(batches: Iterator[pa.RecordBatch], most_bytes: int = 3_000_000) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of Arrow batches whose column `text` holds about most_bytes, with their words (null text: empty)."""
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column("text").fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        group = (offsets[1:] - offsets[0]) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
        for i, j in zip(cuts, cuts[1:]):
            yield batch.slice(i, j - i), Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    pa.default_memory_pool().release_unused()  # workers live on after their task


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
