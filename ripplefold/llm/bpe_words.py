"""Encoding whole blocks of texts with a word-level BPE tokenizer: each different word of a task is encoded once.

Only for tokenizers that split at white space and never look across it, as this one's pre-tokenizer does.
"""

from __future__ import annotations

import codecs
import json
import os
from itertools import chain

import numpy as np

from ripplefold.llm.words import EXACT, Block, starts_of

DEFAULT = "word_bpe_49k.json"
BAR = ord("|")
# the bar is part of the special strings, and an apostrophe may take letters with it
IS_SIGN = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[]^_`{}~\\"))
IS_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])
IS_ALPHA = np.array([bytes([b]).isalpha() for b in range(256)])
#: The sign that stands for each byte in a vocabulary over bytes: itself where it prints, else one from U+0100 on; spaces part the words.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PRINT]
BYTE_SIGNS = "".join(" " if b == 32 else chr(b) if b in _PRINT else chr(256 + _OTHER.index(b)) for b in range(256))


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver; a fixed size, so it can be sent to all tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    refuse_others(text)
    return text


#: The steps before the merges that encoding word by word is exact for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def refuse_others(text: str) -> None:
    """Raises unless the tokenizer has this normalizer, this split at white space and signs, and no decoder."""
    found = json.loads(text)
    steps = (found.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    barred = all("|" in t["content"] for t in found.get("added_tokens") or [])
    if found.get("normalizer") != NORMALIZER or steps[0] != SPLIT or found.get("decoder") is not None or found.get("post_processor") is not None or found["model"]["type"] != "BPE" or not barred:
        raise ValueError("only for tokenizers that lower-case, split at white space and signs, and have no decoder")


def tokenizer(text: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def signs_apart(block: Block) -> Block:
    """Starts a new word at each ASCII sign after a letter or digit, where the pre-tokenizer parts them too.

    Fewer different words are left to encode. Only ASCII and Latin-1 letters count; other words stay whole.
    """
    data = block.data
    before = IS_ALNUM[data[:-1]]
    before[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)  # all of U+00C0 to U+00FF but two signs
    begins = np.zeros(len(data), bool)
    begins[1:] = before & IS_SIGN[data[1:]]
    begins[block.starts] = True
    block.start_at(np.flatnonzero(begins))
    return block


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to ASCII letters and to those of U+00C0 to U+00FF."""
    found = IS_ALPHA[data]
    pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    found[:-1] |= pair
    found[1:] |= pair
    return found


class WordCodes:
    """The ids of the words seen by a task, forgotten when there are many.

    Words of letters alone, which are most, are one piece for the pre-tokenizer, and no step before the merges does more to them than
    lower-case: they go to the merges as lines of many words, and are told apart by the mark at the end of each word's last token.
    """

    def __init__(self, text: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.codec, self.most = tokenizer(text), most
        self.merges = Tokenizer(self.codec.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.token = [self.codec.id_to_token(i).encode() for i in range(self.codec.get_vocab_size())]
        self.digits = [str(i).encode() for i in range(len(self.token))]
        suffix = (json.loads(text)["model"].get("end_of_word_suffix") or "").encode()
        self.is_last = np.array([bool(suffix) and t.endswith(suffix) for t in self.token])
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes in ascending order
        self.lengths, self.flat = np.empty(0, np.int64), np.empty(0, np.uint32)
        self.starts = starts_of(self.lengths)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids."""
        ids = [e.ids for e in self.codec.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32)

    def _by_lines(self, words: list[str], width: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters()."""
        lines = [codecs.charmap_decode(" ".join(words[i : i + width]).lower().encode(), "strict", BYTE_SIGNS)[0] for i in range(0, len(words), width)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        last = np.flatnonzero(self.is_last[flat])
        if len(last) != len(words):  # a vocabulary without the mark
            return self._one_by_one(words)
        return np.diff(last, prepend=-1), flat

    def slots(self, block: Block) -> np.ndarray:
        """For each word of the block, where its ids are kept."""
        if len(self.known) > self.most:
            self.clear()
        # the tokenizer lower-cases, so A-Z needn't be told apart, but for its special strings, which all hold a bar
        named = block.hashes()
        bars = np.flatnonzero(block.data == BAR)
        if len(bars):
            barred = np.unique(np.searchsorted(block.starts, bars, side="right") - 1)
            named[barred] = Block(*block.taken(barred)).hashes(value=EXACT)
        seen, first, inverse = np.unique(named, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, seen)
        old = np.append(self.known, np.uint64(0))[at] == seen
        old[at == len(self.known)] = False
        slots = np.full(len(seen), -1, np.int64)
        slots[old] = self.slot[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            data, bounds = block.taken(first[new])
            others = starts_of(~letters(data))[bounds]
            plain = others[1:] == others[:-1]
            content, bounds = data.tobytes(), bounds.tolist()
            words = [content[i:j].decode() for i, j in zip(bounds, bounds[1:])]
            new = np.concatenate([new[plain], new[~plain]])
            counts, ids = zip(self._by_lines([w for w, p in zip(words, plain.tolist()) if p]), self._one_by_one([w for w, p in zip(words, plain.tolist()) if not p]))
            slots[new] = np.arange(len(self.known), len(self.known) + len(new))
            new.sort()
            self.known, self.slot = np.insert(self.known, at[new], seen[new]), np.insert(self.slot, at[new], slots[new])
            self.lengths = np.concatenate([self.lengths, *counts])
            self.flat = np.concatenate([self.flat, *ids])
            self.starts = starts_of(self.lengths)
        return slots[inverse]

    def ids(self, slots: np.ndarray) -> np.ndarray:
        n = self.lengths[slots]
        total = starts_of(n)
        return self.flat[np.repeat(self.starts[slots] - total[:-1], n) + np.arange(total[-1])]
