"""Values over patterns, by register automata whose summaries compose over chunks.

An expression says how a stream is cut up and which numbers are folded: a leaf is a pattern with a constant or
with the fold of its packets' weights; `iterate` folds over successive pieces, `split` over two parts, `either` takes
one of two. Every iterate, split and weighted leaf that is open holds one number, its level. Reading a packet moves between states
and opens, folds into and closes levels.

What any chunk of a stream does is known from its packets alone: for each state before and after it, how many of
the open levels stay open, what is folded into each, and what the newly opened ones hold. Two such summaries
compose to one of the same size. So a stream of one key may be cut anywhere: chunks are summed up where they lie, and
a key's summaries are composed in order.

Several readings of one stream give bounds: summaries that meet in a state merge number by number to the least and the
greatest. A merged bound holds for every reading, and is reached by one where readings differ in one level only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa

from ripplefold.operators.patterns import Pattern, automaton

#: What a fold over nothing gives.
START = {"sum": 0, "max": 0, "min": 1 << 20}
FAR = 1 << 62
NEUTRAL = {"sum": 0, "max": -FAR, "min": FAR}
FOLD = {"sum": np.add, "max": np.maximum, "min": np.minimum}
ROOT = "sum"  # the outermost level takes one number, the value


@dataclass(frozen=True)
class Value:
    """kind is leaf, iterate, split or either; a leaf has a pattern's table, and a constant or the fold of weights."""

    kind: str
    fold: str = ""
    parts: tuple = ()
    constant: int | None = None
    table: tuple = ()
    accepting: tuple = ()


def from_table(table: list[list[int]], accepting: list[bool], constant: int | None = None, fold: str = "") -> Value:
    return Value("leaf", fold, (), constant, tuple(map(tuple, table)), tuple(accepting))


def when(pattern: Pattern, symbols: str, constant: int = 1) -> Value:
    """The constant, if the packets match."""
    return from_table(*automaton(pattern, symbols), constant=constant)


def total(pattern: Pattern, symbols: str, fold: str = "sum") -> Value:
    """The fold of the packets' weights, if the packets match."""
    return from_table(*automaton(pattern, symbols), fold=fold)


def iterate(piece: Value, fold: str) -> Value:
    """The fold over successive pieces, none of them empty; no piece gives the start value."""
    return Value("iterate", fold, (piece,))


def split(first: Value, second: Value, fold: str) -> Value:
    return Value("split", fold, (first, second))


def either(*parts: Value) -> Value:
    return Value("either", "", parts)


def folded(fold: str, *numbers: int) -> int:
    return {"sum": sum, "max": max, "min": min}[fold](numbers)


def of_nothing(v: Value) -> list[int]:
    """The values that an empty stream can have."""
    if v.kind == "leaf":
        return ([v.constant] if v.constant is not None else [START[v.fold]]) if v.accepting[0] else []
    if v.kind == "iterate":
        return [START[v.fold]]
    if v.kind == "split":
        return [folded(v.fold, START[v.fold], a, b) for a in of_nothing(v.parts[0]) for b in of_nothing(v.parts[1])]
    return [x for part in v.parts for x in of_nothing(part)]


@dataclass
class Move:
    """What happens to the open levels: the first `kept` stay; `into[i]` is folded into level i, closed ones are folded into those
    below them, and `opened` are those that come on top."""

    height: int
    folds: list[str]
    kept: int
    into: list[int]
    opened: list[int] = field(default_factory=list)

    @staticmethod
    def none(folds: list[str]) -> Move:
        return Move(len(folds), list(folds), len(folds), [NEUTRAL[f] for f in folds])

    def open(self, fold: str) -> None:
        self.folds.append(fold)
        self.opened.append(START[fold])

    def take(self, number: int) -> None:
        fold = self.folds[-1]
        held = self.opened if self.opened else self.into
        at = -1 if self.opened else self.kept - 1
        held[at] = folded(fold, held[at], number)

    def close(self) -> None:
        self.folds.pop()
        if self.opened:
            self.take(self.opened.pop())
        else:
            self.kept -= 1

    def copy(self) -> Move:
        return Move(self.height, list(self.folds), self.kept, list(self.into), list(self.opened))


class Machine:
    """The states of an expression, what each symbol does in each, and how each ends. A state is a leaf with a state of its pattern;
    the last state is the start."""

    def __init__(self, value: Value, n_symbols: int) -> None:
        self.value, self.n_symbols = value, n_symbols
        self.leaves: list[tuple[Value, tuple]] = []
        self._find(value, ())
        live = [self._live(leaf) for leaf, _ in self.leaves]
        names = [(k, q) for k, alive in enumerate(live) for q in sorted(alive)]
        number = {name: i for i, name in enumerate(names)}
        self.start = len(names)
        self.folds = [self._folds(k) for k, _ in names] + [[]]
        self.depth = max(map(len, self.folds))
        self.moves: list[list[tuple[int, int, Move, bool]]] = [[] for _ in range(n_symbols)]  # (from, to, move, takes the weight)
        self.ends: list[tuple[int, Move]] = []

        def reads(source: int, move: Move, k: int, q: int) -> None:
            leaf = self.leaves[k][0]
            for c in range(n_symbols):
                if (k, leaf.table[q][c]) in number:
                    self.moves[c].append((source, number[k, leaf.table[q][c]], move, bool(leaf.fold)))

        for i, (k, q) in enumerate(names):
            leaf, path = self.leaves[k]
            reads(i, Move.none(self.folds[i]), k, q)
            if leaf.accepting[q]:
                done = Move.none(self.folds[i])
                done.close() if leaf.fold else done.take(leaf.constant)
                for move, to in self._after(path, done):
                    if to is None:
                        self.ends.append((i, move))
                    else:
                        reads(i, move, to, 0)
        first = Move.none([])
        first.open(ROOT)
        for move, to in self._enter(value, (), first):
            reads(self.start, move, to, 0)
        self._lay_out()

    def _lay_out(self) -> None:
        """The readings that any chunk can have (state before, state after, levels kept), by state before with the start last, and each
        one's places among the numbers of a summary: those folded into the levels before, then those that the opened levels hold."""
        after: list[dict[int, set]] = [{} for _ in range(self.start + 1)]  # by source: the states read into and the levels that a move keeps
        for moves in self.moves:
            for source, to, move, _ in moves:
                after[source].setdefault(to, set()).add(move.kept)
        found = todo = {(b, b, len(folds)) for b, folds in enumerate(self.folds)}
        while todo := {(b, to, min(kept, k)) for b, source, kept in todo for to, keeps in after[source].items() for k in keeps} - found:
            found = found | todo
        self.readings = sorted(found)
        self.number = {r: i for i, r in enumerate(self.readings)}
        self.into: list[list[int]] = []
        self.opened: list[dict[int, int]] = []
        self.width = 0
        for before, to, kept in self.readings:
            self.into.append(list(range(self.width, self.width + len(self.folds[before]))))
            self.width += len(self.folds[before])
            self.opened.append({level: self.width + i for i, level in enumerate(range(kept, len(self.folds[to])))})
            self.width += len(self.opened[-1])
        self.from_start = next(i for i, (before, _, _) in enumerate(self.readings) if before == self.start)
        self.cut = self.into[self.from_start][0] if self.into[self.from_start] else self.width - sum(len(x) for x in self.opened[self.from_start :])
        self.after_state = [[i for i, (_, to, _) in enumerate(self.readings) if to == state] for state in range(self.start + 1)]
        self.before_state = [[i for i, (before, _, _) in enumerate(self.readings) if before == state] for state in range(self.start + 1)]

    def _find(self, v: Value, path: tuple) -> None:
        if v.kind == "leaf":
            self.leaves.append((v, path))
        for i, part in enumerate(v.parts):
            self._find(part, (*path, (v, i)))

    def _live(self, leaf: Value) -> set[int]:
        """The states of a leaf's pattern from which it can still match."""
        live = {q for q, ok in enumerate(leaf.accepting) if ok}
        while grown := {q for q, row in enumerate(leaf.table) if q not in live and live & set(row)}:
            live |= grown
        return live

    def _folds(self, k: int) -> list[str]:
        leaf, path = self.leaves[k]
        return [ROOT, *(v.fold for v, _ in path if v.fold), *([leaf.fold] if leaf.fold else [])]

    def _enter(self, v: Value, path: tuple, move: Move):
        """Every leaf that the first packet of v may belong to."""
        move = move.copy()
        if v.fold:
            move.open(v.fold)
        if v.kind == "leaf":
            yield move, next(k for k, (_, p) in enumerate(self.leaves) if p == path and self.leaves[k][0] == v)
        elif v.kind == "split":
            yield from self._enter(v.parts[0], (*path, (v, 0)), move)
            for number in of_nothing(v.parts[0]):
                skipped = move.copy()
                skipped.take(number)
                yield from self._enter(v.parts[1], (*path, (v, 1)), skipped)
        else:
            for i, part in enumerate(v.parts):
                yield from self._enter(part, (*path, (v, i)), move)

    def _after(self, path: tuple, move: Move):
        """What may follow once the part at the end of path is complete and its number is taken: a leaf, or None for the end."""
        if not path:
            yield move, None
            return
        *above, (v, i) = path
        above = tuple(above)
        if v.kind == "iterate":
            yield from self._enter(v.parts[0], path, move)
        closed = move.copy()
        if v.kind == "split" and i == 0:
            yield from self._enter(v.parts[1], (*above, (v, 1)), move)
            for number in of_nothing(v.parts[1]):
                closed = move.copy()
                closed.take(number)
                closed.close()
                yield from self._after(above, closed)
            return
        if v.fold:
            closed.close()
        yield from self._after(above, closed)


def _alike(m: Machine, some: np.ndarray, start: np.ndarray, two: np.ndarray):
    """Chunks whose summaries hold the same places: those chunks, the places, and whether least and greatest differ."""
    kind = some + 2 * start.astype(np.int8) + 4 * two
    for k in np.unique(kind).tolist():
        yield np.flatnonzero(kind == k), slice(0 if k & 1 else m.cut, m.width if k & 2 else m.cut), k >> 2


@cache
def machine(value: Value, n_symbols: int) -> Machine:
    return Machine(value, n_symbols)


class Summary:
    """Of several chunks at once, for each reading that a chunk of this machine can have: whether the chunk has it, and its numbers, each as
    least and greatest. The readings of a state that wasn't asked for are not there."""

    def __init__(self, there: np.ndarray, numbers: np.ndarray) -> None:
        self.there, self.numbers = there, numbers  # (reading, chunk), (place, bound, chunk)

    def __len__(self) -> int:
        return self.there.shape[1]

    @staticmethod
    def empty(m: Machine, chunks: int) -> Summary:
        return Summary(np.zeros((len(m.readings), chunks), bool), np.zeros((m.width, 2, chunks), np.int64))

    @staticmethod
    def unread(m: Machine, chunks: int, states: list[int]) -> Summary:
        """Before any packet: in each of these states with all its levels kept."""
        out = Summary.empty(m, chunks)
        for b in states:
            r = m.number[b, b, len(m.folds[b])]
            out.there[r] = True
            for level, fold in enumerate(m.folds[b]):
                out.numbers[m.into[r][level]] = NEUTRAL[fold]
        return out

    def __getitem__(self, chunks) -> Summary:
        return Summary(self.there[:, chunks], self.numbers[..., chunks])

    def __setitem__(self, chunks, other: Summary) -> None:
        self.there[:, chunks], self.numbers[..., chunks] = other.there, other.numbers

    def copy(self) -> Summary:
        return Summary(self.there.copy(), self.numbers.copy())

    def only(self, m: Machine, start: bool) -> Summary:
        """The readings from the start, or those from all other states."""
        there = self.there.copy()
        there[slice(None, m.from_start) if start else slice(m.from_start, None)] = False
        return Summary(there, self.numbers)

    @staticmethod
    def of(parts: list[Summary]) -> Summary:
        """The chunks of all parts, one part after the other."""
        return Summary(np.concatenate([p.there for p in parts], 1), np.concatenate([p.numbers for p in parts], 2))

    def packed(self, m: Machine) -> pa.Array:
        """A binary for each chunk: which readings are there, as bytes, then the least numbers of those from other states, if any, and of those
        from the start, if any; then the greatest, if they differ."""
        n = len(self)
        there = np.empty((m.width, n), bool)
        for r, here in enumerate(self.there):
            there[[*m.into[r], *m.opened[r].values()]] = here
        low, high = np.where(there, self.numbers[:, 0], 0), np.where(there, self.numbers[:, 1], 0)
        some, start, two = self.there[: m.from_start].any(0), self.there[m.from_start :].any(0), (low != high).any(0)
        ends = np.concatenate([[0], np.cumsum(len(m.readings) + 8 * (np.where(some, m.cut, 0) + np.where(start, m.width - m.cut, 0)) * (1 + two))])
        out = np.empty(int(ends[-1]), np.uint8)
        for mine, places, both in _alike(m, some, start, two):
            bounds = [np.ascontiguousarray(x[places, mine].T).view(np.uint8) for x in ((low, high) if both else (low,))] if places.stop > places.start else []
            rows = np.concatenate([np.ascontiguousarray(self.there[:, mine].T).view(np.uint8), *bounds], 1)
            out[ends[mine][:, None] + np.arange(rows.shape[1])] = rows
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])

    @staticmethod
    def unpacked(m: Machine, blobs: pa.Array) -> Summary:
        """Of packed()."""
        n, k = len(blobs), len(m.readings)
        out = Summary.empty(m, n)
        if not n:
            return out
        ends, held = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + n + 1].astype(np.int64), np.frombuffer(blobs.buffers()[2], np.uint8)
        out.there[:] = held[ends[:-1, None] + np.arange(k)].T.astype(bool)
        some, start = out.there[: m.from_start].any(0), out.there[m.from_start :].any(0)
        two = np.diff(ends) > k + 8 * (np.where(some, m.cut, 0) + np.where(start, m.width - m.cut, 0))
        for mine, places, both in _alike(m, some, start, two):
            width = places.stop - places.start
            numbers = held[ends[mine][:, None] + np.arange(k, k + 8 * width * (1 + both))].view(np.int64) if width else np.zeros((len(mine), 0), np.int64)
            whole = np.zeros((m.width, 2, len(mine)), np.int64)
            whole[places] = numbers.reshape(len(mine), 1 + both, width).transpose(2, 1, 0)
            out.numbers[..., mine] = whole
        return out

    def merge(self, m: Machine, r: int, there: np.ndarray, into: list, opened: dict) -> None:
        """Adds a reading's numbers, levels before in order and opened ones by level; `there` says which chunks have it."""
        old = self.there[r]
        places = [*zip(m.into[r], into), *((m.opened[r][level], new) for level, new in opened.items())]
        if not old.any():
            for place, new in places:
                self.numbers[place] = new
            old |= there
            return
        both = old & there
        if both.any():
            for place, new in places:
                now = self.numbers[place]
                met = np.stack([np.minimum(now[0], new[0]), np.maximum(now[1], new[1])])
                self.numbers[place] = np.where(both, met, np.where(there, new, now))
        else:
            for place, new in places:
                np.copyto(self.numbers[place], new, where=there)
        old |= there


def joined(m: Machine, r1: int, r2: int, a: np.ndarray, b: np.ndarray) -> tuple[list, dict]:
    """The numbers of reading r1 of a followed by reading r2 of b: folded into the levels before, and those of opened ones."""
    kept1, kept2 = m.readings[r1][2], m.readings[r2][2]
    folds = m.folds[m.readings[r2][0]]
    into, opened = [a[p] for p in m.into[r1]], {level: b[p] for level, p in m.opened[r2].items()}
    closing = None  # what the levels closed by the second move give to the one below
    for level in range(len(folds) - 1, -1, -1):
        own = FOLD[folds[level]]
        now = own(into[level] if level < kept1 else a[m.opened[r1][level]], b[m.into[r2][level]])
        if closing is not None:
            now, closing = own(now, closing), None
        if level < kept1:
            into[level] = now
        elif level < kept2:
            opened[level] = now
        else:  # opened by the first move, closed by the second
            closing = now
    kept = min(kept1, kept2)
    return into, {level: x for level, x in opened.items() if level >= kept}


def _moved(m: Machine, r: int, numbers: np.ndarray, move: Move) -> tuple[int, list, dict]:
    """The same where the second is one state's move, which closes the last levels and folds at most one number into the last that stays."""
    _, source, kept1 = m.readings[r]
    folds = m.folds[source]
    into, opened, closing = [numbers[p] for p in m.into[r]], {level: numbers[p] for level, p in m.opened[r].items()}, None
    for level in range(len(folds) - 1, max(move.kept - 2, -1), -1):
        own, held = FOLD[folds[level]], into if level < kept1 else opened
        now = held[level]
        if move.into[level] != NEUTRAL[folds[level]]:
            now = own(now, move.into[level])
        if closing is not None:
            now, closing = own(now, closing), None
        if level >= max(kept1, move.kept):
            closing = now
        else:
            held[level] = now
    opened = {level: x for level, x in opened.items() if level < move.kept}
    for i, number in enumerate(move.opened):
        opened[move.kept + i] = np.full_like(numbers[0], number)
    return min(kept1, move.kept), into, opened


def read(m: Machine, now: Summary, may_be: np.ndarray, weight: np.ndarray) -> Summary:
    """One packet more in each chunk: may_be has a bit for each symbol that the packet can be."""
    masks = np.unique(may_be).tolist()
    if len(masks) != 1:
        out = Summary.empty(m, len(may_be))
        for mask in masks:
            mine = np.flatnonzero(may_be == mask)
            out[mine] = read(m, now[mine], may_be[mine], weight[mine])
        return out
    out = Summary.empty(m, len(may_be))
    some = now.there.any(1)
    for source, to, move, weighs in (x for c in range(m.n_symbols) if masks[0] >> c & 1 for x in m.moves[c]):
        for r in m.after_state[source]:
            if not some[r]:
                continue
            kept, into, opened = _moved(m, r, now.numbers, move)
            if weighs:
                level = len(m.folds[to]) - 1
                held = into if level < kept else opened
                held[level] = FOLD[m.folds[to][level]](held[level], weight)
            out.merge(m, m.number[m.readings[r][0], to, kept], now.there[r], into, opened)
    return out


def composed(m: Machine, a: Summary, b: Summary) -> Summary:
    """Chunk i of a, then chunk i of b, which has summaries from every state that a may end in."""
    out = Summary.empty(m, len(a))
    some_a, some_b = a.there.any(1), b.there.any(1)
    for state in range(m.start + 1):
        for r1 in m.after_state[state]:
            for r2 in m.before_state[state] if some_a[r1] else ():
                if not some_b[r2]:
                    continue
                there = a.there[r1] & b.there[r2]
                if there.any():
                    (before, _, kept1), (_, to, kept2) = m.readings[r1], m.readings[r2]
                    out.merge(m, m.number[before, to, min(kept1, kept2)], there, *joined(m, r1, r2, a.numbers, b.numbers))
    return out


def values(m: Machine, whole: Summary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks that are whole streams: whether any reading matches, and the least and greatest value."""
    n = len(whole)
    there, low, high = np.zeros(n, bool), np.full(n, FAR), np.full(n, -FAR)
    for state, move in m.ends:
        r = m.number.get((m.start, state, 0))
        if r is None:
            continue
        ok, found = whole.there[r], _moved(m, r, whole.numbers, move)[2][0]
        low, high = np.where(ok, np.minimum(low, found[0]), low), np.where(ok, np.maximum(high, found[1]), high)
        there |= ok
    return there, low, high
