"""Ordered patterns over keyed streams: match, count and fold, with two equivalent evaluators.

A packet becomes one symbol by the first predicate that holds. The evaluators are the string form (symbols
joined in order and matched by a regular expression) and the fold form (an automaton's table looked up
packet by packet). Both hold a key's packets in one row; the forms of the module `chunks` don't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A regular pattern over symbols; kind is one, any, none, seq, alt, star or empty."""

    kind: str
    parts: tuple = ()

    def __add__(self, other: Pattern) -> Pattern:
        return seq(self, other)

    def __or__(self, other: Pattern) -> Pattern:
        return alt(self, other)


EMPTY, FAIL = Pattern("empty"), Pattern("fail")


def one(symbol: str) -> Pattern:
    return Pattern("one", (symbol,))


def anyone() -> Pattern:
    return Pattern("any")


def but(symbol: str) -> Pattern:
    return Pattern("but", (symbol,))


def seq(*parts: Pattern) -> Pattern:
    kept = [p for p in parts if p != EMPTY]
    if FAIL in kept:
        return FAIL
    return Pattern("seq", tuple(kept)) if len(kept) > 1 else (kept[0] if kept else EMPTY)


def alt(*parts: Pattern) -> Pattern:
    flat = []
    for p in parts:
        flat += p.parts if p.kind == "alt" else [p]
    kept = tuple(dict.fromkeys(p for p in flat if p != FAIL))
    return Pattern("alt", kept) if len(kept) > 1 else (kept[0] if kept else FAIL)


def star(part: Pattern) -> Pattern:
    return part if part.kind == "star" else Pattern("star", (part,))


def contains(*parts: Pattern) -> Pattern:
    return seq(star(anyone()), *parts, star(anyone()))


def regex(p: Pattern) -> str:
    if p.kind == "one":
        return p.parts[0]
    if p.kind == "but":
        return f"[^{p.parts[0]}]"
    if p.kind == "any":
        return "."
    if p.kind == "seq":
        return "".join(regex(x) for x in p.parts)
    if p.kind == "alt":
        return "(?:" + "|".join(regex(x) for x in p.parts) + ")"
    if p.kind == "star":
        return f"(?:{regex(p.parts[0])})*"
    return ""


def accepts_nothing(p: Pattern) -> bool:
    """Whether the empty stream matches."""
    if p.kind == "seq":
        return all(map(accepts_nothing, p.parts))
    if p.kind == "alt":
        return any(map(accepts_nothing, p.parts))
    return p.kind in ("empty", "star")


def after(p: Pattern, symbol: str) -> Pattern:
    """What has to follow once `symbol` was seen."""
    if p.kind == "one":
        return EMPTY if p.parts[0] == symbol else FAIL
    if p.kind == "but":
        return FAIL if p.parts[0] == symbol else EMPTY
    if p.kind == "any":
        return EMPTY
    if p.kind == "seq":
        head, rest = p.parts[0], seq(*p.parts[1:])
        first = seq(after(head, symbol), rest)
        return alt(first, after(rest, symbol)) if accepts_nothing(head) else first
    if p.kind == "alt":
        return alt(*(after(x, symbol) for x in p.parts))
    if p.kind == "star":
        return seq(after(p.parts[0], symbol), p)
    return FAIL


def automaton(p: Pattern, symbols: str) -> tuple[list[list[int]], list[bool]]:
    """By state, the next state for each symbol; which states accept. State 0 is the start."""
    states, table, at = [p], [], 0
    while at < len(states):
        row = []
        for s in symbols:
            nxt = after(states[at], s)
            if nxt not in states:
                states.append(nxt)
            row.append(states.index(nxt))
        table.append(row)
        at += 1
    return table, [accepts_nothing(s) for s in states]


def symbol(cases: dict[str, Column], other: str = "o") -> Column:
    """One character per packet: that of the first predicate that holds."""
    found = F.lit(other)
    for name, predicate in reversed(cases.items()):
        found = F.when(predicate, name).otherwise(found)
    return found


def encoded(df: DataFrame, keys: list[str], order: list[str], sym: Column) -> DataFrame:
    """One row per key with its symbols in order."""
    by = ", ".join(order)
    return df.select(*keys, *order, sym.alias("_sym")).groupBy(*keys).agg(F.expr(f"listagg(_sym, '') within group (order by {by})").alias("symbols"))


def match(df: DataFrame, keys: list[str], order: list[str], sym: Column, pattern: Pattern) -> DataFrame:
    """keys, matched: whether the whole stream of a key matches."""
    return encoded(df, keys, order, sym).select(*keys, F.col("symbols").rlike(f"^(?:{regex(pattern)})$").alias("matched"))


def count_matches(df: DataFrame, keys: list[str], order: list[str], sym: Column, pattern: Pattern, name: str = "n") -> DataFrame:
    """keys, n: how many successive pieces match, leftmost and without overlap."""
    return encoded(df, keys, order, sym).select(*keys, F.regexp_count("symbols", F.lit(regex(pattern))).cast("long").alias(name))


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Column, step, finish=None, name: str = "result") -> DataFrame:
    """A user's fold over each key's packets in order: step(accumulator, packet) from start, then finish."""
    packet = F.struct(*order, *columns)
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(packet)).alias("_rows"))
    return rows.select(*keys, (F.aggregate("_rows", start, step, finish) if finish else F.aggregate("_rows", start, step)).alias(name))


def match_by_fold(df: DataFrame, keys: list[str], order: list[str], sym: Column, pattern: Pattern, symbols: str) -> DataFrame:
    table, accepting = automaton(pattern, symbols)
    flat = F.array(*(F.lit(x) for row in table for x in row))
    coded = df.withColumn("_code", code_of(sym, symbols))
    out = fold(coded, keys, order, ["_code"], F.lit(0), lambda state, p: F.get(flat, state * len(symbols) + p["_code"]), name="_state")
    return out.select(*keys, F.get(F.array(*(F.lit(a) for a in accepting)), F.col("_state")).alias("matched"))


def code_of(sym: Column, symbols: str) -> Column:
    out = F.lit(0)
    for i, s in enumerate(symbols):
        out = F.when(sym == s, i).otherwise(out)
    return out
