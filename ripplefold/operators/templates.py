"""Candidates of several parts over labelled traces: which slices of which fields, in which shape, tell the two classes apart.

A shape is a value over patterns with one or two predicates in it, and an atom is a predicate: a field's value lies in a dyadic
slice of that field's values. All shapes with all atoms are a flat table of candidates. Those that can't be accurate enough by
the bounds of their results are dropped before any pattern is read; the others are scored, get a threshold each, and are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefold.operators import scoring as L
from ripplefold.operators.chunks import pattern_values
from ripplefold.operators.patterns import alt, one, seq, star
from ripplefold.operators.registers import Value, iterate, split, when
from ripplefold.sources.stored import stored

KEYS = ["label", "trace_id"]
SYMBOLS = "opqb"  # a packet that is neither, the first, the second, both
_ANY = star(alt(*(one(c) for c in SYMBOLS)))
_P, _Q = alt(one("p"), one("b")), alt(one("q"), one("b"))
_REST = when(_ANY, SYMBOLS, 0)


@dataclass(frozen=True)
class Shape:
    """value: over SYMBOLS, None for the plain count; atoms: how many predicates; others: whether packets that are neither matter;
    of_none: the value of a trace without either (None: undefined); the rest are the parts that complexity() counts, without the atoms'."""

    value: Value | None
    atoms: int
    others: bool
    of_none: int | None
    terms: int
    joins: int
    wildcards: int
    favoured: int


def _count(pattern) -> Value:
    return iterate(when(pattern, SYMBOLS), "sum")


#: count: packets that are p. ends: the same, where the last packet is p. burst: the longest run of p. pairs: the most pieces that go
#: from a p to a later q. after: packets that are q after the first p. Each is the greatest value over all ways to cut the trace.
SHAPES = {
    "count": Shape(None, 1, False, 0, 6, 6, 2, 3),
    "ends": Shape(_count(seq(_ANY, _P)), 1, True, None, 3, 3, 1, 2),
    "burst": Shape(split(split(_REST, _count(_P), "sum"), _REST, "sum"), 1, True, 0, 8, 8, 2, 2),
    "pairs": Shape(split(_count(seq(_ANY, _P, _ANY, _Q)), _REST, "sum"), 2, False, 0, 7, 8, 3, 6),
    "after": Shape(split(when(seq(_ANY, _P), SYMBOLS, 0), split(_count(seq(_ANY, _Q)), _REST, "sum"), "sum"), 2, False, None, 9, 10, 3, 5),
}


@dataclass(frozen=True)
class Candidate:
    name: str
    shape: str
    parts: tuple[int, ...]  # places in the list of atoms


def candidates(names: list[str]) -> list[Candidate]:
    """Every shape with every atom, or with every two different ones in either order."""
    found = []
    for shape, s in SHAPES.items():
        for i, first in enumerate(names):
            found += [Candidate(f"{shape} {first}", shape, (i,))] if s.atoms == 1 else [Candidate(f"{shape} {first} {second}", shape, (i, j)) for j, second in enumerate(names) if j != i]
    return found


def _bound(c: Candidate) -> Column:
    """What the value can't exceed, by the counts of the atoms alone."""
    n = [F.get("counts", i) for i in c.parts]
    return F.least(*n) if c.shape == "pairs" else n[-1]


def bounds(counts: DataFrame, every: list[Candidate]) -> DataFrame:
    """program_id, label, trace_id, lower, upper of each candidate, from the counts of all atoms in each trace."""
    each = F.array(*(F.struct(F.lit(c.name).alias("program_id"), _bound(c).alias("upper")) for c in every))
    return counts.select(*KEYS, F.explode(each).alias("c")).select("c.program_id", *KEYS, F.lit(0).cast("long").alias("lower"), "c.upper")


def scores(traces: DataFrame, order: list[str], hits: list[Column], counts: DataFrame, every: list[Candidate]) -> DataFrame:
    """program_id, label, trace_id, upper of each candidate; null where it has no match.

    Each shape is one pass: a packet goes to those candidates of the shape to which it matters, as one symbol.
    """
    plain = [c for c in every if SHAPES[c.shape].value is None]
    found = bounds(counts, plain).drop("lower") if plain else None
    for shape, s in SHAPES.items():
        own = [c for c in every if c.shape == shape]
        if s.value is None or not own:
            continue
        # bit 0: neither, 1: the first, 2: the second, 3: both
        symbol = lambda c: sum((F.when(hits[a], k).otherwise(0) for k, a in zip((1, 2), c.parts)), F.lit(0))
        rows = traces.select(*KEYS, *order, F.explode(F.array(*(F.struct(F.lit(c.name).alias("program_id"), symbol(c).alias("symbol")) for c in own))).alias("c"))
        rows = rows.select("c.program_id", *KEYS, *order, "c.symbol").where(F.lit(True) if s.others else F.col("symbol") > 0)
        values = pattern_values(rows, ["program_id", *KEYS], order, F.call_function("shiftleft", F.lit(1), F.col("symbol")), None, s.value, SYMBOLS)
        read = values.select("program_id", *KEYS, F.col("upper").alias("value"), F.lit(True).alias("read"))
        grid = counts.select(*KEYS, F.explode(F.array(*(F.lit(c.name) for c in own))).alias("program_id"))
        same = [F.col(f"g.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("program_id", *KEYS)]
        one_shape = grid.alias("g").join(read.alias("r"), same, "left").select("g.program_id", *(f"g.{k}" for k in KEYS), F.when(F.col("read"), F.col("value")).otherwise(F.lit(s.of_none)).cast("long").alias("upper"))
        found = one_shape if found is None else found.unionByName(one_shape)
    return found


def _parts(every: list[Candidate], bits: list[int]) -> list[tuple]:
    """program_id and the parts that complexity() counts; bits: how many each atom's slice is told by."""
    rows = []
    for c in every:
        s, n = SHAPES[c.shape], [bits[i] for i in c.parts]
        rows.append((c.name, s.terms + sum(x + 2 for x in n), s.joins + sum(x + 1 for x in n), s.wildcards, 0, s.favoured + 3 * len(n), False))
    return rows


def sweep_shapes(traces: DataFrame, fields: list[str], order: list[str], depth: int, required: float) -> DataFrame:
    """place, program_id, threshold, invalid, tpr, tnr, complexity of every candidate that reaches `required`, the most accurate first, then
    the simplest. traces: label (1 or 0), trace_id, the fields and the columns that order the packets of a trace.

    The driver holds the atoms, at most 2^(depth + 1) a field, and the candidates' names, never a row for each trace. A candidate is
    dropped when its bounds leave too many pairs in the wrong order; as no value exceeds its bound, no candidate that reaches
    `required` is lost. A result without a match makes its pair invalid, and is no positive verdict. Null field values lie in no
    slice; traces of other labels than 1 and 0 are scored but not paired. Without rows the result is empty.
    """
    found = stored(L.atoms(traces, fields, depth)).select("program_id", "idx", "low", "high").orderBy("program_id").collect()  # a fixed number of templates
    empty = "place int, program_id string, threshold long, invalid long, tpr double, tnr double, complexity long"
    spark = traces.sparkSession
    if not found:
        return spark.createDataFrame([], empty)
    hits = [F.coalesce(F.col(fields[a["idx"]]).between(a["low"], a["high"]), F.lit(False)) for a in found]
    counts = stored(traces.groupBy(*KEYS).agg(F.array(*(F.count_if(h) for h in hits)).alias("counts")))
    every = candidates([a["program_id"] for a in found])
    may = {r["program_id"] for r in L.acceptable(bounds(counts, every), required).where("accepted").select("program_id").collect()}  # candidates, not traces
    every = [c for c in every if c.name in may]
    if not every:
        return spark.createDataFrame([], empty)
    scored = stored(scores(traces, order, hits, counts, every))
    fit = L.acceptable(scored.withColumn("lower", F.col("upper")), required).where("accepted").select("program_id")
    limits = L.thresholds(scored).join(fit, "program_id", "left_semi").select("program_id", F.col("threshold").alias("limit"), "invalid")
    rated = L.accuracy(scored.join(F.broadcast(limits), "program_id").withColumn("positive", F.coalesce(F.col("upper") > F.col("limit"), F.lit(False))))  # one row a candidate
    parts = spark.createDataFrame(_parts(every, [len(a["program_id"].split(":")[1]) for a in found]), "program_id string, terms int, joins int, wildcards int, open_parts int, favoured int, nested boolean")
    table = rated.join(limits, "program_id").join(L.complexity(parts).select("program_id", "complexity"), "program_id")
    best = Window.orderBy(F.desc(F.col("tpr") + F.col("tnr")), "complexity", "program_id")  # one row a candidate
    return table.withColumn("place", F.row_number().over(best)).select("place", "program_id", F.col("limit").alias("threshold"), "invalid", "tpr", "tnr", "complexity")
