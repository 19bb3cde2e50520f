"""Candidates of several parts against their values by enumeration, and the sweep that ranks them."""

import random

from pyspark.sql import functions as F
from test_values import parses

from ripplefold.operators import templates as T

TRACES = "label int, trace_id int, i int, x long, y long"


def by_hand(shape: str, word: list[int]):
    """Of the symbols 0 to 3 of a trace (neither, first, second, both), the value by plain loops."""
    p, q = [bool(s & 1) for s in word], [bool(s & 2) for s in word]
    if shape == "count":
        return sum(p)
    if shape == "ends":
        return sum(p) if p[-1] else None
    if shape == "burst":
        best = run = 0
        for hit in p:
            run = run + 1 if hit else 0
            best = max(best, run)
        return best
    if shape == "pairs":
        n, open_ = 0, False
        for a, b in zip(p, q):
            if open_ and b:
                n, open_ = n + 1, False
            else:
                open_ = open_ or a
        return n
    return sum(q[p.index(True) + 1 :]) if any(p) else None


def test_loops_and_parses_agree():
    rnd = random.Random(5)
    for shape, s in T.SHAPES.items():
        if s.value is not None:
            for _ in range(12):
                word = [rnd.randrange(4) for _ in range(rnd.randrange(1, 6))]
                assert by_hand(shape, word) == max(parses(s.value, word, [0] * len(word)), default=None), (shape, word)


def test_scores(spark):
    """Every candidate and trace, with nulls, packets of neither kind and traces without hits; no value exceeds its bound."""
    rnd = random.Random(6)
    words = {t: [(rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(rnd.randrange(1, 12))] for t in range(30)} | {30: [(None, None)] * 3, 31: [(0, 0)], 32: [(1, 0)] * 40}
    df = spark.createDataFrame([(t % 2, t, i, x, y) for t, w in words.items() for i, (x, y) in enumerate(w)], TRACES)
    atoms = [("x", 0), ("x", 1), ("y", 1)]
    hits = [F.coalesce(F.col(f) == v, F.lit(False)) for f, v in atoms]
    counts = df.groupBy("label", "trace_id").agg(F.array(*(F.count_if(h) for h in hits)).alias("counts"))
    every = T.candidates([f"{f}:{v}" for f, v in atoms])
    got = {(r.program_id, r.trace_id): r.upper for r in T.scores(df, ["i"], hits, counts, every).collect()}
    limit = {(r.program_id, r.trace_id): r.upper for r in T.bounds(counts, every).collect()}
    hit = lambda a, packet: packet["xy".index(atoms[a][0])] == atoms[a][1]
    want = {(c.name, t): by_hand(c.shape, [sum(k * hit(a, packet) for k, a in zip((1, 2), c.parts)) for packet in w]) for c in every for t, w in words.items()}
    assert got == want and got.keys() == limit.keys()
    assert all(v is None or v <= limit[k] for k, v in got.items())


def test_order_tells_classes_apart(spark):
    """Traces with the same packets in another order: only a shape that reads the order separates them."""
    rows = [(int(t < 10), t, i, x, 0) for t in range(20) for i, x in enumerate([1, 9] * 3 if t < 10 else [9, 9, 9, 1, 1, 1])]
    table = T.sweep_shapes(spark.createDataFrame(rows, TRACES), ["x"], ["i"], 1, 0.9).orderBy("place").collect()
    first = table[0]
    assert (first.tpr, first.tnr, first.invalid) == (1.0, 1.0, 0) and first.program_id in ("ends 0:11", "pairs 0:10 0:11", "after 0:10 0:11")
    assert not any(r.program_id.startswith("count") for r in table)
    assert [r.place for r in table] == list(range(1, len(table) + 1)) and all(r.invalid <= 1 for r in table)


def test_empty_and_one_class(spark):
    empty = spark.createDataFrame([], TRACES)
    assert T.sweep_shapes(empty, ["x"], ["i"], 1, 0.5).count() == 0
    assert T.sweep_shapes(spark.createDataFrame([(1, 1, 0, 1, 1), (1, 2, 0, 2, 2)], TRACES), ["x"], ["i"], 1, 0.5).count() == 0
