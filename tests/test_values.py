"""Values over patterns against enumeration of all parses, in one piece, cut up, over tasks, and with shared packets."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplefold.operators import chunks as K
from ripplefold.operators import registers as R
from ripplefold.operators.patterns import alt, contains, one, seq, star
from ripplefold.operators.registers import either, iterate, split, total, when

S = "abc"
A, B, C = one("a"), one("b"), one("c")
TO_B = split(iterate(total(seq(star(alt(A, C)), B), S), "max"), when(star(alt(A, C)), S, 0), "max")
NESTED = split(iterate(split(iterate(total(seq(star(A), B), S), "max"), total(seq(star(A), C), S), "sum"), "sum"), when(star(alt(A, B)), S, 0), "sum")
#: Expressions whose bounds are reached by a reading, and ones that have bounds which hold for all.
EXACT = {
    "to_b": TO_B, "nested": NESTED, "one_max": iterate(either(total(A, S), when(alt(B, C), S, 0)), "max"), "one_min": iterate(either(total(A, S, "min"), when(alt(B, C), S, 1 << 20)), "min"),
    "alternatives": iterate(when(alt(seq(star(A), B), C), S, 2), "sum"), "ambiguous": iterate(when(alt(A, B, seq(A, B)), S), "sum"), "contains": total(contains(A, B), S), "least": iterate(total(seq(star(A), B), S, "max"), "min"),
    "three": iterate(iterate(iterate(total(seq(A, B), S), "max"), "min"), "sum"),
}
SAFE = {"cut": split(total(star(alt(A, B)), S), total(star(alt(B, C)), S, "max"), "sum"), "iterated": iterate(iterate(total(seq(star(A), B), S), "max"), "sum")}
del EXACT["three"]


def parses(v, word, weights):
    """Every value of v on a word, by enumeration."""
    if v.kind == "leaf":
        q = 0
        for c in word:
            q = v.table[q][c]
        return [] if not v.accepting[q] else [v.constant] if v.constant is not None else [R.folded(v.fold, R.START[v.fold], *weights)]
    if v.kind == "either":
        return [x for part in v.parts for x in parses(part, word, weights)]
    if v.kind == "split":
        return [R.folded(v.fold, R.START[v.fold], a, b) for i in range(len(word) + 1) for a in parses(v.parts[0], word[:i], weights[:i]) for b in parses(v.parts[1], word[i:], weights[i:])]

    def pieces(word, weights):
        if not word:
            return [[]]
        return [[a, *rest] for i in range(1, len(word) + 1) for a in parses(v.parts[0], word[:i], weights[:i]) for rest in pieces(word[i:], weights[i:])]

    return [R.folded(v.fold, R.START[v.fold], *p) for p in pieces(word, weights)]


def in_chunks(v, may_be, weights, cuts):
    m, whole = R.machine(v, 3), None
    for first, last in itertools.pairwise([0, *cuts, len(may_be)]):
        own = R.Summary.unread(m, 1, list(range(m.start)) if first else [m.start])
        for i in range(first, last):
            own = R.read(m, own, np.array([may_be[i]]), np.array([weights[i]]))
        whole = own if whole is None else R.composed(m, whole, own)
    ok, low, high = R.values(m, whole)
    return (int(low[0]), int(high[0])) if ok[0] else None


@pytest.mark.parametrize("name", [*EXACT, *SAFE])
def test_all_parses(name):
    v, rnd, matched = {**EXACT, **SAFE}[name], random.Random(name), 0
    for _ in range(250):
        n = rnd.randint(1, 7)
        readings = [rnd.choice([[0], [1], [2]] if name not in ("one_max", "one_min") else [[0], [1], [0, 1], [0, 1, 2]]) for _ in range(n)]
        weights = [rnd.randint(1, 9) for _ in range(n)]
        want = [x for word in itertools.product(*readings) for x in parses(v, word, weights)]
        got = in_chunks(v, [sum(1 << c for c in r) for r in readings], weights, sorted(rnd.sample(range(1, n), min(n - 1, rnd.randint(0, 3)))))
        assert (got is None) == (not want)
        if want:
            matched += 1
            assert got[0] <= min(want) and got[1] >= max(want) if name in SAFE else got == (min(want), max(want))
    assert matched > 20


def stream(spark, rows):
    return spark.createDataFrame(rows, "k int, pos int, c string, v long").repartition(3)


def bits():
    return K.bits(S, {"a": F.col("c") == "a", "b": F.col("c") == "b"}, "c")


def told(v, rows, keys=True):
    by = {}
    for k, pos, c, w in sorted(rows, key=lambda r: (r[1],)):
        by.setdefault(k if keys else 0, []).append((S.index(c), w or 0))
    found = {k: parses(v, [c for c, _ in own], [w for _, w in own]) for k, own in by.items()}
    return {k: (min(x), max(x)) if x else (None, None) for k, x in found.items()}


@pytest.fixture
def small_parts(spark):
    """Several range partitions and small Arrow batches, so that keys are cut by both."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("chunk", [2, 128])
def test_keys_over_tasks(spark, small_parts, chunk, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", chunk)
    rnd = random.Random(chunk)
    rows = [(rnd.choice([None, *range(12), *[5] * 9]), i, rnd.choice("aaabc"), rnd.randint(1, 9) if i % 7 else None) for i in range(130)]
    for v in (TO_B, NESTED):
        got = {r.k: (r.lower, r.upper) for r in K.pattern_values(stream(spark, rows), ["k"], ["pos"], bits(), F.col("v"), v, S).collect()}
        assert got == told(v, rows)
    long = [(1, i, rnd.choice("aaabc"), rnd.randint(1, 9)) for i in range(3000)]  # one key for all rows, and none
    outer = [0, 0]
    best = here = 0
    for _, _, c, w in long:
        here += w
        if c == "b":
            best, here = max(best, here), 0
        if c == "c":
            outer[0] += best + here
            best = here = 0
    assert [tuple(r) for r in K.pattern_values(stream(spark, long), ["k"], ["pos"], bits(), F.col("v"), NESTED, S).collect()] == [(1, outer[0], outer[0])]
    assert [tuple(r) for r in K.pattern_values(stream(spark, long), [], ["pos"], bits(), F.col("v"), NESTED, S).collect()] == [(outer[0], outer[0])]
    assert K.pattern_values(stream(spark, []), ["k"], ["pos"], bits(), F.col("v"), NESTED, S).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_shared_packets(spark, small_parts, block, monkeypatch):
    """Every key reads the packets of c at their place; the stream of each key is put together by hand."""
    monkeypatch.setattr(K, "BLOCK", block)
    rnd = random.Random(block)
    for n, share in ((90, 0.3), (60, 0.05), (30, 0.0)):
        rows = [(rnd.choice([None, 1, 2, 3, 3, 3]), i, "c" if rnd.random() < share else rnd.choice("aab"), rnd.randint(1, 9)) for i in range(n)]
        got = {(r.k, r.unseen): (r.lower, r.upper) for r in K.shared_values(stream(spark, rows), ["k"], ["pos"], F.col("c") == "c", bits(), F.col("v"), NESTED, S).collect()}
        keys = {r[0] for r in rows if r[2] != "c"}
        want = {(k, False): next(iter(told(NESTED, [r for r in rows if r[2] == "c" or r[0] == k], keys=False).values())) for k in keys}
        want[None, True] = next(iter(told(NESTED, [r for r in rows if r[2] == "c"], keys=False).values()), (0, 0))
        assert got == want


@pytest.mark.parametrize("block", [4, 256])
def test_shared_packets_of_unknown_kind(spark, small_parts, block, monkeypatch):
    """Against pattern_values of the streams put together by joins: keys of two columns with nulls, packets of either kind, blocks with shared
    packets only or none, a single key, no packets at all."""
    monkeypatch.setattr(K, "BLOCK", block)
    value, rnd = EXACT["one_max"], random.Random(block)
    may_be = K.bits(S, {"a": F.when(F.col("c") != "b", F.col("c") == "a")}, "c")
    schema = "k int, name string, pos int, c string, v long, all boolean"
    for n, share, names in ((200, 0.9, [None, "x", "y"]), (120, 0.2, [None, "x", "y"]), (60, 0.4, ["x"]), (0, 0.5, ["x"])):
        rows = [(rnd.choice([None, 1, 2]) if len(names) > 1 else 1, rnd.choice(names), i, rnd.choice("aabc"), rnd.choice([None, -3, 2, 9]), rnd.random() < share) for i in range(n)]
        df = spark.createDataFrame(rows, schema).repartition(3)
        got = {(r.k, r.name, r.unseen): (r.lower, r.upper) for r in K.shared_values(df, ["k", "name"], ["pos"], F.col("all"), may_be, F.col("v"), value, S).collect()}
        keys = {r[:2] for r in rows if not r[5]}
        each = [(*k, *r[2:]) for k in keys for r in rows if r[5] or r[:2] == k]
        want = {(r.k, r.name, False): (r.lower, r.upper) for r in K.pattern_values(spark.createDataFrame(each, schema), ["k", "name"], ["pos"], may_be, F.col("v"), value, S).collect()}
        nobody = K.pattern_values(spark.createDataFrame([r for r in rows if r[5]], schema), [], ["pos"], may_be, F.col("v"), value, S).collect()
        want[None, None, True] = tuple(nobody[0]) if nobody else (0, 0)
        assert got == want


def test_rows_shuffled_for_shared_packets(spark):
    """As many for each packet, whether few or many shared packets lie between two packets of a key."""
    sc = spark.sparkContext
    store, options = sc._jsc.sc().statusStore(), (False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def shuffled() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, *options)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    for n_keys in (10, 1500):
        df = spark.range(12_000).select((F.col("id") * 7 % n_keys).cast("int").alias("k"), F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 2 == 0, "c").otherwise("a").alias("c"), F.lit(1).cast("long").alias("v"))
        before = shuffled()
        assert K.shared_values(df, ["k"], ["pos"], F.col("c") == "c", bits(), F.col("v"), TO_B, S).count() == n_keys // 2 + 1
        assert shuffled() - before < 6 * 12_000


def test_sketches(spark):
    """Estimates never fall below the counts, sketches of parts merge to that of the whole, and most keys are left out at any size."""
    from ripplefold.operators import aggregates as A

    for n in (20_000, 200_000):
        df = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id") % 30).otherwise(1000 + F.col("id") % (n // 4)).alias("k"))
        threshold = n // 100
        cells = A.cells_for(n, threshold)
        whole, parts = A.count_sketch(df, "k", cells), A.merge_sketches(A.count_sketch(df.where("k % 2 = 0"), "k", cells), A.count_sketch(df.where("k % 2 = 1"), "k", cells))
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select("row", "cell", "n").collect()))
        left = A.likely_heavy(df, "k", whole, cells, threshold).select("k").distinct().count()
        assert 3 <= left < 0.05 * n // 4
        assert {(r.k, r.n) for r in A.heavy_hitters_sketch(df, "k", threshold).collect()} == {(k, n // 30 + (k < n % 30)) for k in (0, 10, 20)}
    pairs = spark.range(300_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("day"), F.col("id").alias("x"))
    for r in A.partners_of(A.partner_sketches(pairs, ["k", "day"], "x"), ["k"]).collect():
        assert abs(r.partners / 100_000 - 1) < 5 * 1.04 / 64
