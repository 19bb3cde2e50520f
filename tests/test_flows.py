"""Flows by the four values that name a connection, and tables split by kind."""

import random

from pyspark.sql import functions as F

from ripplefold.operators import connections as C
from ripplefold.operators import prepare as D

KEYS = ["src", "sport", "dst", "dport"]


def test_flows_by_four_values(spark):
    """Against one pass by hand: connections that share three of the four values, repeated and lone packets, null keys."""
    rnd = random.Random(8)
    rows = [(i, i // 2, rnd.choice([1, 2, None]), rnd.choice([7, 8]), 5, rnd.choice([80, 81]), k == "s", k == "f") for i, k in enumerate(rnd.choices("sfo", k=400))]
    df = spark.createDataFrame(rows, "pkt_id long, sec long, src int, sport int, dst int, dport int, syn boolean, fin boolean").withColumn("ts", F.timestamp_seconds("sec"))
    last, opened, flows, lives = {}, {}, {}, {}
    for i, sec, *key, syn, fin in rows:
        key = tuple(key)
        if not (syn or fin):
            continue
        flows[key] = flows.get(key, 0) + (fin and last.get(key) == "s")
        if fin and key in opened:
            lives[i] = sec - opened[key]
        if syn:
            opened[key] = sec
        last[key] = "s" if syn else "f"
    assert {tuple(r)[:4]: r.flows for r in C.completed(df, KEYS, F.col("syn"), F.col("fin")).collect()} == flows
    assert {r.pkt_id: r.life for r in C.lifetimes(df, KEYS, F.col("syn"), F.col("fin")).collect()} == lives


def test_split_by_kind(spark):
    """Any kind, odd names, the empty string and null; only the picked kind's folder is read."""
    kinds = ["a", "a b/c=d", "", None, "1", "01", "a"]
    df = spark.createDataFrame(list(enumerate(kinds)), "i int, kind string")
    split = D.split_by(df, "kind")
    for kind in set(kinds):
        got = D.picked(split, "kind", kind)
        assert sorted(r.i for r in got.collect()) == [i for i, k in enumerate(kinds) if k == kind]
        assert got.columns == ["i", "kind"]
    plan = D.picked(split, "kind", "1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert D.picked(D.split_by(df.where("i < 0"), "kind"), "kind", "a").count() == 0
