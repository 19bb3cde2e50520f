"""Stream queries over a table of several files that each span all times."""

import pytest
from oracle import differences, views
from pyspark.sql import functions as F

from ripplefold.plans import catalog
from ripplefold.sources import packets as S
from ripplefold.streaming import jobs as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("split")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("_part", F.xxhash64(*events.columns)).repartition(5, "_part").drop("_part").write.parquet(f"{home}/events.parquet")
    return str(home)


@pytest.mark.parametrize("name", ["r01_live_counts", "r06_same_query", "r07_tumbling_stream", "r03_sliding_stream"])
def test_files_out_of_order(spark, split, name):
    assert differences(catalog.QUERIES[name](spark, split), views(SF), catalog.ORACLE_SQL[name]) == ""


def test_quiet_sources_are_forgotten(spark, tmp_path):
    """One file a batch: state ends once the watermark is far enough past a source's last packet, later packets start anew, and
    packets behind the watermark are dropped."""
    import datetime
    import os

    import pandas as pd

    begin = datetime.datetime(2024, 1, 1)
    at = lambda minute: begin + datetime.timedelta(minutes=minute)
    batches = [
        [(1, 0, "signup"), (1, 1, "purchase"), (2, 2, "signup")],
        [(2, 30, "purchase"), (3, 31, "view")],
        [(3, 400, "view")],  # 1 and 2 have been quiet for over an hour
        [(1, 410, "signup"), (1, 411, "purchase"), (2, 5, "signup"), (2, 6, "purchase")],  # 1 starts anew, 2's packets are too late
        [(3, 412, "view")],
    ]
    home, n = tmp_path / "events.parquet", 0
    home.mkdir()
    for i, rows in enumerate(batches):
        frame = pd.DataFrame([(n + k, at(m), src, kind, 1.0, '{"k": 1}') for k, (src, m, kind) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        n += len(rows)
        frame.to_parquet(home / f"part-{i}.parquet", coerce_timestamps="us")
        os.utime(home / f"part-{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    out = R.drained(R.expiring_state(S.as_packets(R.event_stream(spark, str(tmp_path), 1)), 0, 3600, "10 minutes"), "update").orderBy("batch", "src").collect()
    assert [(r.src, r.n, r.delta, r.alert) for r in out if not r.expired] == [(1, 1, 1, True), (2, 0, 0, False), (2, 1, 1, True), (1, 1, 1, True)]
    assert [(r.src, r.n) for r in out if r.expired] == [(2, 1)]


def test_quiet_sources_in_any_zone(spark):
    """Times are those of the stream, whatever zone the session shows them in."""
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert differences(catalog.QUERIES["r02_expiring_state"](spark, SF), views(SF), catalog.ORACLE_SQL["r02_expiring_state"]) == ""
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
