"""What only larger tables hold: sources over 16 bits, times within the last half millisecond of a bucket."""

import datetime

import pandas as pd
from oracle import differences, views

from ripplefold.plans import catalog


def events(home, rows):
    """A table of (time, source, kind, value)."""
    frame = pd.DataFrame([(i, *row, f'{{"k": {i % 7}}}') for i, row in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame.to_parquet(home / "events.parquet", coerce_timestamps="us")
    return str(home)


def same(spark, folder, name):
    return differences(catalog.QUERIES[name](spark, folder), views(folder), catalog.ORACLE_SQL[name])


def test_addresses_over_32_bits(spark, tmp_path):
    noon = datetime.datetime(2024, 1, 1, 12)
    folder = events(tmp_path, [(noon, src, "view", 1.0) for src in (1, 65_534, 65_535, 65_536, 90_000, 5_000_000)])
    assert same(spark, folder, "f04_f05_addresses") == ""


def test_minutes_end_with_their_last_microsecond(spark, tmp_path):
    minute = datetime.datetime(2024, 1, 1, 12, 5, 59)
    folder = events(tmp_path, [(minute.replace(microsecond=us), 1, "view", 1.0) for us in (0, 999_499, 999_500, 999_999)])
    assert [tuple(r) for r in catalog.QUERIES["f10_time_bucket"](spark, folder).collect()] == [(1_704_110_700_000, 4)]
    assert same(spark, folder, "f10_time_bucket") == ""


def test_hours_end_with_their_last_microsecond(spark, tmp_path):
    last = datetime.datetime(2024, 1, 1, 12, 59, 59, 999_600)
    folder = events(tmp_path, [(last, 1, "view", 1.0), (last + datetime.timedelta(hours=3), 1, "view", 2.0)])
    assert [r.total for r in catalog.QUERIES["t01_tumbling"](spark, folder).orderBy("bucket").collect()] == [100, 0, 0, 200]
    assert same(spark, folder, "t01_tumbling") == ""
