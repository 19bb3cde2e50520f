"""User folds over each key's packets in order: start, step and finish, for what Columns can't express.

A step takes the state and some of a key's packets, as an Arrow batch, so that no key is ever held whole, and can work on whole columns.
Where two states can be merged, a key of any length is cut over all tasks; a fold without that goes through each key in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ripplefold.operators.chunks import changes, key_of


def _runs(batches, keys: list[str]):
    """Pieces of sorted batches, each of one key, as (key, piece)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = [*changes(batch, keys).nonzero()[0].tolist(), batch.num_rows]
        for a, b in zip(begins, begins[1:]):
            yield key_of(batch, keys, a), batch.slice(a, b - a)


def _folded(batches, keys: list[str], first: Callable, step: Callable):
    """(key, state) of each key, whose pieces stand together."""
    key, state, any_ = None, None, False
    for own, piece in _runs(batches, keys):
        if not any_ or own != key:
            if any_:
                yield key, state
            key, state, any_ = own, first(), True
        state = step(state, piece)
    if any_:
        yield key, state


def _tables(rows, schema, size: int = 1024):
    """Tuples to batches of a bounded number of rows."""
    import pyarrow as pa

    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable, step: Callable, finish: Callable, result: StructType, merge: Callable | None = None) -> DataFrame:
    """keys and the fields of `result` for each key: finish(state) gives them as a tuple, state begins as start() and becomes step(state, piece)
    for each next piece of the key's packets, a record batch with `order` and `columns`. Null keys are keys; no rows give no result.

    merge(a, b) is the state after the packets of a, then those of b, both from start(). With it, rows are cut by range of keys and order,
    each task sends one state a key, and these, which are as many as tasks at most, are merged in order. States must be picklable.
    """
    rows = df.select(*dict.fromkeys([*keys, *order, *columns]))
    own = [rows.schema[k] for k in keys]
    done = StructType([*own, *result.fields])
    to_done = to_arrow_schema(done)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as small partitions merged into one would be read by one task
    if merge is None:
        def whole(batches):
            return _tables(((*k, *finish(s)) for k, s in _folded(batches, keys, start, step)), to_done)

        return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(whole, done)
    partial = StructType([*own, StructField("_part", IntegerType()), StructField("_state", BinaryType())])
    to_partial = to_arrow_schema(partial)

    def cut(batches):
        part = TaskContext.get().partitionId()
        return _tables(((*k, part, pickle.dumps(s)) for k, s in _folded(batches, keys, start, step)), to_partial)

    def merged(batches):
        def next_(state, piece):
            for blob in piece.column("_state").to_pylist():
                other = pickle.loads(blob)
                state = other if state is None else merge(state, other)
            return state

        return _tables(((*k, *finish(s)) for k, s in _folded(batches, keys, lambda: None, next_)), to_done)

    states = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(cut, partial)
    return (states.repartition(*keys) if keys else states.repartition(1)).sortWithinPartitions(*keys, "_part").mapInArrow(merged, done)


# two folds


def token_bucket(df: DataFrame, keys: list[str], order: list[str], seconds: str, size: str, most: int, slow: int) -> DataFrame:
    """keys, passed, refused: a bucket that holds `most`, is full at first and gains one every `slow` seconds; a packet passes if the bucket holds its
    size, which it then takes. Whole seconds without a gain carry over, and null sizes count as 0."""

    def step(state, piece):
        level, since, passed, refused = state
        for t, n in zip(piece.column(seconds).to_pylist(), piece.column(size).to_pylist()):
            gained = 0 if since is None else max(0, (t - since) // slow)
            level, since = min(most, level + gained), t if since is None else since + gained * slow
            if (n or 0) <= level:
                level, passed = level - (n or 0), passed + 1
            else:
                refused += 1
        return level, since, passed, refused

    result = StructType.fromDDL("passed bigint, refused bigint")
    return fold_in_order(df, keys, order, [seconds, size], lambda: (most, None, 0, 0), step, lambda s: s[2:], result)


def best_stretch(df: DataFrame, keys: list[str], order: list[str], weight: str) -> DataFrame:
    """keys, best: the greatest sum of weights over successive packets, 0 for none; null weights count as 0."""

    def of(piece):
        import numpy as np

        w = np.nan_to_num(piece.column(weight).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        sums = np.concatenate([[0], w.cumsum()])
        return int(sums[-1]), int(sums.max()), int(sums[-1] - sums.min()), int((sums - np.minimum.accumulate(sums)).max())

    def merge(a, b):  # sum, greatest from the start, greatest up to the end, greatest anywhere
        return a[0] + b[0], max(a[1], a[0] + b[1]), max(b[2], a[2] + b[0]), max(a[3], b[3], a[2] + b[1])

    return fold_in_order(df, keys, order, [weight], lambda: (0, 0, 0, 0), lambda s, piece: merge(s, of(piece)), lambda s: (s[3],), StructType.fromDDL("best bigint"), merge)
