"""User folds in order against plain loops: null keys, long keys cut over tasks and batches, no rows."""

import random

from ripplefold.operators import folds

ROWS = "k int, t long, n long"


def test_folds(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), t, rnd.choice([None, -7, -3, 1, 2, 5, 9])) for t in range(3000)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), ROWS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # a key is then read in many pieces
    try:
        cut = {r.k: r.best for r in folds.best_stretch(df, ["k"], ["t"], "n").collect()}
        whole = folds.best_stretch(df, [], ["t"], "n").collect()
        bucket = {r.k: (r.passed, r.refused) for r in folds.token_bucket(df, ["k"], ["t"], "t", "n", 10, 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def best(numbers):
        top = here = 0
        for n in numbers:
            here = max(0, here + (n or 0))
            top = max(top, here)
        return top

    def passed(packets):
        level, since, ok, no = 10, None, 0, 0
        for t, n in packets:
            gained = 0 if since is None else (t - since) // 3
            level, since = min(10, level + gained), t if since is None else since + 3 * gained
            if (n or 0) <= level:
                level, ok = level - (n or 0), ok + 1
            else:
                no += 1
        return ok, no

    of = {k: [(t, n) for key, t, n in rows if key == k] for k in (1, 2, 3, None)}
    assert cut == {k: best(n for _, n in v) for k, v in of.items()}
    assert [r.best for r in whole] == [best(n for _, _, n in rows)]
    assert bucket == {k: passed(v) for k, v in of.items()}


def test_no_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert folds.best_stretch(empty, ["k"], ["t"], "n").count() == 0
    assert folds.token_bucket(empty, ["k"], ["t"], "t", "n", 10, 3).count() == 0
