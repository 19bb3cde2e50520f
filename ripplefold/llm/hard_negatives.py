"""Operator 12, hard-negative mining over STR-packed R-trees.

Rows are dealt to blocks by the first two steps of sort-tile-recursive, with cuts from a bounded sample, and
a tile with more rows than a block holds is split by hash. Anchors form slabs. Every pair of a slab and a
block is a task of its own: it packs the block's rows into an R-tree, whose boxes give each coordinate's
interval of the inner product, and searches it best-first for each anchor. The first search finds the
positives; the second gets each anchor's score windows from them and leaves out boxes outside of all windows
or strictly below the kth score found. The best of the blocks are then ranked over all blocks.

Contract: scores are exact integers. Rows whose label or vector is null, or whose vector holds a null or
non-finite component, take no part. Vectors meet only others of their length. Higher scores come first, ties
by smaller vec_id, then in any order; a null vec_id comes last and never anchors. Rows that repeat are
different rows: an anchor's copies are among its positives, and each repeated anchor is mined. An anchor
without positives, or a positive without a negative in its window, gives no rows. Other columns are ignored; an
empty table gives no rows. A score over the range of long ends in an error.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefold.llm.box_tree import Best, BoxTree, search
from ripplefold.llm.common import written
from ripplefold.llm.vectors import DOUBLE_LIMIT, finite, largest, matrix, on_grid

BLOCK = 8192
SLAB = 1024
SAMPLE = 2048
TILES = 256  # at most; more rows make more parts of a tile
FOUND = "anchor long, window long, score long, found_row long, found_id long"
ROWS = "row long, vec_id long, label long, is_anchor boolean, length long, x array<long>"


def cuts_of(sample: np.ndarray, n: int) -> tuple[list[int], list[int], list[list[int]]]:
    """The two axes of greatest spread, cuts on the first, and for each slice cuts on the second, for about n tiles."""
    axes = np.argsort(-sample.astype(np.float64).var(0), kind="stable")[:2].tolist()
    slices = ceil(n**0.5)
    at = lambda values, parts: [int(values[len(values) * k // parts]) for k in range(1, parts)] if len(values) else []
    first = at(np.sort(sample[:, axes[0]]), slices)
    slice_of = np.searchsorted(first, sample[:, axes[0]], side="right")
    return axes, first, [at(np.sort(sample[slice_of == s, axes[-1]]), ceil(n / slices)) for s in range(slices)]


def _tile(cuts: dict[int, tuple]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            tile = np.zeros(len(batch), np.int64)
            for n in set(np.unique(length).tolist()) & set(cuts):
                mine = np.flatnonzero(length == n)
                axes, first, second = cuts[n]
                x = matrix(batch.column("x"), mine)
                slice_of = np.searchsorted(first, x[:, axes[0]], side="right")
                width = 1 + max(map(len, second))
                for s in np.unique(slice_of).tolist():
                    here = slice_of == s
                    tile[mine[here]] = s * width + np.searchsorted(second[s], x[here, axes[-1]], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"])

    return run


def in_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (as ROWS) with their block, and by length the numbers of blocks and slabs."""
    many = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).collect()}  # a row for BLOCK rows at least
    cuts = {}
    for length, n in many.items():
        few = rows.where(F.col("length") == length).select("x").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow()
        if length:
            cuts[length] = cuts_of(matrix(few.column("x").combine_chunks()), min(TILES, ceil(n / BLOCK)))
    placed = written(rows.mapInArrow(_tile(cuts), ROWS + ", tile long"))
    w = Window.partitionBy("length").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("length", "tile").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK))  # TILES rows a length
    cells = written(cells.withColumn("before", F.coalesce(F.sum("parts").over(w), F.lit(0))))
    slabs = placed.where("is_anchor").groupBy("length").agg(F.ceil(F.count("*") / SLAB).alias("slabs"))
    sizes = written(cells.groupBy("length").agg(F.sum("parts").alias("blocks")).join(slabs, "length"))
    block = F.col("before") + F.pmod(F.xxhash64("row"), F.col("parts"))
    return placed.join(cells.select("length", "tile", "parts", "before"), ["length", "tile"]).withColumn("block", block).drop("tile", "parts", "before"), sizes


def _mine(k: int, low: int, high: int, percent: int):
    """Per pair of a slab and a block. Anchors with `windows`, their positives' scores, get the best k of other labels inside
    each; anchors without get the best k others of their own label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            anchors, rows = anchors.combine_chunks(), rows.combine_chunks()
            a, x = (matrix(t.column("x").combine_chunks()) for t in (anchors, rows))
            kind = np.float64 if a.shape[1] * largest(a) * largest(x) < DOUBLE_LIMIT else object  # exact either way
            a, tree = a.astype(kind), BoxTree(x.astype(kind))
            place, label, ids = (rows.column(c).combine_chunks().take(pa.array(tree.order)) for c in ("row", "label", "vec_id"))
            place, label, ids = place.to_numpy(), label.to_numpy(), ids.to_pylist()
            entry = lambda p: (ids[p] is None, ids[p] or 0, int(place[p]))
            lower, upper = tree.bounds(a)
            windows = anchors.column("windows").to_pylist() if "windows" in anchors.column_names else [None] * len(a)
            for i, (me, mine, scores) in enumerate(zip(anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), windows)):
                if scores is None:
                    wanted = {None: Best(k)}
                    allowed = lambda first, last: (label[first:last] == mine) & (place[first:last] != me)  # noqa: B023, E731
                else:  # low * positive <= percent * negative <= high * positive
                    wanted = {s: Best(k, -(-low * s // percent), high * s // percent) for s in scores}
                    wanted = {s: w for s, w in wanted.items() if w.low <= w.high}
                    allowed = lambda first, last: label[first:last] != mine  # noqa: B023, E731
                if wanted:
                    search(tree, a[i], lower[i], upper[i], list(wanted.values()), allowed, entry)
                out += [(me, s, -e[0], e[3], None if e[1] else e[2]) for s, w in wanted.items() for e in w.entries]
        return pa.table({c.split()[0]: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(FOUND.split(", "))})

    return run


def mined(anchors: DataFrame, rows: DataFrame, sizes: DataFrame, keys: list[str], k: int, low: int = 0, high: int = 0, percent: int = 100) -> DataFrame:
    """The first k found by anchor and window, over all blocks."""
    sized = anchors.join(sizes, "length")
    slab = F.pmod(F.xxhash64("row"), F.col("slabs"))
    left = sized.withColumn("slab", slab).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "slabs")
    left = left.toDF(*left.columns)  # new names' identities: both sides come from one table
    right = rows.join(sizes, "length").withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1))).select("length", "slab", "block", "row", "vec_id", "label", "x")
    pair = ["length", "slab", "block"]
    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_mine(k, low, high, percent), FOUND)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, percent: int = 100, steps: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among vectors (vec_id, label,
    embedding): the first negatives whose score times `percent` lies between low and high times that of the positive."""
    good = vectors.where(F.col("label").isNotNull() & finite("embedding"))
    rows = good.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("is_anchor"),
        F.size("embedding").cast("long").alias("length"), on_grid("embedding", steps).alias("x"),
    )
    placed, sizes = in_blocks(written(rows))
    anchors = placed.where("is_anchor").select("row", "label", "length", "x")
    first = written(mined(anchors, placed, sizes, ["anchor"], positives).select("anchor", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = first.groupBy("anchor").agg(F.collect_set("positive_score").alias("windows")).withColumnRenamed("anchor", "row")  # `positives` scores at most
    second = mined(anchors.join(windows, "row"), placed, sizes, ["anchor", "window"], negatives, low, high, percent)
    both = first.join(second.select("anchor", F.col("window").alias("positive_score"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"])
    ids = placed.where("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return both.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
