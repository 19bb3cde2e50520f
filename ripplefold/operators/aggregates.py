"""Aggregations per key, nested over parameters, and with the any-undefined rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefold.sources.stored import stored


def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def sum_by(df: DataFrame, keys: list[str], value: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def heavy_hitters(df: DataFrame, keys: list[str], value: str, threshold: int) -> DataFrame:
    return sum_by(df, keys, value).where(F.col("total") > threshold)


def super_spreaders(df: DataFrame, key: str, other: str, least: int = 0) -> DataFrame:
    """Distinct partners per key: pairs are made unique first, so that a hot key is spread over its pairs."""
    return count_by(df.select(key, other).where(F.col(other).isNotNull()).distinct(), [key], "partners").where(F.col("partners") > least)


BROADCAST_CELLS = 500_000


def cells_for(n_rows: int, threshold: int, load: float = 0.25) -> int:
    """So many cells a sketch row that one holds `load` of the threshold on average, whatever the number of rows: a key
    under it then shares a cell over it in each of three rows about once in sixty times at most."""
    return max(1024, -(-n_rows // max(1, int(threshold * load))))


def _cell(row: int, key: str, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), F.col(key)), F.lit(cells))


def count_sketch(df: DataFrame, key: str, cells: int, rows: int = 3) -> DataFrame:
    """row, cell, n: counters that never fall below a key's true count in any of its cells. A table like any other: sketches of the
    same shape, of other files or other days, are merged by merge_sketches."""
    known = df.select(key).where(F.col(key).isNotNull())
    each = F.array(*(F.struct(F.lit(i).alias("row"), _cell(i, key, cells).alias("cell")) for i in range(rows)))
    return known.select(F.explode(each).alias("c")).groupBy("c.row", "c.cell").agg(F.count("*").alias("n"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    whole = sketches[0]
    for more in sketches[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("row", "cell").agg(F.sum("n").alias("n"))


def likely_heavy(df: DataFrame, key: str, sketch: DataFrame, cells: int, threshold: int, rows: int = 3) -> DataFrame:
    """The rows whose key may be over the threshold: its cells are in every row of the sketch. At most a row count over the threshold
    of cells can be, so they are few; beyond BROADCAST_CELLS they are joined by shuffle."""
    over = stored(sketch.where(F.col("n") > threshold))
    known = df.where(F.col(key).isNotNull())
    for i in range(rows):
        mine = over.where(F.col("row") == i).select(F.col("cell").alias("_cell"))
        side = F.broadcast(mine) if mine.count() <= BROADCAST_CELLS else mine
        known = known.join(side, _cell(i, key, cells) == F.col("_cell"), "left_semi")
    return known


def heavy_hitters_sketch(df: DataFrame, key: str, threshold: int, rows: int = 3) -> DataFrame:
    """Keys over the threshold: only those whose cells are over it in every row of a sketch are counted by themselves."""
    cells = cells_for(df.count(), threshold)
    sketch = count_sketch(df, key, cells, rows)
    return count_by(likely_heavy(df.select(key), key, sketch, cells, threshold, rows), [key]).where(F.col("n") > threshold)


def super_spreaders_approx(df: DataFrame, key: str, other: str, rsd: float = 0.05) -> DataFrame:
    return df.groupBy(key).agg(F.approx_count_distinct(other, rsd).alias("partners"))


def partner_sketches(df: DataFrame, keys: list[str], other: str, lg_k: int = 12) -> DataFrame:
    """keys, sketch: a mergeable sketch of the distinct partners, of fixed size however many there are; to be stored by window or by file."""
    return df.where(F.col(other).isNotNull()).groupBy(*keys).agg(F.hll_sketch_agg(other, F.lit(lg_k)).alias("sketch"))


def partners_of(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, partners: the estimate over all sketches of the keys; of 2 ** lg_k registers its relative error is 1.04 over their root on
    average, 1.6 percent for 12, and few partners are counted exactly."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("partners"))


def frequency_by(df: DataFrame, key: str) -> DataFrame:
    """Each value's share of all rows; the total is one row and is broadcast."""
    counts = count_by(df, [key])
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    return counts.join(total).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def entropy(df: DataFrame, key: str) -> DataFrame:
    """Shannon entropy in nats of a column, from two levels of partial aggregates."""
    c = count_by(df, [key]).agg(F.sum(F.col("n") * F.ln("n")).alias("nln"), F.sum("n").alias("n"))
    return c.select(F.round(F.ln("n") - F.col("nln") / F.col("n"), 6).alias("entropy"))


def share_between(df: DataFrame, keys: list[str], value: str, low: int, high: int) -> DataFrame:
    sums = sum_by(df, keys, value)
    return sums.agg(F.count_if((F.col("total") > low) & (F.col("total") < high)).alias("inside"), F.count("*").alias("pairs")).select("inside", "pairs", F.round(F.col("inside") / F.col("pairs"), 6).alias("share"))


AGGREGATORS = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}


def defined(op: str, value: str) -> Column:
    """An aggregate that is undefined as soon as one of its inputs is, unlike SQL's."""
    return F.when(F.count(value) == F.count(F.lit(1)), AGGREGATORS[op](value))


def agg_stack(df: DataFrame, stack: list[tuple[str, str]], value: str) -> DataFrame:
    """Nested aggregations, outermost first: [("max", "f1"), ("sum", "f2")] is the maximum over f1 of sums over f2."""
    keys = [key for _, key in stack]
    out = df.groupBy(*keys).agg(defined("sum", value).alias(value)) if keys else df
    for depth in range(len(stack), 0, -1):
        out = out.groupBy(*keys[: depth - 1]).agg(defined(stack[depth - 1][0], value).alias(value))
    return out


def combine(op: str, low1: Column, high1: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
    """Bounds of a sum, difference, product or quotient; null where the result conflicts."""
    if op == "+":
        return low1 + low2, high1 + high2
    if op == "-":
        bad = high1 - low2 < 0
        return F.when(~bad, F.greatest(low1 - high2, F.lit(0))), F.when(~bad, high1 - low2)
    if op == "*":
        return low1 * low2, high1 * high2
    bad = low2 == 0
    return F.when(~bad, F.floor(low1 / F.when(high2 != 0, high2))), F.when(~bad, F.floor(high1 / F.when(low2 != 0, low2)))


def merge_bounds(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(low).alias("lower"), F.max(high).alias("upper"))


def trace_stats(df: DataFrame) -> DataFrame:
    hosts = df.select("src").union(df.select("dst")).distinct().agg(F.count("*").alias("hosts"))
    return df.agg(
        F.count("*").alias("packets"), F.count_if("syn").alias("syns"), F.count_if("fin").alias("fins"), F.count_if("ack").alias("acks"), F.count_if("rst").alias("rsts"),
        F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.count_distinct("src", "dst").alias("pairs"), F.sum("len").alias("bytes"),
    ).join(F.broadcast(hosts))


def trace_counters(df: DataFrame) -> DataFrame:
    """Fourteen counters of a decoded trace: packets by version and transport, distinct addresses and ports."""
    v4, v6, tcp, udp = F.col("version") == 4, F.col("version") == 6, F.col("protocol") == 6, F.col("protocol") == 17
    of = lambda condition, column: F.count_distinct(F.when(condition, F.col(column)))
    hosts = df.where(v4).select(F.explode(F.array("src", "dst")).alias("h")).distinct().agg(F.count("*").alias("ips"))
    return df.agg(
        F.count("*").alias("packets"), F.count_if(v4).alias("ipv4"), F.count_if(v6).alias("ipv6"), F.count_if(v4 & tcp).alias("tcp"), F.count_if(v4 & udp).alias("udp"), F.count_if(v4 & ~tcp & ~udp).alias("other"),
        of(v4, "src").alias("srcips"), of(v4, "dst").alias("dstips"), of(v4 & tcp, "src").alias("tcpsrcips"), of(v4 & tcp, "src_port").alias("tcpsrcs"), of(v4 & tcp, "dst_port").alias("tcpdsts"),
        of(v4 & udp, "src_port").alias("udpsrcs"), of(v4 & udp, "dst_port").alias("udpdsts"),
    ).join(F.broadcast(hosts))


def label_profile(df: DataFrame, label: str, ts: str) -> DataFrame:
    total = Window.partitionBy()
    out = df.groupBy(label).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(total), 6))


def duplicates(df: DataFrame, keys: list[str], number: str, least: int = 2) -> DataFrame:
    return count_by(df, [*keys, number]).groupBy(*keys).agg(F.count_if(F.col("n") >= least).alias("repeated"))


def heavy_users(df: DataFrame, key: str, value: str, ratio: float) -> DataFrame:
    """Keys above `ratio` times the mean of all keys."""
    sums = sum_by(df, [key], value)
    mean = F.broadcast(sums.agg(F.sum("total").alias("all"), F.count("*").alias("keys")))
    return sums.join(mean).where(F.col("total") * F.col("keys") > F.lit(ratio) * F.col("all")).select(key, "total")
