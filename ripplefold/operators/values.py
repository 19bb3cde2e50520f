"""Values over patterns: folds of numbers over the pieces that a pattern takes, bounds over all parses, shared packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplefold.operators.joins import in_order
from ripplefold.operators.patterns import Pattern, automaton

FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}
EMPTY = {"sum": 0, "max": 0, "min": 1 << 20}  # fixed values: what a fold over no pieces gives


def pieces(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Packets that lie in a piece from an opening one to the next closing one, numbered by `piece` within the keys. One running
    window a key: an opening packet outside of a piece starts one, a closing packet inside ends it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    number = df.withColumn("_closes", closes & ~opens).withColumn("_opens", opens)
    # pieces end at closing packets, so between two of them only the first opening one starts a piece
    stretch = number.withColumn("_stretch", F.coalesce(F.sum(F.col("_closes").cast("int")).over(before), F.lit(0)))
    inside = F.max(F.col("_opens").cast("int")).over(Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.max(F.col("_closes").cast("int")).over(Window.partitionBy(*keys, "_stretch"))
    return stretch.withColumn("_in", inside).withColumn("_whole", whole).where("_in = 1 and _whole = 1").withColumn("piece", F.col("_stretch")).drop("_closes", "_opens", "_stretch", "_in", "_whole")


def iterate(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, value: str, inner: str, outer: str) -> DataFrame:
    """Per key, the outer fold over pieces of the inner fold of a value; a key without pieces has the fold's start value."""
    per = pieces(df, keys, order, opens, closes).groupBy(*keys, "piece").agg(FOLDS[inner](value).alias("_v"))
    found = per.groupBy(*keys).agg(FOLDS[outer]("_v").alias("value"))
    return df.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("value", F.lit(EMPTY[outer])).cast("long").alias("value"))


def split(df: DataFrame, keys: list[str], order: list[str], until: Column, first: tuple[Column, str, str], second: tuple[Column, str, str], agg: str) -> DataFrame:
    """Per key, agg of two folds: of the packets up to the first one with `until`, and of the rest. A part is (which packets, value,
    fold); a part without packets has its fold's start value, and a key that is never split is undefined (null)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_rest", F.coalesce(F.max(until.cast("int")).over(w), F.lit(0)) == 1).withColumn("_until", until)
    fold = lambda part, here: F.coalesce(FOLDS[part[2]](F.when(here & part[0], F.col(part[1]))), F.lit(EMPTY[part[2]]))
    both = rows.groupBy(*keys).agg(fold(first, ~F.col("_rest")).alias("_a"), fold(second, F.col("_rest")).alias("_b"), F.max("_until").alias("_split"))
    joined = {"sum": F.col("_a") + F.col("_b"), "max": F.greatest("_a", "_b"), "min": F.least("_a", "_b")}[agg]
    return both.select(*keys, F.when(F.col("_split"), joined).cast("long").alias("value"))


def agg_over(df: DataFrame, outer: list[str], op: str, value: str = "value") -> DataFrame:
    """The fold over the parameters that aren't in `outer`; undefined (null) as soon as one of them is."""
    return df.groupBy(*outer).agg(F.when(F.count(value) == F.count(F.lit(1)), FOLDS[op](value)).alias(value))


def while_open(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """The packets that a stateful filter lets through: those whose key's last opening or closing packet before was an opening one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(opens, F.lit(True)).when(closes, F.lit(False)), ignorenulls=True).over(w)
    return df.withColumn("_open", last).where("_open").drop("_open")


def shared_counts(df: DataFrame, keys: list[str], order: list[str], concerns_all: Column) -> DataFrame:
    """Per key, how many packets that concern every key came before its first packet (which its state starts with) and in all.
    A count over the whole stream takes the place of sending those packets to every key."""
    counted = in_order(df, order, concerns_all.cast("int"), "_all").drop("_p")
    total = F.broadcast(counted.agg(F.max("_all").alias("in_all")))
    first = counted.groupBy(*keys).agg(F.min_by(F.col("_all") - F.when(concerns_all, 1).otherwise(0), F.struct(*order)).alias("at_start"))
    return first.join(total).select(*keys, "at_start", "in_all")


def bounds(df: DataFrame, keys: list[str], order: list[str], may_be: Column, weight: list[int], pattern: Pattern, symbols: str) -> DataFrame:
    """Per key the least and greatest sum of symbol weights over all readings of its packets that match: `may_be` is the array of
    symbol numbers that a packet can be, of which an unknown predicate leaves several. Null where no reading matches."""
    table, accepting = automaton(pattern, symbols)
    n, k = len(table), len(symbols)
    flat, weights = F.array(*(F.lit(x) for row in table for x in row)), F.array(*(F.lit(int(x)).cast("long") for x in weight))
    none = F.lit(None).cast("struct<lo:bigint,hi:bigint>")
    start = F.array(*(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")) if s == 0 else none for s in range(n)))

    def step(acc: Column, p: Column) -> Column:
        reached = F.flatten(F.transform(p["_codes"], lambda c: F.transform(acc, lambda b, s: F.struct(F.get(flat, s * k + c).alias("to"), (b["lo"] + F.get(weights, c)).alias("lo"), (b["hi"] + F.get(weights, c)).alias("hi")))))
        alive = F.filter(reached, lambda r: r["lo"].isNotNull())
        into = lambda t: F.filter(alive, lambda r: r["to"] == t)
        merged = lambda t: F.when(F.size(into(t)) > 0, F.struct(F.array_min(F.transform(into(t), lambda r: r["lo"])).alias("lo"), F.array_max(F.transform(into(t), lambda r: r["hi"])).alias("hi")))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), merged)

    rows = df.select(*keys, F.struct(*order, may_be.alias("_codes")).alias("_row")).groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    ends = F.filter(F.transform(F.aggregate("_rows", start, step), lambda b, s: F.when(F.get(F.array(*(F.lit(a) for a in accepting)), s), b)), lambda b: b.isNotNull())
    return rows.select(*keys, ends.alias("_ends")).select(*keys, F.array_min(F.transform("_ends", lambda b: b["lo"])).alias("lower"), F.array_max(F.transform("_ends", lambda b: b["hi"])).alias("upper"))
