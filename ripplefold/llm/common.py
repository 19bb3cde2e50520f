"""Shared helpers: written tables that cut lineage, packed arrays, held-out splits and component labels."""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import threading
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can read: spark.checkpoint.dir. Only where the master is local and the
    setting is missing (as in tests) does a machine's own temporary folder take its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Made(threading.local):
    """The tables that this thread has written and not removed since; a query of another thread keeps its own."""

    def __init__(self) -> None:
        self.paths: set[str] = set()


MADE = _Made()


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, so a lost executor costs no
    recomputation. Row groups are small, as each writing task holds one in memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    MADE.paths.add(path)
    return table


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        MADE.paths.discard(name)


def forget(*tables: DataFrame) -> None:
    """removed() by the tables themselves."""
    for table in tables:
        removed(table.sparkSession, table.written_to)


def settled(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of the steps that are written by now: it does so for plans that the driver's JVM has
    collected, which may otherwise be long after."""
    gc.collect()
    spark._jvm.System.gc()


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id has no remainder and counts as 1 (so: a training row)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(1))


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def buckets_for(texts: DataFrame, column: str, chars_per_bucket: int) -> int:
    """So many hash buckets that each gets about chars_per_bucket characters of the input; reads one column once."""
    total = texts.agg(F.sum(F.length(column)).alias("chars")).first()["chars"] or 0
    return max(4, -(-int(total) // chars_per_bucket))


class Forest:
    """Union-find over 64-bit node names."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        """One (node, root) link for every node that isn't its own root."""
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


LINKS = "u long, v long"
LINKS_PER_TASK = 500_000


def _local_stars(batches):
    """Replaces the links of one task by the stars of its own components; the components stay the same."""
    import pyarrow as pa

    forest = Forest()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(x, y)
        if len(forest.up) > 1_000_000:
            nodes, roots = forest.stars()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])
            forest = Forest()
    nodes, roots = forest.stars()
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])


def components(links: DataFrame, stars: bool = False) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    Tasks of about LINKS_PER_TASK links reduce theirs to stars; what one such task holds is then settled. Otherwise
    large-star and small-star steps alternate until the links no longer change. Minima are partial aggregates and
    are written before they are joined, so that the joins are broadcast while they are small and AQE can split a node
    with very many links when they are large. With `stars`, each task's links are stars already. Nodes without links aren't returned; an empty input gives an empty table.
    """
    links = links.where("u <> v").select("u", "v")
    found = written((links if stars else links.mapInArrow(_local_stars, LINKS)).distinct())
    n_tasks = -(-found.count() // LINKS_PER_TASK)
    given, found = found, written(found.coalesce(max(1, n_tasks)).mapInArrow(_local_stars, LINKS))
    forget(given)
    before = None
    while n_tasks > 1:  # large-star and small-star steps settle after about the square of the links' logarithm
        both = found.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(found.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node that is its own minimum must keep the link to itself out of the way: b > a >= m holds above
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        stars = small.where("b > m").select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
        old, found = found, written(stars.distinct())
        forget(old, low, least)
        now = found.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    label = found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = written(label.unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    forget(found)
    return out
