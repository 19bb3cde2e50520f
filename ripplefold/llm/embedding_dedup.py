"""Operator 8, exact embedding near-duplicates by cover-tree dual traversal.

Equal vectors are one class from the start, so that copies cost nothing further. The upper nodes of the
tree are pivots from a bounded sample; every class goes to its nearest pivot, and the greatest distance
found there is the node's covering radius. Nodes are cut into blocks of bounded size, and pairs of blocks
whose radii rule out a link are pruned. Each remaining pair of blocks is one task: cover trees with
halving radii on both sides and a dual traversal that is exact; where radii can't part rows any more, their
products are taken in one go.

Contract: cosines in double precision; a link needs a cosine of at least the threshold. Vectors that are
null, zero, or hold null or non-finite components link with nothing (n_links 0, their own component,
kept). Vectors link only with others of their length. Rows with the same vec_id count as different
vectors, and equal rows link. A null vec_id takes part and is never a component's id while another id is
there. Two unequal vectors of one 64-bit hash would be taken for equal. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import Forest, components, written
from ripplefold.llm.cover_tree import SLACK, away, link_near

BLOCK = 12_288
SAMPLE = 1024
PIVOTS = 256


def unit(column: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x  # neither very large nor very small ones leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the one farthest from those before it."""
    chosen, far = [0], away(sample, sample[0])
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, away(sample, sample[chosen[-1]]))
    return sample[chosen]


def _nearest(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            cell, far = np.zeros(len(batch), np.int64), np.full(len(batch), 2.0)
            for n in np.unique(length).tolist():
                if n in pivots:
                    mine = np.flatnonzero(length == n)
                    x = unit(batch.column("embedding").take(pa.array(mine)))
                    cell[mine] = (x @ pivots[n].T).argmax(1)
                    far[mine] = away(x, pivots[n][cell[mine]])
            yield pa.RecordBatch.from_arrays([batch.column("length"), batch.column("name"), batch.column("m"), pa.array(cell), pa.array(far), batch.column("embedding")], ["length", "name", "m", "cell", "away", "embedding"])

    return run


def _partners(pivots: dict[int, np.ndarray], blocks: dict[int, tuple], chord: float):
    """For each block, the pairs with the blocks of its length from it on that can hold a link."""

    def run(batches):
        for batch in batches:
            block, a, b = [], [], []
            for length, name, cell, radius in zip(*(batch.column(c).to_pylist() for c in ("length", "block", "cell", "radius"))):
                names, cells, radii = blocks[length]
                may = names >= name
                if length in pivots:
                    may &= away(pivots[length][cells], pivots[length][cell]) <= chord + SLACK + radius + radii
                for other in names[may].tolist():
                    for one in {name, other}:
                        block.append(one)
                        a.append(name)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block, a, b)], ["block", "a", "b"])

    return run


FOUND = "u long, v long, n long"


def _join_pair(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, name, m = (table.column(c).to_numpy() for c in ("block", "name", "m"))
        exact = unit(table.column("embedding").combine_chunks())
        sides = [np.flatnonzero(block == b) for b in np.unique(block)]
        same, a, b = len(sides) == 1, sides[0], sides[-1]
        forest = Forest()
        n_a, n_b = link_near(exact[a], exact[b], same, least, m[a], m[b], name[a].tolist(), name[b].tolist(), forest)
        u, v = forest.stars()
        rows, counts = (name[a], n_a) if same else (np.concatenate([name[a], name[b]]), np.concatenate([n_a, n_b]))
        had = counts > 0
        return pa.table({"u": pa.array([*u, *rows[had].tolist()], pa.int64()), "v": pa.array([*v, *([None] * int(had.sum()))], pa.int64()), "n": pa.array([*([None] * len(u)), *counts[had].tolist()], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.coalesce(F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(as_double, lambda x: x != 0), F.lit(False))
    name = F.when(fit, F.xxhash64("embedding"))
    rows = vectors.select("vec_id", name.alias("name"))
    kind = dict(vectors.dtypes)["embedding"]
    classes = vectors.where(fit).select(name.alias("name"), F.size("embedding").cast("long").alias("length"), "embedding").groupBy("name", "length").agg(F.first("embedding").alias("embedding"), F.count("*").alias("m"))
    classes = written(classes.select("length", "name", "m", "embedding"))
    sizes = classes.groupBy("length").agg(F.count("*").alias("classes"))
    many = {r["length"]: r["classes"] for r in sizes.where(F.col("classes") > BLOCK).collect()}  # one row for each BLOCK vectors at most
    pivots = {}
    for length, n in many.items():
        few = classes.where((F.col("length") == length) & (F.pmod(F.xxhash64("name"), F.lit(max(1, n // SAMPLE))) == 0)).select("embedding").limit(2 * SAMPLE).toArrow()
        pivots[length] = pivots_of(unit(few.column("embedding").combine_chunks()), min(PIVOTS, -(-n // BLOCK)))
    placed = written(classes.mapInArrow(_nearest(pivots), f"length long, name long, m long, cell long, away double, embedding {kind}"))
    cells = placed.groupBy("length", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = cells.select("length", "cell", "radius", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = written(blocks.withColumn("block", F.xxhash64("length", "cell", "part")))
    listed: dict[int, list] = {}
    for r in blocks.where(F.col("length").isin(list(many))).select("length", "block", "cell", "radius").toLocalIterator():  # one row for each BLOCK vectors
        listed.setdefault(r["length"], []).append((r["block"], r["cell"], r["radius"]))
    by_length = {n: (np.array([x[0] for x in found]), np.array([x[1] for x in found]), np.array([x[2] for x in found])) for n, found in listed.items()}
    chord = float(np.sqrt(2 - 2 * least))
    alone = blocks.where(~F.col("length").isin(list(many))).select("block", F.col("block").alias("a"), F.col("block").alias("b"))
    pairs = blocks.where(F.col("length").isin(list(many))).select("length", "block", "cell", "radius").mapInArrow(_partners(pivots, by_length, chord), "block long, a long, b long")
    member = placed.join(cells.select("length", "cell", "parts"), ["length", "cell"]).withColumn("block", F.xxhash64("length", "cell", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")))
    links = member.select("block", "name", "m", "embedding").join(alone.unionByName(pairs), "block").groupBy("a", "b").applyInArrow(_join_pair(least), FOUND)
    found = written(links)
    label = components(found.where("v is not null").select("u", "v"))
    linked = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("others"))
    counts = classes.select("name", "m").join(linked, F.col("name") == F.col("u"), "left").join(label, F.col("name") == F.col("node"), "left")
    counts = written(counts.select("name", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "name").alias("component")))
    # the least id of each component from the least of each class; a component of rows without ids has none
    least_of = rows.where("name is not null").groupBy("name").agg(F.min("vec_id").alias("vec_id"))
    ids = counts.join(least_of, "name").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    final = written(counts.join(ids, "component").select("name", "n_links", "component_id"))
    good = rows.where("name is not null").join(final, "name").select("vec_id", "n_links", "component_id")
    bad = rows.where("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
