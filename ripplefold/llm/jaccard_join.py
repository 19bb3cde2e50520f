"""Operator 3, n-gram Jaccard join on count vectors.

A text's set holds its distinct word shingles, hashed to 64 bits. Texts with the same set are one class
from the start, so that copies cost nothing further. Candidates: a set is divided by hash into so many
segments that two sets with enough overlap must agree exactly in one of them (at most D items differ
between two such sets, and there are more than D segments). Segments are counted over all classes, and of
its segments a set keeps the D + 1 rarest: in that order, the same for all sets, the rarest segment that
two linked sets share stays on either side, while passages that many texts quote hardly ever do. Classes
that share a kept segment form candidate groups.

Within a candidate group a count-vector R-tree (see count_tree) bounds overlaps by summed minima and
verifies the surviving pairs. A group of more than LEAF classes is cut into leaves, which are joined in
themselves and with a few pivots of the group first; what the pivots gather, such as many variants of one
text, is one component after that linear step. Only leaves that aren't yet in one component are then
compared with each other, by the bound alone at first, and with their sets where the bound leaves pairs.

Contract: no link between different texts is lost and none below the threshold is made, up to collisions
of 64-bit hashes. Null and empty texts, or texts of white space, have an empty set and are linked with
nothing; their component_id is their own doc_id. A null doc_id takes part and carries no id: it never
is a component_id while its component has another id. Repeated rows give repeated results. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplefold.llm.common import LINKS, Forest, buckets_for, components, forget, packed, unpacked, written
from ripplefold.llm.count_tree import GROUPS, count_vector, link_sets
from ripplefold.llm.words import Block, mixed, starts_of, text_blocks

KEYS = "bucket int, doc_id long, node long, n long, blob binary"
BUCKETED = "bucket int, blob binary"
LEAF = 1024
PIVOTS = 4
BROADCAST_ROWS = 2_000_000
TASK_ITEMS = 500_000


def shingle_sets(block: Block, width: int) -> list[np.ndarray]:
    """Per text, its sorted distinct shingle hashes; a shorter text is one shingle, one without words none."""
    hashed, at = block.hashes(), starts_of(block.counts)
    run = hashed
    for i in range(1, width):
        run = mixed(run[: max(0, len(hashed) - i)], hashed[i:])
    out = []
    for a, n in zip(at.tolist(), block.counts.tolist()):
        if n >= width:
            out.append(np.unique(run[a : a + n - width + 1]))
        elif n:
            whole = hashed[a : a + 1]
            for i in range(1, n):
                whole = mixed(whole, hashed[a + i : a + i + 1])
            out.append(mixed(whole, np.uint64(1000 + n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def tiers(num: int, den: int):
    """(least size, most size, most items that differ, segments) of each size tier that can have links."""
    least = -(-num // (den - num))
    while True:
        most = max(least, int(least * 1.5))
        differ = 2 * most * (den - num) // (den + num)
        yield least, most, differ, (differ + 1) * 7 // 5 + 2
        least = most + 1


def segment_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, ...]:
    """(key, its unit) for all sets; (set, size tier, spare) for all units. A unit is a set in one of its size tiers, with a key for
    each filled segment, and spare is how many of them may be left out. A set with few filled segments gets keys for
    empty ones too, in a fixed order, which end in a 1: they rank behind all others."""
    sizes = np.array([len(x) for x in sets], np.int64)
    keys, unit, owner, tier, spare, n_units = [], [], [], [], [], 0
    for number, (least, most, differ, segments) in enumerate(tiers(num, den)):
        if least > sizes.max(initial=0) * den // num:
            break
        own = np.flatnonzero((sizes * den >= least * num) & (sizes <= most) & (sizes >= 1))
        if not len(own):
            continue
        items = np.concatenate([sets[i] for i in own])
        cell = np.repeat(np.arange(len(own)), sizes[own]) * segments + ((mixed(items, np.uint64(5)) >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mixed(items[order], np.uint64(9)), first)
        cell = cell[first]
        filled = np.bincount(cell // segments, minlength=len(own))
        name = lambda content, cell: mixed(content, (cell % segments).astype(np.uint64) + np.uint64(number << 32)) & ~np.uint64(1)  # noqa: E731, B023
        keys.append(name(content, cell))
        unit.append(cell // segments + n_units)
        for i in np.flatnonzero(filled <= differ).tolist():  # few and small sets
            empty = np.setdiff1d(np.arange(segments), cell[cell // segments == i] % segments)[: differ + 1 - filled[i]]
            keys.append(name(np.zeros(len(empty), np.uint64), empty) | np.uint64(1))
            unit.append(np.full(len(empty), n_units + i))
        owner.append(own)
        tier.append(np.full(len(own), number))
        spare.append(np.maximum(filled - differ - 1, 0))
        n_units += len(own)
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in (keys, unit, owner, tier, spare)) if keys else (none.astype(np.uint64), none, none, none, none)


def key_bucket(keys: np.ndarray, tier_of: np.ndarray, n: int) -> np.ndarray:
    """A set's keys of one tier go to a few buckets only, so that its name need not travel with each of them."""
    return (tier_of * 7919 + (keys >> np.uint64(20)).astype(np.int64) % max(1, n // 8)) % n


def by_bucket(at: np.ndarray, n: int):
    """(bucket, the places with it in ascending order) for each bucket that has some."""
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(n + 1))
    return ((b, order[cuts[b] : cuts[b + 1]]) for b in range(n) if cuts[b] < cuts[b + 1])


def bucketed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])


def _sets_and_keys(width: int, num: int, den: int, n_buckets: int, flush_items: int = 600_000):
    def flush(nodes: dict[int, np.ndarray], docs: list, number: int):
        names = np.array(list(nodes), np.int64)
        keys, unit, owner, tier, spare = segment_keys(list(nodes.values()), num, den)
        at = key_bucket(keys, tier[unit], n_buckets)
        rows = [(number % n_buckets, None, packed(*docs))]
        for b, mine in by_bucket(at, n_buckets):
            mine = mine[np.argsort(unit[mine], kind="stable")]
            who, local = np.unique(unit[mine], return_inverse=True)
            rows.append((b, True, packed(keys[mine], local.astype(np.uint32), names[owner[who]], tier[who].astype(np.uint8), spare[who].astype(np.uint32))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "blob"])

    def run(batches):
        nodes, size, seen, ids, names, sizes = {}, 0, set(), [], [], []
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) * 31
        for batch, block in text_blocks(batches, 1_500_000):
            ids.append(np.array(batch.column("doc_id").to_pylist(), object))
            for items in shingle_sets(block, width):
                name = node_of(items)
                names.append(name)
                sizes.append(len(items))
                if len(items) and name not in seen:
                    seen.add(name)
                    nodes[name] = items
                    size += len(items)
            if size >= flush_items:
                yield flush(nodes, [np.concatenate(ids), np.array(names, np.int64), np.array(sizes, np.int64)], number)
                nodes, size, ids, names, sizes, number = {}, 0, [], [], [], number + 1
        if names:
            yield flush(nodes, [np.concatenate(ids), np.array(names, np.int64), np.array(sizes, np.int64)], number)

    return run


def _shared(n_buckets: int):
    """One bucket of keys: those of two or more classes, with how many have them, by the hash of the class; and the documents of a part."""

    def run(table: pa.Table) -> pa.Table:
        out, keys, unit, units, known = [], [], [], [], 0
        for is_keys, blob in zip(table.column("keys").to_pylist(), table.column("blob").to_pylist()):
            if not is_keys:
                ids, nodes, sizes = unpacked(blob)
                out.append(pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int32()), pa.array(ids.tolist(), pa.int64()), pa.array(nodes), pa.array(sizes), pa.nulls(len(ids), pa.binary())], ["bucket", "doc_id", "node", "n", "blob"]))
                continue
            k, local, *own = unpacked(blob)
            keys.append(k)
            unit.append(local.astype(np.int64) + known)
            units.append(own)
            known += len(own[0])
        rows = []
        if keys:
            keys, unit = np.concatenate(keys), np.concatenate(unit)
            names, tier, spare = (np.concatenate(x) for x in zip(*units))
            order = np.lexsort((names[unit], keys))
            keys, unit = keys[order], unit[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (names[unit[1:]] != names[unit[:-1]])  # a copy from another part adds nothing
            keys, unit = keys[fresh], unit[fresh]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times = np.diff(np.append(first, len(keys)))
            times = np.repeat(times, times)
            keys, unit, times = keys[times > 1], unit[times > 1], times[times > 1]
            for b, mine in by_bucket((names[unit].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                mine = mine[np.argsort(unit[mine], kind="stable")]
                rows.append((b, packed(keys[mine], times[mine].astype(np.uint32), names[unit[mine]], tier[unit[mine]], spare[unit[mine]])))
        blobs = bucketed(rows)
        n = len(blobs)
        out.append(pa.RecordBatch.from_arrays([blobs.column(0), *(pa.nulls(n, pa.int64()) for _ in range(3)), blobs.column(1)], ["bucket", "doc_id", "node", "n", "blob"]))
        return pa.Table.from_batches(out)

    return run


def _kept(n_buckets: int):
    """One bucket of classes: of each unit's shared keys the rarest, so many that with those it shares with nobody all but `spare` are kept."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(blob) for blob in table.column("blob").to_pylist()]
        keys, times, names, tier, spare = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((keys, times, keys & np.uint64(1), tier, names))
        keys, names, tier, spare = keys[order], names[order], tier[order], spare[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (tier[1:] != tier[:-1])]))
        held = np.diff(np.append(first, len(keys)))
        place = np.arange(len(keys)) - np.repeat(first, held)
        take = place < np.repeat(held, held) - spare
        keys, names = keys[take], names[take]
        return pa.Table.from_batches([bucketed([(b, packed(keys[mine], names[mine])) for b, mine in by_bucket(((keys >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64), n_buckets)])])

    return run


def _chains(table: pa.Table) -> pa.Table:
    """Stars over all classes of a bucket that share a kept segment, directly or through others."""
    parts = [unpacked(blob) for blob in table.column("blob").to_pylist()]
    keys, nodes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    same = np.flatnonzero((keys[1:] == keys[:-1]) & (nodes[1:] != nodes[:-1]))
    links = np.unique(np.stack([nodes[same], nodes[same + 1]], 1), axis=0)
    forest = Forest()
    for a, b in links.tolist():
        forest.join(a, b)
    u, v = forest.stars()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _with_node(width: int):
    def run(batches):
        for batch, block in text_blocks(batches, 1_500_000):
            names = [node_of(x) for x in shingle_sets(block, width)]
            yield pa.RecordBatch.from_arrays([batch.column("text").cast(pa.string()), pa.array(names, pa.int64())], ["text", "node"])

    return run


def _members(width: int):
    """The count vector and the set of each representative text that the join has brought in."""

    def run(batches):
        seen = set()  # repeated rows come once a task
        for batch, block in text_blocks(batches, 1_500_000):
            want, keep, blobs, vectors = batch.column("node").to_pylist(), [], [], []
            for i, items in enumerate(shingle_sets(block, width)):
                if node_of(items) == want[i] and want[i] not in seen:
                    seen.add(want[i])
                    keep.append(i)
                    blobs.append(items.tobytes())
                    vectors.append(count_vector(items).tobytes())
            rest = batch.select([c for c in batch.schema.names if c != "text"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(vectors, pa.binary()), pa.array(blobs, pa.binary())], [*rest.schema.names, "vector", "items"])

    return run


def _join_block(num: int, den: int, verify: bool):
    """Links among the members of one task: whole small groups, a leaf of a large one with its group's pivots, or two leaves.
    Members with one label are one component already. Without verify the overlap bound alone decides, and no sets are needed."""

    def run(table: pa.Table) -> pa.Table:
        group, leaf, node, size, label = (table.column(c).to_numpy() for c in ("grp", "leaf", "node", "n", "label"))
        vectors = np.array([np.frombuffer(x, np.int32) for x in table.column("vector").to_pylist()])
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()] if verify else None
        order = np.lexsort((node, group))
        forest = Forest()
        for mine in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            mine = mine[np.unique(node[mine], return_index=True)[1]]
            sets = [items[i] for i in mine] if verify else None
            sides = leaf[mine] if len(set(leaf[mine].tolist())) == 2 else None
            link_sets(label[mine].tolist(), size[mine], vectors[mine], sets, num, den, forest, sides)
        u, v = forest.stars()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members, whose `label` becomes that of its component under links between labels; those without links keep theirs."""
    found = components(links).select(F.col("node").alias("_from"), "component")
    return members.join(found, F.col("label") == F.col("_from"), "left").withColumn("label", F.coalesce("component", "label")).drop("_from", "component")


def _large(members: DataFrame) -> DataFrame:
    """grp, for groups of more than LEAF members."""
    return members.groupBy("grp").agg(F.count("*").alias("in_group")).where(F.col("in_group") > LEAF).select("grp")


def _leaves(members: DataFrame) -> DataFrame:
    """Members of large groups with their leaf: a size band's members of one frequent label, or of all others, cut by hash."""
    counts = members.groupBy("grp", "band", "label").agg(F.count("*").alias("c")).withColumn("own", F.when(F.col("c") > LEAF, F.col("label")))
    parts = counts.groupBy("grp", "band", "own").agg(F.ceil(F.sum("c") / LEAF).cast("int").alias("parts"))
    owned = members.join(counts.where("own is not null").select("grp", "band", "label", "own"), ["grp", "band", "label"], "left")
    same = (owned["grp"] == parts["grp"]) & (owned["band"] == parts["band"]) & owned["own"].eqNullSafe(parts["own"])
    placed = owned.join(parts.select("grp", "band", "own", "parts"), same).select(*(owned[c] for c in members.columns), owned["own"], "parts")
    return placed.withColumn("leaf", F.xxhash64("grp", "band", "own", F.pmod(F.xxhash64("node"), F.col("parts")))).drop("parts")


def _leaf_pairs(placed: DataFrame) -> DataFrame:
    """leaf, task for each two leaves of a group, or one with itself, whose size bands can hold a link and that aren't one component."""
    leaves = written(placed.select("grp", "band", "own", "leaf").distinct())
    other = leaves.select("grp", F.col("band").alias("band2"), F.col("own").alias("own2"), F.col("leaf").alias("leaf2"))
    pairs = leaves.join(other, "grp").where("abs(band - band2) <= 1 and leaf <= leaf2 and not coalesce(own = own2, false)").withColumn("task", F.xxhash64("leaf", "leaf2"))
    return pairs.select("leaf", "task").unionByName(pairs.where("leaf <> leaf2").select(F.col("leaf2").alias("leaf"), "task"))


def _small_tasks(members: DataFrame) -> DataFrame:
    """Whole groups share tasks, as many as keep about TASK_ITEMS items in each."""
    items = members.agg(F.sum(F.col("n") + GROUPS).alias("items")).first()["items"] or 0
    n_tasks = max(4 * members.sparkSession.sparkContext.defaultParallelism + 4, -(-int(items) // TASK_ITEMS))
    return members.withColumn("leaf", F.lit(0).cast("long")).withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(n_tasks)))


def _component_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links (of labels, which start as nodes) that connect all members connected by links within their groups.
    members: node, grp, n, band, vector, items."""
    names = written(members.select("node", "grp", "n", "band", F.col("node").alias("label")).dropDuplicates(["node"]))
    big = written(_large(names))
    task_columns = ["task", "leaf", "node", "grp", "n", "label"]

    def joined(dealt: DataFrame, verify: bool) -> DataFrame:
        """Links of tasks, which are dealt on names alone, so that vectors and sets travel once, straight to their task."""
        dealt = written(dealt.select(*task_columns))
        side = F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt
        placed = members.select("node", "vector", *(["items"] if verify else [])).join(side, "node")
        links = written(placed.groupBy("task").applyInArrow(_join_block(num, den, verify), LINKS))
        forget(dealt)
        return links

    whole = joined(_small_tasks(names.join(big, "grp", "left_anti")), True)
    if big.isEmpty():
        return whole
    # large groups: leaves in themselves and with pivots, which is linear in the group
    apart = names.join(big, "grp", "left_semi")
    placed = written(_leaves(apart).select("node", "grp", "n", "band", "label", "leaf"))
    nth = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("node"), "node"))
    few = placed.withColumn("_i", nth).where(F.col("_i") <= PIVOTS).withColumn("_i", F.row_number().over(Window.partitionBy("grp", "band").orderBy(F.xxhash64("node"), "node")))
    pivots = few.where(F.col("_i") <= PIVOTS).select("node", "grp", "n", "label", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    leaves = placed.select("grp", "band", F.col("leaf").alias("task")).distinct()
    dealt = placed.withColumn("task", F.col("leaf")).select(*task_columns).unionByName(
        pivots.join(leaves, ["grp", "band"]).withColumn("leaf", F.col("task")).select(*task_columns)
    )
    first = joined(dealt, True)
    apart = written(_labelled(apart, first))
    # groups that aren't one component yet: the bound tells which labels may still be linked, on vectors alone
    several = apart.groupBy("grp").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("grp")
    apart = written(apart.join(several, "grp", "left_semi"))
    placed = written(_leaves(apart))
    bound = joined(placed.join(_leaf_pairs(placed), "leaf"), False)
    finer = components(bound).select(F.col("node").alias("_label"), F.col("component").alias("_finer"))
    rest = written(apart.join(finer, F.col("label") == F.col("_label")).withColumn("grp", F.col("_finer")).select(*apart.columns))
    forget(placed, bound)
    big = written(_large(rest))
    last = joined(_small_tasks(rest.join(big, "grp", "left_anti")), True)
    placed = written(_leaves(rest.join(big, "grp", "left_semi")))
    return whole.unionByName(first).unionByName(last).unionByName(joined(placed.join(_leaf_pairs(placed), "leaf"), True))


def join_documents(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, chars_per_bucket: int = 8_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; two link when den * intersection >= num * union."""
    texts = docs.select("doc_id", "text")
    n_buckets = buckets_for(texts, "text", chars_per_bucket)
    by = lambda df: df.repartition(n_buckets, "bucket").groupBy("bucket")
    gathered = written(by(texts.mapInArrow(_sets_and_keys(width, num, den, n_buckets), "bucket int, keys boolean, blob binary")).applyInArrow(_shared(n_buckets), KEYS))
    sets = gathered.where("bucket is null").select("doc_id", "node", "n")
    kept = by(gathered.where("bucket is not null").select("bucket", "blob")).applyInArrow(_kept(n_buckets), BUCKETED)
    groups = components(by(kept).applyInArrow(_chains, LINKS), stars=True).withColumnRenamed("component", "grp")

    # one text for each class that has a candidate
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    classes = written(sets.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("rep")))  # copies are one row before any join
    chosen = written(classes.join(groups, "node").select("node", "grp", "n", "rep").withColumn("band", band))
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    own = texts.join(side.where("rep is not null"), F.col("doc_id") == F.col("rep")).select("text", "node", "grp", "n", "band")
    if not chosen.where("rep is null").isEmpty():
        # classes that only rows without an id are of: those rows find theirs by the hash of the set
        alone = texts.where("doc_id is null").mapInArrow(_with_node(width), "text string, node long").join(chosen.where("rep is null"), "node")
        own = written(own.unionByName(alone.select(*own.columns)))
    members = written(own.mapInArrow(_members(width), "node long, grp long, n long, band int, vector binary, items binary"))
    links = _component_links(members, num, den)

    named = classes.join(components(links), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(named.join(least, "component").select("node", "component_id"))
    forget(members, chosen, classes)
    side = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    out = sets.where("n > 0").join(side, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
