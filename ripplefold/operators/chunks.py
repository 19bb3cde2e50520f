"""Values over patterns for keys of any length: rows in key order over range partitions, summed up chunk by chunk.

Each task goes through its sorted rows a batch at a time and cuts every key's rows into chunks of at most CHUNK,
which are read side by side; their summaries are composed in pairs. A key that lies within a task is done there. Of a task's
first and last key only the summaries go on, at most two rows a task, and are composed in the tasks' order. So
no array holds more rows than an Arrow batch, however many one key has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from ripplefold.operators.joins import numbered
from ripplefold.operators.patterns import Pattern, automaton
from ripplefold.operators.registers import Machine, Summary, Value, composed, from_table, iterate, machine, of_nothing, read, split, values, when
from ripplefold.sources.stored import stored

CHUNK = 128
BLOCK = 1 << 14
AROUND, SPAN, PACKET = range(3)  # kinds of rows that a block's task reads


def changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; nulls are equal. The first row counts as one."""
    out = np.zeros(len(batch), bool)
    out[:1] = True
    for k in keys:
        a, b = batch.column(k).slice(0, len(batch) - 1), batch.column(k).slice(1)
        out[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def key_of(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def read_all(m: Machine, now: Summary, first: np.ndarray, lengths: np.ndarray, may_be: np.ndarray, weight: np.ndarray) -> Summary:
    """Chunk i reads the rows from first[i] on, lengths[i] of them; all chunks take their next row together."""
    order = np.argsort(-lengths, kind="stable")
    now, first, lengths = now[order], first[order], lengths[order]
    for step in range(int(lengths.max(initial=0))):
        here = slice(0, int(np.searchsorted(-lengths, -step)))
        now[here] = read(m, now[here], may_be[first[here] + step], weight[first[here] + step])
    return now[np.argsort(order)]


def composed_by(m: Machine, run: np.ndarray, parts: Summary) -> Summary:
    """The summaries of each run, which stand together, composed in pairs until one is left for each."""
    while len(run) > 1 and (run[1:] == run[:-1]).any():
        begins = np.append(True, run[1:] != run[:-1])
        place = np.arange(len(run)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        left = np.flatnonzero(place % 2 == 0)
        paired = np.append(run[1:] == run[:-1], False)[left]
        both = composed(m, parts[left[paired]], parts[left[paired] + 1])
        out = parts[left]
        out[paired] = both
        run, parts = run[left], out
    return parts


def _summed(keys: list[str], value: Value, n_symbols: int, chunk: int):
    """Sorted rows to one row for each key of the task: its value, or a summary where the key may go on in another task."""

    def run(batches):
        m = machine(value, n_symbols)
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # the last key so far: its keys as a row, its summary, and whether it is the task's first
        for batch in batches:
            if not len(batch):
                continue
            may_be, weight = batch.column("_may").to_numpy(), batch.column("_weight").to_numpy()
            given = pc.is_valid(batch.column("_summary")).to_numpy(zero_copy_only=False) if "_summary" in batch.schema.names else np.zeros(len(batch), bool)
            begins = changes(batch, keys)
            goes_on = held is not None and key_of(batch, keys, 0) == key_of(held[0], keys, 0)
            run_of = np.cumsum(begins) - 1
            # a chunk begins with its key, around rows that are summaries already, and after so many rows
            cut = begins | given
            cut[1:] |= given[:-1]
            place = np.arange(len(batch)) - np.flatnonzero(cut)[np.cumsum(cut) - 1]
            first = np.flatnonzero(cut | (place % chunk == 0))
            lengths = np.diff(np.append(first, len(batch)))
            opens = begins[first]
            if goes_on:
                opens[0] = False
            unknown = held is None  # whether the task's first key begins here
            parts = []
            for kind, mine in (("start", opens & ~given[first]), ("any", ~opens & ~given[first])):
                mine = np.flatnonzero(mine)
                if kind == "start" and unknown and len(mine) and mine[0] == 0:
                    mine = mine[1:]
                    parts.append(("first", read_all(m, Summary.unread(m, 1, list(range(m.start + 1))), first[:1], lengths[:1], may_be, weight), np.array([0])))
                states = [m.start] if kind == "start" else list(range(m.start))
                if len(mine):
                    parts.append((kind, read_all(m, Summary.unread(m, len(mine), states), first[mine], lengths[mine], may_be, weight), mine))
            for kind, mine in (("start", opens & given[first]), ("any", ~opens & given[first])):
                mine = np.flatnonzero(mine)
                if len(mine):
                    found = Summary.unpacked(m, batch.column("_summary").take(pa.array(first[mine])))
                    if kind == "start" and unknown and mine[0] == 0:
                        parts.append(("first", found[:1], mine[:1]))
                        found, mine = found[1:], mine[1:]
                    parts.append((kind, found.only(m, kind == "start"), mine))
            heads = [(run_of[first[mine]], s) for kind, s, mine in parts if kind != "any"] + ([(np.array([0]), held[1])] if goes_on else [])
            own = Summary.of([s for _, s in heads])[np.argsort(np.concatenate([r for r, _ in heads]))]
            rest = [(mine, s) for kind, s, mine in parts if kind == "any"]
            if rest:
                where = np.concatenate([mine for mine, _ in rest])
                order = np.argsort(where)
                owner = run_of[first[where[order]]]
                tails, at = composed_by(m, owner, Summary.of([s for _, s in rest])[order]), np.unique(owner)
                own[at] = composed(m, own[at], tails)
            at, rows = np.flatnonzero(begins), batch.select(keys)
            task_first = held[2] if goes_on else unknown  # of the batch's first key
            if held is not None and not goes_on:
                yield _row(held[0], keys, part, held[1].packed(m)) if held[2] else _done(held[0], held[1], keys, m)
            if task_first and len(at) > 1:
                yield _row(rows.slice(0, 1), keys, part, own[:1].packed(m))
            done = slice(int(task_first), len(at) - 1)
            if done.start < done.stop:
                yield _done(rows.take(pa.array(at[done])), own[done], keys, m)
            held = (rows.slice(int(at[-1]), 1), own[-1:], task_first and len(at) == 1)
        if held is not None:
            yield _row(held[0], keys, part, held[1].packed(m))

    return run


def _row(row: pa.RecordBatch, keys: list[str], part: int, summary: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*row.columns, pa.array([part], pa.int32()), summary, pa.array([None], pa.int64()), pa.array([None], pa.int64())], [*keys, "part", "summary", "lower", "upper"])


def _done(rows: pa.RecordBatch, whole: Summary, keys: list[str], m: Machine) -> pa.RecordBatch:
    n, (ok, low, high) = len(whole), values(m, whole)
    return pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(low, mask=~ok), pa.array(high, mask=~ok)], [*keys, "part", "summary", "lower", "upper"])


def _finished(keys: list[str], value: Value, n_symbols: int):
    """The summaries of each key, which stand together in the tasks' order, to its value."""

    def run(batches):
        m = machine(value, n_symbols)
        held = None
        for batch in batches:
            open_ = pc.is_valid(batch.column("summary")).to_numpy(zero_copy_only=False)
            if not open_.all():
                done = batch.filter(pa.array(~open_)).select([*keys, "lower", "upper"])
                yield pa.RecordBatch.from_arrays(done.columns, done.schema.names)  # all nullable, as those made below
            for i in np.flatnonzero(open_).tolist():
                row, own = batch.slice(i, 1).select([*keys, "part", "summary"]), Summary.unpacked(m, batch.column("summary").slice(i, 1))
                if held is not None and key_of(row, keys, 0) == key_of(held[0], keys, 0):
                    held = (held[0], composed(m, held[1], own.only(m, False)))
                    continue
                if held is not None:
                    yield _done(*held, keys, m).select([*keys, "lower", "upper"])
                held = (row.select(keys), own.only(m, True))
        if held is not None:
            yield _done(*held, keys, m).select([*keys, "lower", "upper"])

    return run


def over_sorted(rows: DataFrame, keys: list[str], order: list[str], value: Value, n_symbols: int) -> DataFrame:
    """keys, lower, upper from rows with _may, _weight and, where some are summaries already, _summary."""
    own = StructType([rows.schema[k] for k in keys])
    partial = StructType([*own.fields, StructField("part", IntegerType()), StructField("summary", BinaryType()), StructField("lower", LongType()), StructField("upper", LongType())])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as small partitions merged into one would be read by one task
    parts = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(_summed(keys, value, n_symbols, CHUNK), partial)
    together = parts.repartition(*keys) if keys else parts.repartition(1)  # of a task at most two rows, and those of keys that are done
    return together.sortWithinPartitions(*keys, "part").mapInArrow(_finished(keys, value, n_symbols), StructType([*own.fields, *partial.fields[-2:]]))


def bits(symbols: str, cases: dict[str, Column], other: str | None = "o") -> Column:
    """What a packet can be: a bit for each symbol whose predicate holds or is unknown, in order of `cases`, up to the first one that
    holds for sure; `other` if none does."""
    out = F.lit(1 << symbols.index(other)) if other else F.lit(0)
    for name, predicate in reversed(cases.items()):
        bit = F.lit(1 << symbols.index(name))
        out = F.when(predicate, bit).when(predicate.isNull(), out.bitwiseOR(bit)).otherwise(out)
    return out.cast("int")


def bit_of(sym: Column, symbols: str) -> Column:
    """The bit of the symbol that a packet is for sure."""
    out = F.lit(0)
    for i, s in enumerate(symbols):
        out = F.when(sym == s, 1 << i).otherwise(out)
    return out


def pattern_values(df: DataFrame, keys: list[str], order: list[str], may_be: Column, weight: Column | None, value: Value, symbols: str) -> DataFrame:
    """keys, lower, upper: the least and greatest value over all readings of each key's packets in order; null where none matches.
    may_be is made by bits(); a null weight counts as 0. Without keys, the whole table is one stream."""
    rows = df.select(*keys, *order, may_be.alias("_may"), F.coalesce(weight.cast("long"), F.lit(0)).alias("_weight") if weight is not None else F.lit(0).cast("long").alias("_weight"))
    return over_sorted(rows, keys, order, value, len(symbols))


def match_chunked(df: DataFrame, keys: list[str], order: list[str], sym: Column, pattern: Pattern, symbols: str) -> DataFrame:
    """The same as match, for keys of any length."""
    found = pattern_values(df, keys, order, bit_of(sym, symbols), None, when(pattern, symbols), symbols)
    return found.select(*keys, F.col("lower").isNotNull().alias("matched"))


def counted(pattern: Pattern, symbols: str) -> Value:
    """The number of pieces, taken one after the other, that match. Only for patterns whose piece ends as soon as it matches and, once
    begun, can't fail: a packet that begins no piece is passed over. Other patterns are refused, as the first piece from the left
    would need looking ahead."""
    table, accepting = automaton(pattern, symbols)
    dead = [not ok and set(row) == {i} for i, (row, ok) in enumerate(zip(table, accepting))]
    begun = [i for i in range(1, len(table)) if not dead[i] and not accepting[i]]
    if accepting[0] or any(dead[t] for i in begun for t in table[i]) or any(not dead[t] for i, ok in enumerate(accepting) if ok for t in table[i]) or any(0 in row for i, row in enumerate(table) if i):
        raise ValueError("a piece has to end as soon as it matches, and must not fail once begun")
    sink = next((i for i, d in enumerate(dead) if d), len(table))
    own = [[0 if i == 0 and dead[t] else t for t in row] if not accepting[i] else [sink] * len(row) for i, row in enumerate(table)]
    if sink == len(table):
        own, accepting = [*own, [sink] * len(symbols)], [*accepting, False]
    unfinished = [not ok and i != sink for i, ok in enumerate(accepting)]
    return split(iterate(from_table(own, accepting, constant=1), "sum"), from_table(own, unfinished, constant=0), "sum")


def count_chunked(df: DataFrame, keys: list[str], order: list[str], sym: Column, pattern: Pattern, symbols: str, name: str = "n") -> DataFrame:
    """The same as count_matches for the patterns that counted() takes, for keys of any length."""
    found = pattern_values(df, keys, order, bit_of(sym, symbols), None, counted(pattern, symbols), symbols)
    return found.select(*keys, F.col("lower").alias(name))


# packets that concern all keys


def _grown(m: Machine, heads: Summary, tails: Summary, level: int) -> tuple[Summary, Summary]:
    """From the aligned groups of 2 ** level parts to those twice as long: all parts of a group up to and with each one, and from it on."""
    n = len(heads)
    group = np.arange(n) >> level
    right, left = np.flatnonzero(group % 2 == 1), np.flatnonzero((group % 2 == 0) & ((group + 1) << level < n))
    longer, later = heads.copy(), tails.copy()
    later[left] = composed(m, tails[left], heads[np.minimum((group[left] + 2) << level, n) - 1])
    longer[right] = composed(m, heads[(group[right] << level) - 1], heads[right])
    return longer, later


def between(m: Machine, parts: Summary, low: np.ndarray, high: np.ndarray) -> Summary:
    """For each pair the parts from low up to but not with high, composed; low < high. The smallest aligned group that holds a range parts it
    in two, each of which begins or ends in the group's middle: one composition a range, and one a part and level for all of them."""
    out, last = parts[low], high - 1
    level_of = np.frexp((low ^ last).astype(float))[1]  # 0 for one part
    heads, tails = parts, parts.copy()
    for level in range(int(level_of.max(initial=0))):
        mine = np.flatnonzero(level_of == level + 1)
        if len(mine):
            out[mine] = composed(m, tails[low[mine]], heads[last[mine]])
        heads, tails = _grown(m, heads, tails, level)
    return out


def _every(m: Machine, rows: pa.Table) -> Summary:
    """Of each packet."""
    return read(m, Summary.unread(m, len(rows), list(range(m.start + 1))), rows.column("_may").to_numpy(), rows.column("_weight").to_numpy())


def _of_blocks(value: Value, n_symbols: int):
    """Of the shared packets of one block, in order, one summary."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        m = machine(value, n_symbols)
        whole = composed_by(m, np.zeros(len(table), int), _every(m, table.sort_by("_pos")))
        return pa.table({"_block": pa.array([key[0].as_py()], pa.int64()), "_summary": whole.packed(m)})

    return run


def _around(value: Value, n_symbols: int, n_blocks: int, levels: int):
    """Of an aligned group of 2 ** level blocks, for each one what comes before it (side 0) and after it (side 1) within the group; of the
    group that holds all, also the whole (side 2)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        m, level, group = machine(value, n_symbols), key[0].as_py(), key[1].as_py()
        table = table.sort_by("_block")
        parts, at = Summary.unpacked(m, table.column("_summary").combine_chunks()), table.column("_block").to_numpy()
        heads, tails, step = parts, parts.copy(), 0
        while 1 << step < len(parts):
            heads, tails, step = *_grown(m, heads, tails, step), step + 1
        blocks = np.arange(group << level, min((group + 1) << level, n_blocks))
        before, after = np.searchsorted(at, blocks) - 1, np.searchsorted(at, blocks, "right")
        found = [(blocks[before >= 0], 0, heads[before[before >= 0]]), (blocks[after < len(at)], 1, tails[after[after < len(at)]])]
        if level == levels:
            found.append((blocks[:1], 2, heads[-1:].only(m, True)))
        out = [pa.table({"_block": pa.array(b, pa.int64()), "_level": pa.array(np.full(len(b), level, np.int32)), "_side": pa.array(np.full(len(b), side, np.int32)), "_summary": s.packed(m)}) for b, side, s in found]
        return pa.concat_tables(out)

    return run


def _in_blocks(keys: list[str], value: Value, n_symbols: int, levels: int):
    """Of a block's packets in order, for each key one summary: from the key's block before, or the beginning, if there is none, up to the
    end of this block, and after the key's last block up to the end of the order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        m, block = machine(value, n_symbols), key[0].as_py()
        kind, shared = table.column("_kind").to_numpy(), table.column("_all").fill_null(False).to_numpy()
        around = table.filter(pa.array(kind == AROUND))
        place = {x: i for i, x in enumerate(zip(around.column("_side").to_pylist(), around.column("_level").to_pylist()))}
        outside = Summary.unpacked(m, around.column("_summary").combine_chunks())
        common = table.filter(pa.array(shared)).sort_by("_pos")
        own = table.filter(pa.array((kind != AROUND) & ~shared)).sort_by([(c, "ascending") for c in (*keys, "_kind", "_pos")])
        if not len(own):
            return own.select(keys).append_column("_block", pa.array([], pa.int64())).append_column("_summary", pa.array([], pa.binary()))
        spans = own.column("_kind").to_numpy() == SPAN  # a key's first row
        run_of, packets = np.cumsum(spans) - 1, np.flatnonzero(~spans)
        # the shared packets since the key's row before, and those after its last row
        seen = np.where(spans, 0, np.searchsorted(common.column("_pos").to_numpy(), own.column("_pos").fill_null(0).to_numpy()))
        last = np.append(np.flatnonzero(spans)[1:], len(own)) - 1
        low, high = np.append(seen[packets - 1], seen[last]), np.append(seen[packets], np.full(len(last), len(common)))
        some = np.flatnonzero(low < high)
        gaps = between(m, _every(m, common), low[some], high[some])
        tails = np.flatnonzero(some >= len(packets))
        read_in = Summary.unread(m, len(packets), list(range(m.start + 1)))
        read_in[some[: len(some) - len(tails)]] = gaps[: len(some) - len(tails)]
        read_in = read(m, read_in, own.column("_may").to_numpy()[packets].astype(np.int32), own.column("_weight").to_numpy()[packets].astype(np.int64))
        pieces = [(run_of[packets], np.full(len(packets), 1), read_in), (some[tails] - len(packets), np.full(len(tails), 2), gaps[tails])]
        heads = own.filter(pa.array(spans))
        opens = heads.column("_prev").is_null().to_numpy()
        for side, name in ((0, "_prev"), (1, "_next")):
            other = heads.column(name).fill_null(-1).to_numpy()
            level = np.where(other < 0, levels, np.frexp((other ^ block).astype(float))[1] - 1)
            at = np.array([place.get((side, x), -1) for x in range(levels + 1)])[level]
            there = np.flatnonzero(at >= 0)
            pieces.append((there, np.full(len(there), 3 * side), outside[at[there]]))
        owner, turn = np.concatenate([r for r, _, _ in pieces]), np.concatenate([t for _, t, _ in pieces])
        order = np.lexsort((turn, owner))  # stable: a key's packets stay in order
        owner, parts = owner[order], Summary.of([s for _, _, s in pieces])[order]
        begins = np.append(True, owner[1:] != owner[:-1])
        parts.there[: m.from_start, begins & opens[owner]] = False
        parts.there[m.from_start :, ~(begins & opens[owner])] = False
        return heads.select(keys).append_column("_block", pa.array(np.full(len(heads), block))).append_column("_summary", composed_by(m, owner, parts).packed(m))

    return run


def _ended(keys: list[str], value: Value, n_symbols: int, rows: int):
    """The summaries of whole keys, which stand together in order, to their values."""

    def run(batches):
        m, held = machine(value, n_symbols), None
        for batch in batches:
            for begin in range(0, len(batch), rows):
                part = batch.slice(begin, rows)
                names, parts = part.select(keys), Summary.unpacked(m, part.column("_summary"))
                if held is not None:
                    names, parts = pa.concat_batches([held[0], names]), Summary.of([held[1], parts])
                begins = changes(names, keys)
                whole, at = composed_by(m, np.cumsum(begins) - 1, parts), np.flatnonzero(begins)
                if len(at) > 1:
                    yield _done(names.take(pa.array(at[:-1])), whole[:-1], keys, m).select([*keys, "lower", "upper"])
                held = (names.slice(int(at[-1]), 1), whole[-1:])
        if held is not None:
            yield _done(*held, keys, m).select([*keys, "lower", "upper"])

    return run


def shared_values(df: DataFrame, keys: list[str], order: list[str], concerns_all: Column, may_be: Column, weight: Column | None, value: Value, symbols: str) -> DataFrame:
    """keys, unseen, lower, upper: as pattern_values, where packets that concern all keys are read by every key at their place in the
    order, also those before its first own packet. One row more, with null keys and unseen true, is the value of any key that has no packets
    of its own.

    The order is cut into blocks of at most BLOCK packets. A block's task reads its shared packets once and makes one summary of each key
    that has packets there. What a key skips between two of its blocks is composed of two summaries, which belong to these blocks: up to and
    from the middle of the smallest aligned group of blocks that holds both. So a key's packets are joined with nothing, and no more than
    a row for each key of a block is shuffled, however many shared packets lie in between.
    """
    n, m = len(symbols), machine(value, len(symbols))
    size = min(BLOCK, max(256, (1 << 25) // (16 * m.width)))  # a block's summaries take 32 MB at most
    w = F.coalesce(weight.cast("long"), F.lit(0)) if weight is not None else F.lit(0).cast("long")
    rows = numbered(df.select(*keys, *order, F.coalesce(concerns_all, F.lit(False)).alias("_all"), may_be.alias("_may"), w.alias("_weight")), order, "_pos")
    rows = rows.select(*keys, F.expr(f"_pos div {size}").alias("_block"), "_pos", "_all", "_may", "_weight")
    n_rows, n_shared = rows.agg(F.count("*"), F.count_if("_all")).first()
    n_blocks = -(-n_rows // size)
    levels = max(1, (n_blocks - 1).bit_length())
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a summary for each block, then those around each block in groups of 2, 4, 8 and so on
    blocks = stored(rows.where("_all").groupBy("_block").applyInArrow(_of_blocks(value, n), "_block long, _summary binary"))
    grouped = blocks.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).withColumn("_group", F.expr("shiftright(_block, _level)"))
    around = stored(grouped.groupBy("_level", "_group").applyInArrow(_around(value, n, n_blocks, levels), "_block long, _level int, _side int, _summary binary"))
    by_key = Window.partitionBy(*keys).orderBy("_block")
    spans = rows.where("not _all").select(*keys, "_block").distinct().select(*keys, "_block", F.lag("_block").over(by_key).alias("_prev"), F.lead("_block").over(by_key).alias("_next"))
    kinds = [(around.where("_side < 2"), AROUND), (spans, SPAN), (rows, PACKET)]
    together = None
    for part, kind in kinds:
        part = part.withColumn("_kind", F.lit(kind))
        together = part if together is None else together.unionByName(part, allowMissingColumns=True)
    own = [StructField(k, df.schema[k].dataType) for k in keys]
    fields = StructType([*own, StructField("_block", LongType()), StructField("_summary", BinaryType())])
    found = together.repartition(n_parts, "_block").groupBy("_block").applyInArrow(_in_blocks(keys, value, n, levels), fields).withColumn("unseen", F.lit(False))
    nobody = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
    found = found.unionByName(around.where("_side = 2").select(*nobody, "_block", "_summary", F.lit(True).alias("unseen")))
    # a key has at most one row a block
    whole = found.repartition(n_parts, *keys, "unseen").sortWithinPartitions(*keys, "unseen", "_block")
    out = StructType([*own, StructField("unseen", BooleanType()), StructField("lower", LongType()), StructField("upper", LongType())])
    found = whole.mapInArrow(_ended([*keys, "unseen"], value, n, size), out)
    if n_shared:
        return found
    empty = of_nothing(value)  # no shared packet: an unseen key's stream is empty
    bound = lambda f: F.lit(f(empty) if empty else None).cast("long")
    return found.unionByName(df.sparkSession.range(1).select(*nobody, F.lit(True).alias("unseen"), bound(min).alias("lower"), bound(max).alias("upper")))
