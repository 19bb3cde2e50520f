"""Registered queries of values over patterns: nested folds, bounds over unknown packets, one stream over all tasks, shared packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefold.operators import chunks as K
from ripplefold.operators.patterns import alt, one, seq, star
from ripplefold.operators.registers import either, iterate, split, total, when

ORDER = ["ts", "pkt_id"]
SYMBOLS = "sfaro"


def _bits():
    return K.bits(SYMBOLS, {"s": F.col("syn"), "f": F.col("fin"), "a": F.col("ack"), "r": F.col("rst")})


def _inside(*ends: str):
    """Any number of packets of other kinds."""
    return star(alt(*(one(c) for c in SYMBOLS if c not in ends)))


def pieces_to_either():
    """The greatest sum over pieces that end with one of two kinds of packet, and a rest without them."""
    return split(iterate(total(seq(_inside("f", "r"), alt(one("f"), one("r"))), SYMBOLS, "sum"), "max"), when(_inside("f", "r"), SYMBOLS, 0), "max")


def nested():
    """Over pieces that end with r: the greatest sum of those within that end with f, and the sum of what is left."""
    inner = iterate(total(seq(_inside("f", "r"), one("f")), SYMBOLS, "sum"), "max")
    outer = iterate(split(inner, total(seq(_inside("f", "r"), one("r")), SYMBOLS, "sum"), "sum"), "sum")
    return split(outer, when(_inside("r"), SYMBOLS, 0), "sum")


def _nested_sql(keys: str) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    some = f"{keys}, " if keys else ""
    return f"""WITH a AS (SELECT {some}len, fin, rst, ts, pkt_id, coalesce(sum(rst::INT) OVER ({by} ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM {{pk}}),
 b AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY {some}o ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM a),
 c AS (SELECT {some}o, i, sum(len) AS v, bool_or(fin) AS f, bool_or(rst) AS r FROM b GROUP BY {some}o, i),
 d AS (SELECT {some}o, greatest(coalesce(max(v) FILTER (f), 0), 0) + sum(v) FILTER (r) AS v, bool_or(r) AS closed FROM c GROUP BY {some}o)
SELECT {some}coalesce(sum(v) FILTER (closed), 0)::BIGINT AS value FROM d {"GROUP BY " + keys if keys else ""}"""


def register(add) -> None:
    value = lambda found, *keys: found.select(*keys, F.col("lower").alias("value"))
    over = lambda p, keys, what: value(K.pattern_values(p, keys, ORDER, _bits(), F.col("len"), what, SYMBOLS), *keys)
    add("q06_iterate_pattern", lambda p: over(p, ["src"], pieces_to_either()), """WITH a AS (SELECT src, len, fin OR rst AS e, coalesce(sum((fin OR rst)::INT) OVER (PARTITION BY src ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {pk}),
 s AS (SELECT src, g, sum(len) AS v, bool_or(e) AS closed FROM a GROUP BY src, g) SELECT src, greatest(coalesce(max(v) FILTER (closed), 0), 0)::BIGINT AS value FROM s GROUP BY src""")
    add("q07_split_nested", lambda p: over(p, ["src"], nested()), _nested_sql("src"))
    add("q12_values_chunked", lambda p: over(p, [], nested()), _nested_sql(""))
    unknown = lambda: K.bits("so", {"s": F.when(F.col("kind") != "view", F.col("syn"))})  # noqa: E731  a view may be either
    bounds = lambda p, what: K.pattern_values(p, ["src"], ORDER, unknown(), F.col("len"), what, "so")
    add("q10_bounds_max", lambda p: bounds(p, iterate(either(total(one("s"), "so"), when(one("o"), "so", 0)), "max")), "SELECT src, greatest(coalesce(max(len) FILTER (syn), 0), 0) AS lower, greatest(coalesce(max(len) FILTER (syn OR kind = 'view'), 0), 0) AS upper FROM {pk} GROUP BY src")
    add("q10_bounds_min", lambda p: bounds(p, iterate(either(total(one("s"), "so"), when(one("o"), "so", 1 << 20)), "min")), "SELECT src, least(coalesce(min(len) FILTER (syn OR kind = 'view'), 1048576), 1048576) AS lower, least(coalesce(min(len) FILTER (syn), 1048576), 1048576) AS upper FROM {pk} GROUP BY src")
    add("q11_undefined_values", lambda p: bounds(p, total(seq(star(one("o")), one("s"), star(alt(one("s"), one("o")))), "so", "max")), "SELECT src, CASE WHEN bool_or(syn OR kind = 'view') THEN greatest(max(len), 0) END AS lower, CASE WHEN bool_or(syn OR kind = 'view') THEN greatest(max(len), 0) END AS upper FROM {pk} GROUP BY src")
    stretches = split(iterate(total(seq(star(one("o")), one("r")), "or"), "max"), when(star(one("o")), "or", 0), "max")
    shared = lambda p: K.shared_values(p, ["src"], ORDER, F.col("rst"), K.bits("or", {"r": F.col("rst")}), F.when(~F.col("rst"), F.col("len")), stretches, "or")
    add("q04_shared_values", lambda p: value(shared(p), "src", "unseen"), """WITH g AS (SELECT src, len, rst, sum(rst::INT) OVER (ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS c FROM {pk}), own AS (SELECT src, c, sum(len) AS v FROM g WHERE NOT rst GROUP BY src, c)
SELECT src, FALSE AS unseen, greatest(coalesce(max(v) FILTER (c < (SELECT count(*) FROM {pk} WHERE rst)), 0), 0)::BIGINT AS value FROM own GROUP BY src UNION ALL SELECT NULL, TRUE, 0""")
