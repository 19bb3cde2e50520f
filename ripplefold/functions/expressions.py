"""Column helpers: predicates with three-valued logic, addresses, time buckets and dyadic slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def anything() -> Column:
    return F.lit(True)


def unknown() -> Column:
    """Neither true nor false; & and | follow Kleene's tables."""
    return F.lit(None).cast("boolean")


def choose(condition: Column, then, otherwise) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def ip_to_long(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return reduce(lambda acc, i: acc * 256 + F.get(parts, i).cast("long"), range(4), F.lit(0).cast("long"))


def ip_to_text(address: Column) -> Column:
    return F.concat_ws(".", *((F.shiftright(address, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)))


def bucket_ms(ts: Column, width: int) -> Column:
    return (F.floor(F.unix_millis(ts.cast("timestamp")) / width) * width).cast("long")


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def slice_positions(n: Column, bits: str) -> tuple[Column, Column]:
    """First and last position of the dyadic slice that `bits` (a leading 1, then halves) selects of n sorted distinct values.
    Positions are halved on the smallest power-of-two grid that holds the last one, and only the end is capped: a slice whose first
    position is n or more doesn't exist."""
    depth, at = len(bits) - 1, int(bits[1:] or "0", 2)
    digits = F.when(n > 1, F.length(F.bin((n - 1).cast("long")))).otherwise(0)
    width = F.when(digits > depth, F.pow(F.lit(2), digits - depth)).otherwise(1).cast("long")
    first = F.lit(at).cast("long") * width
    return first, F.least(first + width - 1, (n - 1).cast("long"))


def slice_exists(n: Column, bits: str) -> Column:
    return slice_positions(n, bits)[0] < n


def clock_12(text: Column, pattern: str = "d/M/yyyy H:mm") -> Column:
    """A time written on a 12-hour clock without morning or afternoon: hours before 8 are afternoon ones; then the zone's shift."""
    parsed = F.to_timestamp(text, pattern)
    return F.when(F.hour(parsed) < 8, parsed + F.expr("interval 11 hours")).otherwise(parsed - F.expr("interval 1 hour"))


def is_tcp(protocol: Column) -> Column:
    return protocol == 6


def is_udp(protocol: Column) -> Column:
    return protocol == 17


def is_sip(protocol: Column, src_port: Column, dst_port: Column, port: int = 5060) -> Column:
    return is_udp(protocol) & ((src_port == port) | (dst_port == port))
