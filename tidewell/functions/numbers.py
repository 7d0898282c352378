"""Numeric and time functions, as expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, total: Column) -> Column:
    """Percentage to two places, halves to even; null if a number is missing or the total is zero."""
    return F.when(part.isNotNull() & total.isNotNull() & (total != 0), F.bround(part * 100.0 / total, 2))


def lenient_int(c: Column) -> Column:
    """Numbers and numeric strings, cut towards zero; anything else, NaN and infinities are null."""
    d = c.cast("string").try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < 9.2e18), d.cast("bigint"))


def ratio(before: Column, after: Column) -> Column:
    """after / before; null if one is missing or both are zero, infinite from zero."""
    return F.when(before == 0, F.when(after != 0, F.lit(float("inf")))).otherwise(after / before)


def material(before: Column, after: Column, share: float = 0.2) -> Column:
    """Whether a change counts: a value appears or goes, moves by one, or by ``share`` of the old one."""
    one_missing = before.isNull() != after.isNull()
    delta = F.abs(after - before)
    moved = F.when(delta <= 1, delta == 1).when(before == 0, F.lit(True)).otherwise(F.abs(after / before - 1.0) >= share)
    return F.when(before.isNull() & after.isNull(), F.lit(False)).when(one_missing, F.lit(True)).otherwise(moved)


def ms_to_us(c: Column) -> Column:
    d = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")
    return F.coalesce(F.bround(d * 1000).cast("bigint"), F.lit(0).cast("bigint"))


def elapsed_us(ms: Column, us: Column, old_ms: Column) -> Column:
    """Microseconds from the first of three spellings that is there; else 0."""
    return F.when(ms.isNotNull(), ms_to_us(ms)).when(us.isNotNull(), F.bround(us).cast("bigint")).when(old_ms.isNotNull(), ms_to_us(old_ms)).otherwise(F.lit(0).cast("bigint"))


def min_max(c: Column, low: Column, high: Column) -> Column:
    """(c - low) / (high - low), and by 1 where both are equal."""
    return (c - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def nearest_rank(values: Column, q: float) -> Column:
    """From an array of numbers: sorted[round((n - 1) * q)], halves to even; null if empty."""
    s = F.array_sort(values)
    return F.get(s, F.bround((F.size(s) - 1) * F.lit(q)).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Of two float arrays; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def window_start(now: Column, minutes: int = 30) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def iso(c: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd'T'HH:mm:ss") if zone != "UTC" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def duration_ms(begin: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", begin, end)
