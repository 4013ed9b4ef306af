"""Media times as whole numbers. A tick is 100 ns; tracks count in units of 1/timescale seconds.

Spark's intervals and timestamps are too coarse for a tick, so times stay BIGINT throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = 10_000_000


def _parts(value: Column, divisor: Column, factor: Column | int) -> tuple[Column, Column]:
    """value * factor / divisor as (whole part, remainder), truncated towards zero, without a product beyond 64 bits for factors and divisors below 2**31."""
    div = lambda a, b: F.call_function("div", a, b)
    rest = (value % divisor) * factor
    return div(value, divisor) * factor + div(rest, divisor), rest % divisor


def rounded(value: Column | str, timescale: Column | str) -> Column:
    """Ticks of a track time, to the nearest, halves away from zero."""
    v, t = F.col(value) if isinstance(value, str) else value, F.col(timescale) if isinstance(timescale, str) else timescale
    whole, rest = _parts(v.cast("bigint"), t.cast("bigint"), TICKS)
    return whole + F.when(F.abs(rest) * 2 >= t, F.signum(rest).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def exact_ticks(value: Column | str, timescale: Column | str) -> Column:
    """Ticks of a track time; an error if they are no whole number."""
    v, t = F.col(value) if isinstance(value, str) else value, F.col(timescale) if isinstance(timescale, str) else timescale
    whole, rest = _parts(v.cast("bigint"), t.cast("bigint"), TICKS)
    return F.when(rest == 0, whole).otherwise(F.raise_error(F.lit("time is no whole number of ticks")).cast("bigint"))


def exact_units(ticks: Column | str, timescale: Column | str) -> Column:
    """Track time of ticks; an error if it is no whole number."""
    v, t = F.col(ticks) if isinstance(ticks, str) else ticks, F.col(timescale) if isinstance(timescale, str) else timescale
    whole, rest = _parts(v.cast("bigint"), F.lit(TICKS).cast("bigint"), t.cast("bigint"))
    return F.when(rest == 0, whole).otherwise(F.raise_error(F.lit("ticks are no whole number of track units")).cast("bigint"))
