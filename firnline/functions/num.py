"""Rounding and rates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def round_half_up(x: Column) -> Column:
    """To whole numbers, halves toward plus infinity (-9.5 gives -9)."""
    return F.floor(x + F.lit(0.5)).cast("double")


def round_to(x: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor((x + F.lit(EPSILON)) * scale + F.lit(0.5)) / scale


def clamp(x: Column, lo, hi) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(lo)), as_col(hi))


def rate(part: Column, whole: Column) -> Column:
    """Share in 0 to 1 to four places; null where the whole is not positive."""
    return F.when(whole > 0, round_to(clamp(part / whole, 0.0, 1.0), 4))


def trend_percent(now: Column, before: Column) -> Column:
    return F.when(before != 0, round_to((now - before) / before, 4))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, round_to(part / whole, 4))


def outside(x: Column, lo: Column, hi: Column) -> Column:
    """Distance from the range, 0 inside it."""
    return F.when(x < lo, lo - x).when(x > hi, x - hi).otherwise(F.lit(0.0))
