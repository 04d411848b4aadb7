"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL where den is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def gap(retained: Column, total: Column) -> Column:
    return F.lit(1.0) - ratio(retained, total)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k out of n, clipped to [0, 1]; NULL where n is 0."""
    nd = n.cast("double")
    p = ratio(k, n)
    zz = F.lit(z * z)
    den = F.lit(1.0) + F.try_divide(zz, nd)
    centre = (p + F.try_divide(zz, F.lit(2.0) * nd)) / den
    half = F.lit(z) * F.sqrt(
        F.try_divide(p * (F.lit(1.0) - p), nd) + F.try_divide(zz, F.lit(4.0) * nd * nd)
    ) / den
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def gap_wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of the gap 1 - k/n: the reversed complement of the retention interval."""
    lo, hi = wilson(k, n, z)
    return F.lit(1.0) - hi, F.lit(1.0) - lo


def r6(column: Column) -> Column:
    return F.round(column, 6)
