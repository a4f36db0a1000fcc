"""Aggregates over finite values; counts and sums of nothing are 0, other statistics are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = "row_seq"


def held(v: Column, where: Column | None) -> Column:
    return v if where is None else F.when(where, v)


def group_count(where: Column) -> Column:
    return F.count_if(where)


def group_sum(v: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(held(v, where)), F.lit(0))


def group_weighted_mean(v: Column, weight: Column, where: Column | None = None) -> Column:
    """Over weights above 0; missing if there are none."""
    use = v.isNotNull() & (weight > 0) if where is None else v.isNotNull() & (weight > 0) & where
    return F.try_divide(F.sum(F.when(use, v * weight)), F.sum(F.when(use, weight)))


def group_first(v: Column, where: Column | None = None) -> Column:
    use = v.isNotNull() if where is None else v.isNotNull() & where
    return F.min_by(v, F.when(use, F.col(ORDER)))


def group_last(v: Column, where: Column | None = None) -> Column:
    use = v.isNotNull() if where is None else v.isNotNull() & where
    return F.max_by(v, F.when(use, F.col(ORDER)))


def slope(v: Column, seconds: Column) -> Column:
    """Of v on time, which runs as seconds fall; 0 where time stands still."""
    return F.when(F.count(v) > 0, F.coalesce(F.regr_slope(v, -seconds), F.lit(0.0)))


def series(prefix: str, v: Column, stats: tuple[str, ...], where: Column | None = None, seconds: str = "seconds") -> dict[str, Column]:
    """Named statistics of one signal."""
    x = held(v, where)
    make = {
        "first": lambda: group_first(v, where),
        "last": lambda: group_last(v, where),
        "mean": lambda: F.avg(x),
        "std": lambda: F.stddev_pop(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "delta": lambda: group_last(v, where) - group_first(v, where),
        "slope": lambda: slope(x, F.col(seconds)),
        "sum": lambda: group_sum(x),
        "count": lambda: F.count(x),
    }
    return {f"{prefix}__{s}": make[s]() for s in stats}


def cosine(t: Column, p: Column) -> Column:
    """Missing if either vector is zero."""
    return F.try_divide(F.sum(t * p), F.sqrt(F.sum(t * t)) * F.sqrt(F.sum(p * p)))
