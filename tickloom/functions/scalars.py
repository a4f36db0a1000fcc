"""Column functions of one row. NULL stands for a missing value; infinities and NaN become NULL on reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(n: Column, d: Column) -> Column:
    """n / d where d is not 0, else 0."""
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def ratio_clear(n: Column, d: Column) -> Column:
    """n / d where d is clearly not 0, else 0; a missing d gives 0, a missing n is missing."""
    return F.when(F.abs(d) > FLOOR, n / d).otherwise(F.lit(0.0))


def ratio_positive(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def pressure(p: Column, n: Column) -> Column:
    return ratio_positive(p - n, p + n)


def imbalance(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask)).otherwise(F.lit(0.0))


def midprice(ask: Column, bid: Column) -> Column:
    return F.when((ask > 0) & (bid > 0), (ask + bid) / 2)


def log_bps(price: Column, reference: Column) -> Column:
    """Basis points of a log return; prices have a floor. greatest() skips NULL, hence the guard."""
    return F.when(price.isNotNull(), F.ln(F.greatest(price, F.lit(FLOOR)) / reference) * 1e4)


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x: Column, low, high) -> Column:
    """x within bounds, missing where x is; bounds that are missing do not clip."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def was_clipped(x: Column, low: float, high: float) -> Column:
    return F.coalesce((x < low) | (x > high), F.lit(False))


def signed_power(x: Column, scale: Column, power: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x) / scale, F.lit(power))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def as_single(x: Column) -> Column:
    """Rounded through a 32-bit float, as features are between blocks."""
    return x.cast("float").cast("double")
