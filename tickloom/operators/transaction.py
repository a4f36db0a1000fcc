"""Trades: the transaction feature block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from . import windows as W

WINDOWS = (1, 2, 5, 10, 30, 60)
LARGE = 10_000
PRICE_STATS = ("last", "mean", "std", "min", "max", "delta", "slope")


def derive(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Trades in basis points of the reference, with gap and side of the trade before. Prices are not clipped."""
    col = F.col
    d = rows.join(context, "sample_id").withColumn("price_bps", S.log_bps(col("price"), col("reference")))
    d = d.withColumn("signed_volume", F.when(col("side") == 0, col("volume")).otherwise(-col("volume")))
    d = W.with_lags(d, "seconds", "side")
    return d.withColumns({"gap": col("prev_seconds") - col("seconds"), "same_side": (col("side") == col("prev_side")).cast("double")})


def _stats() -> dict[str, Column]:
    col = F.col
    buy, sell = col("side") == 0, col("side") == 1
    n, volume = F.count("*").cast("double"), A.group_sum(col("volume"))
    buys, sells = F.count_if(buy).cast("double"), F.count_if(sell).cast("double")
    stats = {
        "event_count": n, "event_rate": n / F.first("w"), "volume_logsum": F.log1p(volume), "buy_count": buys, "sell_count": sells,
        "buy_volume_logsum": F.log1p(A.group_sum(col("volume"), buy)), "sell_volume_logsum": F.log1p(A.group_sum(col("volume"), sell)),
        "count_imbalance": S.ratio(buys - sells, n), "volume_imbalance": S.ratio(A.group_sum(col("signed_volume")), volume),
        "large_trade_rate": S.ratio(F.count_if(col("volume") >= LARGE), n), "vwap_bps": A.group_weighted_mean(col("price_bps"), col("volume")),
    }
    stats |= A.series("price_bps", col("price_bps"), PRICE_STATS)
    stats |= A.series("event_gap", col("gap"), ("mean", "std", "max"), W.transition())
    stats["direction_persistence"] = F.avg(F.when(W.transition(), col("same_side")))
    return stats


def block_long(derived: DataFrame, windows: tuple[float, ...] = WINDOWS, only: set[str] | None = None) -> DataFrame:
    """(sample_id, w) with 22 statistics, or the named ones of them."""
    return W.grouped(derived, windows, _stats(), only)


def zeros() -> dict[str, bool]:
    head = ("event_count", "event_rate", "volume_logsum", "buy_count", "sell_count", "buy_volume_logsum", "sell_volume_logsum", "count_imbalance", "volume_imbalance", "large_trade_rate")
    open_ = ["vwap_bps", *(f"price_bps__{s}" for s in PRICE_STATS), *(f"event_gap__{s}" for s in ("mean", "std", "max")), "direction_persistence"]
    return {n: True for n in head} | {n: False for n in open_}


def block(rows: DataFrame, context: DataFrame, windows: tuple[float, ...] = WINDOWS, only: set[str] | None = None) -> DataFrame:
    """The wide block: 2 + 22 columns for each window, or the named statistics."""
    return block_of(derive(rows, context), windows, only)


def block_of(derived: DataFrame, windows: tuple[float, ...] = WINDOWS, only: set[str] | None = None) -> DataFrame:
    return W.wide_events(derived, "transaction", windows, _stats(), zeros(), only)
