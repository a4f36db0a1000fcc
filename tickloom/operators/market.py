"""Order-book snapshots: derived rows and the market feature block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import aggregates as A
from ..functions import scalars as S
from . import windows as W
from .clean import book_level_state, trade_state

WINDOWS = (5, 10, 30, 60, 180, 600)
SIGNALS = ("mid_bps", "spread_bps", "microprice_bps", "imbalance_l1", "imbalance_l2", "trade_price_bps")
SIGNAL_STATS = ("last", "mean", "std", "min", "max", "delta", "slope")
DEPTH_STATS = ("last", "mean", "std", "max")
GLOBALS = ("reference_mid", "no_valid_mid", "row_count", "observed_span", "last_event_seconds")


def derive(rows: DataFrame) -> DataFrame:
    """Snapshots with prices in basis points of the sample's reference, imbalances, depths and trade parts."""
    col = F.col
    whole = W.sample().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda v: F.last(v, ignorenulls=True).over(whole)
    valid = {f"{s}{k}": book_level_state(col(f"{s}_price_{k}"), col(f"{s}_volume_{k}")) == "valid" for s in ("ask", "bid") for k in (1, 2)}
    volume = {n: F.when(v, col(f"{n[:3]}_volume_{n[3]}")).otherwise(0.0) for n, v in valid.items()}
    d = rows.withColumns({"valid_l1": valid["ask1"] & valid["bid1"], "valid_l2": valid["ask2"] & valid["bid2"], **{f"v_{n}": v for n, v in volume.items()}})
    d = d.withColumn("mid", F.when(col("valid_l1"), (col("ask_price_1") + col("bid_price_1")) / 2))
    a, b = last(F.when(col("ask_price_1") > 0, col("ask_price_1"))), last(F.when(col("bid_price_1") > 0, col("bid_price_1")))
    d = d.withColumns({"last_mid": last(col("mid")), "last_ask": a, "last_bid": b})
    found = F.coalesce("last_mid", (col("last_ask") + col("last_bid")) / 2, "last_ask", "last_bid")
    d = d.withColumns({"reference_mid": F.when(found > 0, found).otherwise(1.0), "no_valid_mid": F.coalesce(found <= 0, F.lit(True))})
    d = d.withColumn("mid_filled", W.filled(col("mid"), col("reference_mid")))
    depth = col("v_ask1") + col("v_bid1")
    micro = F.when(col("valid_l1") & (depth > 0), (col("ask_price_1") * col("v_bid1") + col("bid_price_1") * col("v_ask1")) / depth)
    state = trade_state(col("transaction_avgprice"), col("transaction_volume"), col("transaction_count"))
    d = d.withColumn("trade", state)
    positive, correction = col("trade") == "positive", col("trade") == "correction"
    part = lambda where, c: F.when(where, col(c)).otherwise(0.0)
    d = d.withColumns({
        "mid_bps": S.log_bps(col("mid_filled"), col("reference_mid")),
        "spread_bps": F.when(col("valid_l1"), (col("ask_price_1") - col("bid_price_1")) / col("mid") * 1e4),
        "microprice_bps": F.when(micro.isNotNull(), S.log_bps(micro, col("mid_filled"))),
        "imbalance_l1": S.imbalance(col("v_bid1"), col("v_ask1")),
        "imbalance_l2": S.imbalance(col("v_bid1") + col("v_bid2"), col("v_ask1") + col("v_ask2")),
        "log_depth_l1": F.log1p(F.greatest(depth, F.lit(0.0))),
        "log_depth_l2": F.log1p(F.greatest(depth + col("v_ask2") + col("v_bid2"), F.lit(0.0))),
        "trade_price_bps": F.when(positive, S.log_bps(col("transaction_avgprice"), col("mid_filled"))).otherwise(0.0),
        "has_trade": positive.cast("double"), "no_trade": (col("trade") == "none").cast("double"), "correction": correction.cast("double"),
        "positive_volume": part(positive, "transaction_volume"), "positive_count": part(positive, "transaction_count"),
        "correction_volume": part(correction, "transaction_volume"), "correction_count": part(correction, "transaction_count"),
    })
    return W.with_lags(d, "seconds", "mid_bps").withColumn("mid_return", col("mid_bps") - col("prev_mid_bps"))


def _stats() -> dict[str, Column]:
    rate = lambda c: (A.group_sum(c) / F.count("*"))
    stats = {"rows": F.count("*").cast("double"), "book_valid_l1_rate": rate(F.col("valid_l1").cast("double")), "book_valid_l2_rate": rate(F.col("valid_l2").cast("double"))}
    for s in SIGNALS:
        stats |= A.series(s, F.col(s), SIGNAL_STATS)
    for s in ("log_depth_l1", "log_depth_l2"):
        stats |= A.series(s, F.col(s), DEPTH_STATS)
    step = F.when(W.transition(), F.col("mid_return"))
    stats |= {
        "trade_volume_logsum": F.log1p(F.greatest(A.group_sum(F.col("positive_volume")), F.lit(0.0))),
        "trade_count_logsum": F.log1p(F.greatest(A.group_sum(F.col("positive_count")), F.lit(0.0))),
        "has_trade_rate": rate(F.col("has_trade")),
        "no_trade_rate": rate(F.col("no_trade")),
        "correction_count": A.group_sum(F.col("correction")),
        "correction_volume_signed_logsum": S.signed_log1p(A.group_sum(F.col("correction_volume"))),
        "correction_trade_count_signed_logsum": S.signed_log1p(A.group_sum(F.col("correction_count"))),
        "realized_vol_bps": F.sqrt(A.group_sum(step * step)),
    }
    return stats


def block_long(derived: DataFrame, windows: tuple[float, ...] = WINDOWS, only: set[str] | None = None) -> DataFrame:
    """(sample_id, w) with 61 statistics, or the named ones of them."""
    return W.grouped(derived, windows, _stats(), only)


def zeros() -> dict[str, bool]:
    """Every statistic, and whether it is 0 where a window is empty."""
    signals = [f"{s}__{t}" for s in SIGNALS for t in SIGNAL_STATS] + [f"{s}__{t}" for s in ("log_depth_l1", "log_depth_l2") for t in DEPTH_STATS]
    head = ["rows", "book_valid_l1_rate", "book_valid_l2_rate"]
    tail = ["trade_volume_logsum", "trade_count_logsum", "has_trade_rate", "no_trade_rate", "correction_count", "correction_volume_signed_logsum", "correction_trade_count_signed_logsum", "realized_vol_bps"]
    return {n: True for n in head} | {n: False for n in signals} | {n: True for n in tail}


def _of_whole() -> dict[str, Column]:
    """The five statistics of whole samples."""
    first, last = A.group_first(F.col("seconds")), A.group_last(F.col("seconds"))
    return {"reference_mid": F.first("reference_mid"), "no_valid_mid": F.first(F.col("no_valid_mid").cast("double")), "row_count": F.count("*").cast("double"), "observed_span": first - last, "last_event_seconds": last}


def global_stats(derived: DataFrame) -> DataFrame:
    """(sample_id) with the five statistics of whole samples."""
    return derived.groupBy("sample_id").agg(*(v.alias(f"market__{k}") for k, v in _of_whole().items()))


def block_of(derived: DataFrame, windows: tuple[float, ...] = WINDOWS, only: set[str] | None = None) -> DataFrame:
    """The wide block of derived rows, 5 + 61 columns for each window, or the named statistics: one grouping, in which
    the whole sample is one window more."""
    whole = _of_whole()
    long = W.grouped(derived, W.with_whole(windows, whole, only), _stats() | whole, only)
    return W.wide(long, "market", windows, zeros(), GLOBALS)


def block(rows: DataFrame, windows: tuple[float, ...] = WINDOWS) -> DataFrame:
    """The wide block: 5 + 61 columns for each window."""
    return block_of(derive(rows), windows)


def context(derived: DataFrame) -> DataFrame:
    """(sample_id, reference) for order and transaction rows, rounded through a 32-bit float."""
    return derived.groupBy("sample_id").agg(S.as_single(F.first("reference_mid")).alias("reference"))
