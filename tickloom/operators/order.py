"""Order events: the order feature block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from . import windows as W

WINDOWS = (1, 2, 5, 10, 30, 60)
BINS = (10.0, 50.0, 200.0)
BUCKETS = ("0_10", "10_50", "50_200", "200_plus")
CATEGORIES = ("buy_new", "buy_cancel", "sell_new", "sell_cancel")
LARGE, CLIP = 10_000, (0.5, 1.5)


def derive(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Events with signed distance to the reference, category, distance bucket and gap to the event before."""
    col = F.col
    d = rows.join(context, "sample_id")
    d = d.withColumn("clipped_price", S.clip(col("price"), *CLIP))
    d = d.withColumn("distance_bps", S.log_bps(col("clipped_price"), col("reference")))
    far = F.abs("distance_bps")
    category = F.when(col("side") == 0, F.when(col("order_action") == 0, "buy_new").otherwise("buy_cancel")).otherwise(F.when(col("order_action") == 0, "sell_new").otherwise("sell_cancel"))
    bucket = F.when(far < BINS[0], BUCKETS[0]).when(far < BINS[1], BUCKETS[1]).when(far < BINS[2], BUCKETS[2]).when(far.isNotNull(), BUCKETS[3])
    sign = F.when(col("side") == 0, 1.0).otherwise(-1.0) * F.when(col("order_action") == 0, 1.0).otherwise(-1.0)
    d = d.withColumns({"category": category, "bucket": bucket, "clipped": S.was_clipped(col("price"), *CLIP), "signed_volume": sign * col("volume")})
    return W.with_lags(d, "seconds").withColumn("gap", col("prev_seconds") - col("seconds"))


def _stats() -> dict[str, Column]:
    col = F.col
    n, volume = F.count("*").cast("double"), A.group_sum(col("volume"))
    cancel = col("order_action") == 1
    stats = {
        "event_count": n,
        "event_rate": n / F.first("w"),
        "volume_logsum": F.log1p(volume),
        "signed_volume_imbalance": S.ratio(A.group_sum(col("signed_volume")), volume),
        "cancel_count_rate": S.ratio(F.count_if(cancel), n),
        "cancel_volume_rate": S.ratio(A.group_sum(col("volume"), cancel), volume),
        "large_order_rate": S.ratio(F.count_if(col("volume") >= LARGE), n),
        "price_clipped_rate": S.ratio(F.count_if(col("clipped")), n),
    }
    stats |= A.series("distance_bps", col("distance_bps"), ("last", "mean", "std", "max"))
    stats |= A.series("event_gap", col("gap"), ("mean", "std", "max"), W.transition())
    for c in CATEGORIES:
        stats |= {f"{c}_count": F.count_if(col("category") == c).cast("double"), f"{c}_volume_logsum": F.log1p(A.group_sum(col("volume"), col("category") == c))}
    for b in BUCKETS:
        stats |= {f"distance_{b}_count": F.count_if(col("bucket") == b).cast("double"), f"distance_{b}_volume_logsum": F.log1p(A.group_sum(col("volume"), col("bucket") == b))}
    return stats


def block_long(derived: DataFrame, windows: tuple[float, ...] = WINDOWS, only: set[str] | None = None) -> DataFrame:
    """(sample_id, w) with 31 statistics, or the named ones of them."""
    return W.grouped(derived, windows, _stats(), only)


def zeros() -> dict[str, bool]:
    head = ("event_count", "event_rate", "volume_logsum", "signed_volume_imbalance", "cancel_count_rate", "cancel_volume_rate", "large_order_rate", "price_clipped_rate")
    open_ = ("distance_bps__last", "distance_bps__mean", "distance_bps__std", "distance_bps__max", "event_gap__mean", "event_gap__std", "event_gap__max")
    tail = [f"{p}{x}_{k}" for p, names in (("", CATEGORIES), ("distance_", BUCKETS)) for x in names for k in ("count", "volume_logsum")]
    return {n: True for n in head} | {n: False for n in open_} | {n: True for n in tail}


def block(rows: DataFrame, context: DataFrame, windows: tuple[float, ...] = WINDOWS, only: set[str] | None = None) -> DataFrame:
    """The wide block: 2 + 31 columns for each window, or the named statistics."""
    return block_of(derive(rows, context), windows, only)


def block_of(derived: DataFrame, windows: tuple[float, ...] = WINDOWS, only: set[str] | None = None) -> DataFrame:
    return W.wide_events(derived, "order", windows, _stats(), zeros(), only)
