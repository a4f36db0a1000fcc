"""Cross features of orders, trades and the book, and sets derived from the blocks' columns.

Everything here is a projection of wide rows, without a shuffle of its own.
"""

from __future__ import annotations

import math
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

WINDOWS = (1, 2, 5, 10, 30, 60)
CATEGORIES = ("buy_new", "buy_cancel", "sell_new", "sell_cancel")
SETS = ("order_category_ratios", "order_pressure", "temporal_dynamics")


def joined(*blocks: DataFrame) -> DataFrame:
    """Blocks side by side by sample; co-partitioned tables need no shuffle for it."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, "sample_id")
    return out


#: Statistics of the blocks that the cross features and the derived sets are made of.
NEEDS = {
    "cross": {"order": {"signed_volume_imbalance", "volume_logsum", "cancel_volume_rate"}, "transaction": {"volume_imbalance", "volume_logsum", "price_bps__last"}, "market": {"log_depth_l1__last", "mid_bps__delta", "microprice_bps__last"}},
    "order_category_ratios": {"order": {"event_count", "volume_logsum", *(f"{c}_{k}" for c in CATEGORIES for k in ("count", "volume_logsum"))}},
    "order_pressure": {"order": {f"{c}_{k}" for c in CATEGORIES for k in ("count", "volume_logsum")}},
    "temporal_dynamics": {
        "order": {"signed_volume_imbalance", "cancel_count_rate", "cancel_volume_rate", *(f"{c}_{k}" for c in CATEGORIES for k in ("count", "volume_logsum"))},
        "transaction": {"count_imbalance", "volume_imbalance", "vwap_bps", "price_bps__mean"},
        "market": {"mid_bps__std", "mid_bps__delta", "mid_bps__max", "mid_bps__min", "mid_bps__slope", "realized_vol_bps", "spread_bps__mean", "imbalance_l2__mean"},
    },
}


def cross(rows: DataFrame) -> DataFrame:
    """sample_id with seven features for each of six windows; the book's shortest window is 5 s."""
    out: dict[str, Column] = {}
    for w in WINDOWS:
        o, t, m = (lambda n, p=p: F.col(f"{p}__{n}") for p in (f"order__w{w}", f"transaction__w{w}", f"market__w{max(w, 5)}"))
        flow, trade, prefix = o("signed_volume_imbalance"), t("volume_imbalance"), f"cross__w{w}"
        traded, depth = F.expm1(t("volume_logsum")), F.expm1(m("log_depth_l1__last"))
        out |= {
            f"{prefix}__flow_alignment": flow * trade,
            f"{prefix}__flow_divergence": flow - trade,
            f"{prefix}__order_volume_per_depth": S.ratio_clear(F.expm1(o("volume_logsum")), depth),
            f"{prefix}__trade_volume_per_depth": S.ratio_clear(traded, depth),
            f"{prefix}__price_response_per_trade": S.ratio_clear(m("mid_bps__delta"), F.log1p(traded)),
            f"{prefix}__microprice_trade_divergence": m("microprice_bps__last") - t("price_bps__last"),
            f"{prefix}__cancel_trade_divergence": o("cancel_volume_rate") - F.abs(trade),
        }
    return rows.select("sample_id", *(v.alias(k) for k, v in out.items()))


def _order(w: int) -> tuple[dict[str, Column], dict[str, Column]]:
    count = {c: F.col(f"order__w{w}__{c}_count") for c in CATEGORIES}
    return count, {c: F.expm1(F.col(f"order__w{w}__{c}_volume_logsum")) for c in CATEGORIES}


def _action(x: dict[str, Column]) -> Column:
    return S.pressure(x["buy_new"] + x["sell_cancel"], x["sell_new"] + x["buy_cancel"])


def category_ratios() -> dict[str, Column]:
    out = {}
    for w in WINDOWS:
        p, (count, volume) = f"order__w{w}", _order(w)
        for c in CATEGORIES:
            out[f"{p}__{c}_count_share"] = S.ratio_positive(count[c], F.col(f"{p}__event_count"))
            out[f"{p}__{c}_volume_share"] = S.ratio_positive(volume[c], F.expm1(F.col(f"{p}__volume_logsum")))
    return out


def order_pressure() -> dict[str, Column]:
    out = {}
    for w in WINDOWS:
        p, (n, v) = f"order__w{w}", _order(w)
        out |= {
            f"{p}__new_count_imbalance": S.pressure(n["buy_new"], n["sell_new"]), f"{p}__cancel_count_imbalance": S.pressure(n["sell_cancel"], n["buy_cancel"]),
            f"{p}__new_volume_imbalance": S.pressure(v["buy_new"], v["sell_new"]), f"{p}__cancel_volume_imbalance": S.pressure(v["sell_cancel"], v["buy_cancel"]),
            f"{p}__action_count_pressure": _action(n),
            f"{p}__buy_cancel_count_rate": S.ratio_positive(n["buy_cancel"], n["buy_new"] + n["buy_cancel"]),
            f"{p}__sell_cancel_count_rate": S.ratio_positive(n["sell_cancel"], n["sell_new"] + n["sell_cancel"]),
            f"{p}__count_volume_pressure_divergence": _action(n) - _action(v),
        }
    return out


def temporal_dynamics() -> dict[str, Column]:
    """Short windows against the longest: changes, regimes and efficiency."""
    out = {}
    change = {
        "order_signed_volume_imbalance_change": "order__w{}__signed_volume_imbalance", "order_cancel_count_rate_change": "order__w{}__cancel_count_rate", "order_cancel_volume_rate_change": "order__w{}__cancel_volume_rate",
        "transaction_count_imbalance_change": "transaction__w{}__count_imbalance", "transaction_volume_imbalance_change": "transaction__w{}__volume_imbalance",
        "transaction_vwap_change": "transaction__w{}__vwap_bps", "transaction_price_mean_change": "transaction__w{}__price_bps__mean",
    }
    for w in WINDOWS[:-1]:
        out[f"dynamics__w{w}_w60__order_action_count_pressure_change"] = _action(_order(w)[0]) - _action(_order(60)[0])
        out |= {f"dynamics__w{w}_w60__{k}": F.col(v.format(w)) - F.col(v.format(60)) for k, v in change.items()}
    m = lambda w, n: F.col(f"market__w{w}__{n}")
    for w in (5, 10, 30, 60, 180):
        p = f"dynamics__w{w}_w600__"
        out[f"{p}mid_std_regime_ratio"] = S.ratio_positive(m(w, "mid_bps__std") * math.sqrt(600 / w), m(600, "mid_bps__std"))
        out[f"{p}realized_vol_regime_ratio"] = S.ratio_positive(m(w, "realized_vol_bps") / math.sqrt(w), m(600, "realized_vol_bps") / math.sqrt(600))
        out |= {f"{p}{k}": m(w, n) - m(600, n) for k, n in (("spread_mean_change", "spread_bps__mean"), ("mid_slope_change", "mid_bps__slope"), ("imbalance_l2_mean_change", "imbalance_l2__mean"))}
    for w in (5, 10, 30, 60, 180, 600):
        rv = m(w, "realized_vol_bps")
        out[f"dynamics__w{w}__trend_efficiency"] = S.ratio_positive(m(w, "mid_bps__delta"), rv)
        out[f"dynamics__w{w}__range_per_realized_vol"] = S.ratio_positive(m(w, "mid_bps__max") - m(w, "mid_bps__min"), rv)
    return out


def derived(rows: DataFrame, sets: tuple[str, ...]) -> DataFrame:
    """The rows with the columns of the named sets appended."""
    make = {"order_category_ratios": category_ratios, "order_pressure": order_pressure, "temporal_dynamics": temporal_dynamics}
    if unknown := sorted(set(sets) - set(make)):
        raise ValueError(f"unsupported derived feature sets: {unknown}")
    return rows.select("*", *(v.alias(k) for s in sets for k, v in make[s]().items()))


def select_exact(rows: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in rows.columns]:
        raise ValueError(f"features are missing: {missing[:5]}")
    return rows.select("sample_id", *names)


def exclude(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Without the feature columns that match a pattern, case included."""
    keep = [c for c in rows.columns if c == "sample_id" or not any(fnmatchcase(c, p) for p in patterns)]
    if keep == ["sample_id"]:
        raise ValueError("the patterns exclude every feature")
    return rows.select(*keep)


def as_features(rows: DataFrame) -> DataFrame:
    """Features as 32-bit floats; an infinite one is an error, a missing one is not."""
    def single(c: str) -> Column:
        x = F.col(c).cast("float")
        return F.when(F.abs(x) == float("inf"), F.raise_error(F.lit(f"{c} is infinite")).cast("float")).otherwise(x).alias(c)

    return rows.select("sample_id", *(single(c) for c in rows.columns if c != "sample_id"))
