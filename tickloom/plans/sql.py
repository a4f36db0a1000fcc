"""Pieces of the SQL that checks the queries."""

from __future__ import annotations

TXN = """txn as (
    select user_id as sample_id, row_number() over (partition by user_id order by ts, event_id) as row_seq,
           (max(epoch_us(ts)) over (partition by user_id) - epoch_us(ts)) / 1e6 / 43200 as seconds,
           1 + value / 1000e0 as price, round(value * 100) as volume,
           case when event_type in ('click', 'view') then 0 else 1 end as side
    from events)"""

_LINES = """select l_suppkey as sample_id, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as row_seq,
           date_diff('day', l_shipdate, timestamp '2001-11-04') * {span}e0 / 2498 as seconds, *
    from lineitem"""

ORD = f"""lines as ({_LINES.format(span=60)}), ord as (
    select sample_id, row_seq, seconds, case when l_linenumber = 7 then 1.6e0 else 1 + (l_discount - l_tax) / 10 end as price, l_quantity * 400 as volume,
           case when l_returnflag = 'N' then 1 else 0 end as side, case when l_linestatus = 'O' then 0 else 1 end as order_action
    from lines)"""


def _side(gone: str, value: str) -> str:
    return f"case when {gone} then 0e0 else {value} end"


SNAP = f"""mlines as ({_LINES.format(span=600)}), snap as (
    select sample_id, row_seq, seconds,
           case when l_returnflag <> 'N' then 1 + (l_discount - 0.05e0) / 10 end as avgprice,
           case l_returnflag when 'A' then l_quantity * 10 when 'R' then l_quantity * -10 else 0e0 end as tv,
           (case l_returnflag when 'A' then l_linenumber when 'R' then -l_linenumber else 0 end)::double as tc,
           {_side("l_linenumber = 7", "1 + l_tax / 10")} as a1, {_side("l_linenumber = 7", "l_quantity * 100")} as av1,
           {_side("l_linenumber = 1", "1 - l_discount / 10")} as b1, {_side("l_linenumber = 1", "(51 - l_quantity) * 100")} as bv1,
           {_side("l_linenumber = 7", "1.001e0 + l_tax / 10")} as a2, {_side("l_linenumber = 7", "l_quantity * 120")} as av2,
           {_side("l_linenumber = 1", "0.999e0 - l_discount / 10")} as b2, {_side("l_linenumber = 1", "(51 - l_quantity) * 120")} as bv2
    from mlines)"""

_W = "partition by sample_id order by row_seq"
_ALL = f"over ({_W} rows between unbounded preceding and unbounded following)"
DERIVED = f"""{SNAP}, m1 as (
    select *, a1 > 0 and av1 > 0 and b1 > 0 and bv1 > 0 as ok1, a2 > 0 and av2 > 0 and b2 > 0 and bv2 > 0 as ok2,
           case when avgprice > 0 and tv > 0 and tc > 0 then 'positive' when avgprice is null and tv = 0 and tc = 0 then 'none'
                when avgprice > 0 and tv < 0 and tc < 0 then 'correction' else 'inconsistent' end as trade
    from snap), m2 as (
    select *, case when ok1 then (a1 + b1) / 2 end as mid from m1), m3 as (
    select *, last_value(mid ignore nulls) {_ALL} as last_mid, last_value(case when a1 > 0 then a1 end ignore nulls) {_ALL} as last_ask,
           last_value(case when b1 > 0 then b1 end ignore nulls) {_ALL} as last_bid from m2), m4 as (
    select *, coalesce(last_mid, (last_ask + last_bid) / 2, last_ask, last_bid) as found from m3), m5 as (
    select *, case when found > 0 then found else 1e0 end as reference_mid, coalesce(found <= 0, true) as no_valid_mid from m4), m6 as (
    select *, coalesce(last_value(mid ignore nulls) over ({_W} rows between unbounded preceding and current row),
                       first_value(mid ignore nulls) over ({_W} rows between current row and unbounded following), reference_mid) as mid_filled from m5), m7 as (
    select *, ln(greatest(mid_filled, 1e-12) / reference_mid) * 1e4 as mid_bps, case when ok1 then (a1 - b1) / mid * 1e4 end as spread_bps,
           case when ok1 then ln((a1 * bv1 + b1 * av1) / (av1 + bv1) / mid_filled) * 1e4 end as microprice_bps,
           case when bv1 + av1 > 0 then (bv1 - av1) / (bv1 + av1) else 0e0 end as imbalance_l1,
           case when bv1 + bv2 + av1 + av2 > 0 then (bv1 + bv2 - av1 - av2) / (bv1 + bv2 + av1 + av2) else 0e0 end as imbalance_l2,
           ln(1 + av1 + bv1) as log_depth_l1, ln(1 + av1 + bv1 + av2 + bv2) as log_depth_l2,
           case when trade = 'positive' then ln(greatest(avgprice, 1e-12) / mid_filled) * 1e4 else 0e0 end as trade_price_bps,
           case when trade = 'positive' then tv else 0e0 end as pv, case when trade = 'positive' then tc else 0e0 end as pc,
           case when trade = 'correction' then tv else 0e0 end as cv, case when trade = 'correction' then tc else 0e0 end as cc
    from m6), mk as (
    select *, lag(seconds) over ({_W}) as prev_seconds, mid_bps - lag(mid_bps) over ({_W}) as mid_return from m7)"""


def series(prefix: str, v: str, stats: tuple[str, ...], where: str = "true") -> dict[str, str]:
    keep = f"filter (where {v} is not null and {where})"
    make = {
        "first": f"arg_min({v}, row_seq) {keep}", "last": f"arg_max({v}, row_seq) {keep}", "mean": f"avg({v}) {keep}", "std": f"stddev_pop({v}) {keep}", "min": f"min({v}) {keep}", "max": f"max({v}) {keep}",
        "delta": f"arg_max({v}, row_seq) {keep} - arg_min({v}, row_seq) {keep}", "sum": f"coalesce(sum({v}) {keep}, 0e0)", "count": f"count({v}) {keep}",
        "slope": f"case when count({v}) {keep} > 0 then case when max(seconds) {keep} > min(seconds) {keep} then regr_slope({v}, -seconds) {keep} else 0e0 end end",
    }
    return {f"{prefix}__{s}": make[s] for s in stats}


def rounded(columns: dict[str, str], digits: int = 6, shift: str = "") -> str:
    return ", ".join(f"round(({v})::double{shift}, {digits}) as {k}" for k, v in columns.items())


#: Moves values that lie halfway between two roundings, as means of short decimals do.
OFF_TIES = " + 1e-9"


def windows(*ws: float) -> str:
    return "windows(w) as (values " + ", ".join(f"({w}e0)" for w in ws) + ")"


LABELS = """lab as (
    select o_orderkey as sample_id, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 as month, (o_totalprice - 250000) / 1e6 as target,
           (o_totalprice % 1000 - 480) / 1000 as a, (o_custkey % 97 - 45) / 100e0 as b
    from orders)"""

FOLDS = "folds(fold, t0, t1, v0, v1) as (values ('f1', 0, 46, 47, 54), ('f2', 0, 54, 55, 62), ('f3', 0, 62, 63, 66), ('f4', 0, 66, 67, 70))"
COS = "sum({t} * {p}) / (sqrt(sum({t} * {t})) * sqrt(sum({p} * {p})))"


def cos(t: str, p: str) -> str:
    return COS.format(t=t, p=p)
