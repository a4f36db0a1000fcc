"""Operators against NumPy and plain Python on random inputs, and on edges."""

import math
import random
from statistics import pstdev

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from tickloom.functions import aggregates as A
from tickloom.functions import scalars as S
from tickloom.operators import browse, clean, cross, folds, market, metrics, order, runs, sequences, training, transaction
from tickloom.operators import windows as W
from tickloom.schemas import RAW, compare_schema, schema
from tickloom.sources import store
from tickloom.sources.feather import MappedFeather, file_digest, read_feather


def one(df):
    return df.collect()[0]


def ticks(seed, samples=7, most=9, missing=0.3):
    """{sample: [(seconds, value or None, weight), ...]} in order, seconds falling."""
    r = random.Random(seed)
    out = {}
    for s in range(samples):
        at = sorted((round(r.uniform(0, 65), 3) for _ in range(r.randint(1, most))), reverse=True)
        out[s] = [(t, None if r.random() < missing else round(r.uniform(-50, 50), 4), r.choice([0.0, 1.5, 4.0, -2.0])) for t in at]
    return out


def frame(spark, data):
    rows, k = [], 0
    for s, events in data.items():
        for e in events:
            rows.append((s, k, *e))
            k += 1
    return spark.createDataFrame(rows, "sample_id int, row_seq int, seconds double, v double, weight double")


def least_squares(x, y):
    return 0.0 if max(x) == min(x) else float(np.polyfit(x, y, 1)[0])


@pytest.mark.parametrize("seed", [101, 102])
def test_series(spark, seed):
    data = ticks(seed)
    data[50] = [(5.0, None, 1.0)]
    stats = A.series("v", F.col("v"), ("mean", "delta", "slope", "std", "count", "sum", "first", "last", "min", "max"))
    block = frame(spark, data).groupBy("sample_id").agg(*(c.alias(k) for k, c in stats.items()))
    spine = spark.createDataFrame([(s,) for s in [*data, 99]], "sample_id int")
    got = {r.sample_id: r.asDict() for r in W.on_spine(spine, block, {"v__count", "v__sum"}).collect()}
    for s in got:
        xs = [(t, v) for t, v, _ in data.get(s, []) if v is not None]
        v = [x for _, x in xs]
        assert got[s]["v__count"] == len(v) and got[s]["v__sum"] == pytest.approx(sum(v))
        want = {"mean": np.mean(v), "delta": v[-1] - v[0], "slope": least_squares([-t for t, _ in xs], v), "std": pstdev(v), "first": v[0], "last": v[-1], "min": min(v), "max": max(v)} if v else {}
        for k in ("mean", "delta", "slope", "std", "first", "last", "min", "max"):
            assert got[s][f"v__{k}"] == (pytest.approx(want[k], abs=1e-9) if v else None)


def test_filling(spark):
    data = ticks(103, most=6, missing=0.6)
    out = frame(spark, data).select("sample_id", "row_seq", W.filled(F.col("v"), F.col("sample_id") * 1000.0).alias("v")).orderBy("row_seq").collect()
    want = []
    for s, events in data.items():
        v = [x for _, x, _ in events]
        for k in range(len(v)):
            back, ahead = [x for x in v[: k + 1] if x is not None], [x for x in v[k:] if x is not None]
            want.append(back[-1] if back else ahead[0] if ahead else s * 1000.0)
    assert [r.v for r in out] == want


def test_weighted_mean_and_transitions(spark):
    data = ticks(104)
    rows = frame(spark, data)
    got = {r[0]: r[1] for r in rows.groupBy("sample_id").agg(A.group_weighted_mean(F.col("v"), F.col("weight"))).collect()}
    for s, events in data.items():
        use = [(v, w) for _, v, w in events if v is not None and w > 0]
        assert got[s] == (pytest.approx(sum(v * w for v, w in use) / sum(w for _, w in use)) if use else None)
    for width in (8.0, 33.0, W.WHOLE):
        held = W.in_windows(W.with_lags(rows, "seconds"), (width,)).withColumn("inside", W.transition()).collect()
        assert len(held) == sum(t <= width for x in data.values() for t, _, _ in x)
        place = [(s, k) for s, x in data.items() for k in range(len(x))]
        for r in held:
            s, k = place[r.row_seq]
            assert r.inside == (k > 0 and data[s][k - 1][0] <= width and data[s][k][0] <= width)


@pytest.mark.parametrize(("price", "volume", "want"), [(0.73, 3.0, "valid"), (0.0, 0.0, "missing"), (0.0, 6.0, "inconsistent"), (2.5, 0.0, "inconsistent"), (-1.0, 4.0, "inconsistent")])
def test_book_levels(spark, price, volume, want):
    state = clean.book_level_state(F.lit(price), F.lit(volume))
    assert one(spark.range(1).select(state))[0] == want
    if want == "inconsistent":
        with pytest.raises(Exception, match="inconsistent"):
            spark.range(1).select(clean.strictly(state)).collect()


@pytest.mark.parametrize(("price", "volume", "count", "want"), [(3.25, 17.0, 4.0, "positive"), (None, 0.0, 0.0, "none"), (0.4, -9.0, -3.0, "correction"), (0.4, 9.0, -3.0, "inconsistent"), (None, 5.0, 1.0, "inconsistent"), (6.0, 0.0, 0.0, "inconsistent")])
def test_trade_states(spark, price, volume, count, want):
    rows = spark.createDataFrame([(price, volume, count)], "p double, v double, n double")
    assert one(rows.select(clean.trade_state(*map(F.col, "pvn"))))[0] == want


def test_scalars(spark):
    xs = [-1e6, -3.7, -1e-9, 0.0, 0.2, 12.5, 4e8]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.signed_log1p(F.col("x")).alias("l"), S.clip(F.col("x"), -2.5, 9.0).alias("c"), S.was_clipped(F.col("x"), -2.5, 9.0).alias("w")).collect()
    for r in got:
        assert r.l == pytest.approx(math.copysign(math.log1p(abs(r.x)), r.x)) and r.c == min(max(r.x, -2.5), 9.0) and r.w == (not -2.5 <= r.x <= 9.0)
    mids = spark.createDataFrame([(5.5, 4.5), (0.0, 3.0), (3.0, 0.0)], "a double, b double").select(S.midprice(F.col("a"), F.col("b"))).collect()
    assert [m[0] for m in mids] == [5.0, None, None]
    r = one(spark.range(1).select(S.ratio(F.lit(7.0), F.lit(0.0)), S.ratio_clear(F.lit(7.0), F.lit(-1e-14)), S.ratio_clear(F.lit(None).cast("double"), F.lit(2.0)), S.pressure(F.lit(1.0), F.lit(7.0)), S.log_bps(F.lit(0.0), F.lit(2.0)), S.clip(F.lit(None).cast("double"), 0.0, 1.0), S.pressure(F.lit(0.0), F.lit(0.0)), S.log_bps(F.lit(2.02), F.lit(2.0))))
    assert (r[0], r[1], r[2], r[3], r[5], r[6]) == (0, 0, None, -0.75, None, 0) and r[4] < -1e5 and r[7] == pytest.approx(math.log(1.01) * 1e4)


def test_spans_and_order(spark):
    r = random.Random(105)
    lengths = {s: r.randint(1, 5) for s in (2, 3, 8, 11)}
    ids = [s for s, n in lengths.items() for _ in range(n)]
    rows = spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "sample_id int, row_seq int")
    want, at = [], 0
    for s, n in lengths.items():
        want.append((s, at, n, at + n))
        at += n
    assert sorted(map(tuple, clean.sample_spans(rows).collect())) == want and clean.broken_spans(rows).isEmpty()
    torn = spark.createDataFrame([(4, 0), (4, 1), (6, 2), (4, 3), (6, 4)], "sample_id int, row_seq int")
    assert {x.sample_id for x in clean.broken_spans(torn).collect()} == {4, 6}
    data = ticks(106, samples=5)
    data[7] = [(30.0, 1.0, 1.0), (30.0, 1.0, 1.0), (31.0, 1.0, 1.0), (2.0, 1.0, 1.0), (2.0, 1.0, 1.0)]
    steps = [(a[0], b[0]) for x in data.values() for a, b in zip(x, x[1:], strict=False)]
    assert tuple(one(clean.sequence_order(frame(spark, data)))) == (sum(a == b for a, b in steps), sum(b > a for a, b in steps), False)


def test_schemas():
    assert all(compare_schema(s, s).ok for s in RAW.values())
    have = schema("volume int, sample_id int, price double, note string")
    report = compare_schema(have, schema("sample_id int, price float, volume int, side tinyint"))
    assert (report.missing_columns, report.extra_columns, report.type_mismatches, report.order_matches) == (("side",), ("note",), ("price",), False) and not report.ok


NAMES = "transaction_avgprice double, transaction_volume double, transaction_count double, ask_price_1 double, ask_volume_1 double, bid_price_1 double, bid_volume_1 double, ask_price_2 double, ask_volume_2 double, bid_price_2 double, bid_volume_2 double"


def events(spark, seed, samples=5):
    """Random snapshots, orders and trades; also as plain rows."""
    r, snaps, orders, trades = random.Random(seed), [], [], []
    for s in range(samples):
        for k in range(r.randint(1, 8)):
            mid, lean = 1 + r.gauss(0, 0.002), r.randint(-3, 3)
            kind = r.choice([0, 1, 1, -1])
            gone = r.random() < 0.15
            snaps.append((s, k, 90.0 - 11.25 * k, mid if kind else None, kind * 40.0, kind * 2.0, *((0.0, 0.0) if gone else (mid + 0.001, 500.0 + 50 * lean)), mid - 0.001, 500.0 - 50 * lean, mid + 0.002, 250.0, mid - 0.002, 260.0))
        orders += [(s, k, 57.0 - 9 * k, 1 + r.gauss(0, 0.02), float(r.randint(1, 25_000)), r.randint(0, 1), r.randint(0, 1)) for k in range(r.randint(1, 6))]
        trades += [(s, k, 58.5 - 7 * k, 1 + r.gauss(0, 0.01), float(r.randint(1, 15_000)), r.randint(0, 1)) for k in range(r.randint(1, 8))]
    made = (
        spark.createDataFrame(snaps, f"sample_id int, row_seq int, seconds double, {NAMES}"),
        spark.createDataFrame(orders, "sample_id int, row_seq int, seconds double, price double, volume double, side int, order_action int"),
        spark.createDataFrame(trades, "sample_id int, row_seq int, seconds double, price double, volume double, side int"),
    )
    return made, (snaps, orders, trades)


def test_blocks(spark):
    (snaps, orders, trades), (plain_snaps, plain_orders, plain_trades) = events(spark, 107)
    derived = market.derive(snaps)
    context = market.context(derived)
    blocks = market.block(snaps), order.block(orders, context), transaction.block(trades, context)
    assert [len(b.columns) - 1 for b in blocks] == [371, 188, 134]
    wide = cross.joined(*blocks).cache()
    x = cross.cross(wide)
    assert len(x.columns) - 1 == 42
    assert [len(cross.derived(wide, (s,)).columns) - len(wide.columns) for s in cross.SETS] == [48, 48, 77]
    for r in cross.as_features(wide).collect():
        for w in (1, 10, 60):
            o = [e for e in plain_orders if e[0] == r.sample_id and e[2] <= w]
            t = [e for e in plain_trades if e[0] == r.sample_id and e[2] <= w]
            volume, signed = sum(e[4] for e in o), sum(e[4] * (1 - 2 * e[5]) * (1 - 2 * e[6]) for e in o)
            assert r[f"order__w{w}__event_count"] == len(o) and r[f"order__w{w}__signed_volume_imbalance"] == pytest.approx(signed / volume if volume else 0, abs=1e-6)
            assert r[f"order__w{w}__large_order_rate"] == pytest.approx(sum(e[4] >= 10_000 for e in o) / len(o) if o else 0, abs=1e-6)
            assert r[f"transaction__w{w}__buy_count"] == sum(e[5] == 0 for e in t) and r[f"transaction__w{w}__volume_logsum"] == pytest.approx(math.log1p(sum(e[4] for e in t)), rel=1e-6)
            gaps = [a[2] - b[2] for a, b in zip(t, t[1:], strict=False)]
            assert r[f"transaction__w{w}__event_gap__max"] == (pytest.approx(max(gaps)) if gaps else None)
        own = [e for e in plain_snaps if e[0] == r.sample_id]
        assert r.market__row_count == len(own) and r.market__last_event_seconds == pytest.approx(own[-1][2]) and r.market__observed_span == pytest.approx(own[0][2] - own[-1][2])
        assert r.market__w30__rows == sum(e[2] <= 30 for e in own) and r.market__w600__correction_count == sum(e[4] < 0 for e in own)
        assert r.order__row_count == sum(e[0] == r.sample_id for e in plain_orders)


def test_named_statistics_are_the_same(spark):
    (snaps, orders, _), _ = events(spark, 108)
    whole, context = market.block(snaps), market.context(market.derive(snaps))
    some = market.block_of(market.derive(snaps), (5, 60), {"mid_bps__slope", "rows", "reference_mid"})
    assert set(some.columns) == {"sample_id", "market__reference_mid", *(f"market__w{w}__{s}" for w in (5, 60) for s in ("rows", "mid_bps__slope"))}
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*some.columns).collect()))
    some = order.block(orders, context, only={"cancel_count_rate"})
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, order.block(orders, context).select(*some.columns).collect()))


def test_choosing_features(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "sample_id int, `b__w1__x` double, `b__w2__x` double, `C__w1__x` double")
    assert cross.exclude(rows, ["b__w1*", "c__*"]).columns == ["sample_id", "b__w2__x", "C__w1__x"] and cross.select_exact(rows, ["C__w1__x"]).columns == ["sample_id", "C__w1__x"]
    for bad in (lambda: cross.derived(rows, ("none",)), lambda: cross.exclude(rows, ["*"]), lambda: cross.select_exact(rows, ["absent"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="infinite"):
        cross.as_features(rows.withColumn("b__w1__x", F.lit(1e300))).collect()


def test_order_sets(spark):
    r = random.Random(109)
    n = {c: float(r.randint(0, 9)) for c in cross.CATEGORIES}
    v = {c: x * r.uniform(1, 50) for c, x in n.items()}
    cols = {f"order__w{w}__{c}_count": F.lit(n[c]) for w in cross.WINDOWS for c in n} | {f"order__w{w}__{c}_volume_logsum": F.log1p(F.lit(v[c])) for w in cross.WINDOWS for c in v}
    cols |= {f"order__w{w}__{k}": x for w in cross.WINDOWS for k, x in (("event_count", F.lit(sum(n.values()))), ("volume_logsum", F.log1p(F.lit(sum(v.values())))))}
    got = one(cross.derived(spark.range(1).select(F.col("id").alias("sample_id"), *(c.alias(k) for k, c in cols.items())), ("order_pressure", "order_category_ratios")))
    lean = lambda a, b: (a - b) / (a + b) if a + b else 0.0
    assert got.order__w5__new_count_imbalance == pytest.approx(lean(n["buy_new"], n["sell_new"]))
    assert got.order__w5__cancel_volume_imbalance == pytest.approx(lean(v["sell_cancel"], v["buy_cancel"]))
    act = {k: lean(x["buy_new"] + x["sell_cancel"], x["sell_new"] + x["buy_cancel"]) for k, x in (("n", n), ("v", v))}
    assert got.order__w30__action_count_pressure == pytest.approx(act["n"]) and got.order__w30__count_volume_pressure_divergence == pytest.approx(act["n"] - act["v"])
    for c in n:
        assert got[f"order__w2__{c}_count_share"] == pytest.approx(n[c] / sum(n.values())) and got[f"order__w2__{c}_volume_share"] == pytest.approx(v[c] / sum(v.values()))


def test_folds(spark):
    for bad in ((0, 9, 9, 12), (5, 4, 8, 9), (0, 3, 7, 6)):
        with pytest.raises(ValueError):
            folds.MonthFold("x", *bad)
    two = (folds.MonthFold("one", 2, 5, 7, 8), folds.MonthFold("two", 2, 8, 9, 20))
    months = [m for m in range(12) for _ in range(m % 3 + 1)]
    out = folds.in_folds(spark.createDataFrame([(m,) for m in months], "month int"), two)
    got = sorted((r.fold, r.part, r.month) for r in out.collect())
    want = [(f.name, p, m) for f in two for m in months for p, lo, hi in (("train", f.train_start, f.train_end), ("valid", f.valid_start, f.valid_end)) if lo <= m <= hi]
    assert got == sorted(want) and folds.require_parts(out, two) is out
    with pytest.raises(ValueError, match="empty"):
        folds.require_parts(out.where("month < 9"), two)
    assert {(r.fold, r.month) for r in folds.recent_months(out.where("part = 'train'"), 2).collect()} == {("one", 4), ("one", 5), ("two", 7), ("two", 8)}
    with pytest.raises(ValueError):
        folds.recent_months(out, 0)


def test_bounds(spark):
    r = np.random.default_rng(110)
    x = {"u": r.normal(size=41), "w": r.normal(size=23)}
    rows = spark.createDataFrame([(f, float(v), None) for f, xs in x.items() for v in xs], "fold string, a double, b double")
    held = {(b.fold, b.feature): b for b in folds.clip_bounds(rows, ["a", "b"], (0.1, 0.85)).collect()}
    for f, xs in x.items():
        assert (held[f, "a"].low, held[f, "a"].high) == pytest.approx(tuple(np.quantile(xs, [0.1, 0.85]))) and (held[f, "b"].low, held[f, "b"].missing_rate) == (None, 1)
    bounds = folds.loaded_bounds(spark, folds.saved_bounds(folds.clip_bounds(rows, ["a", "b"], (0.1, 0.85))))
    probe = spark.createDataFrame([(f, v, v) for f in x for v in (-90.0, 0.0, 90.0, None)] + [("other", 90.0, 1.0)], "fold string, a double, b double")
    for row in folds.clipped(probe, bounds, ["a", "b"]).collect():
        if row.a is not None and row.fold in x:
            assert held[row.fold, "a"].low - 1e-12 <= row.a <= held[row.fold, "a"].high + 1e-12
        assert row.b in (-90, 0, 90, None, 1)


def test_targets(spark):
    r = np.random.default_rng(111)
    t, month = r.normal(3, 2, 60), np.repeat([4, 9, 30], 20)
    month[-1], t[-1] = 31, 8.0  # a month of one row
    rows = spark.createDataFrame(list(zip(range(60), t.tolist(), month.tolist(), strict=True)), "sample_id int, target double, month int")
    z = {x.sample_id: x.scaled for x in folds.normalized(rows, "monthly_zscore").collect()}
    d = {x.sample_id: x.scaled for x in folds.normalized(rows, "monthly_std").collect()}
    for k in range(60):
        own = t[month == month[k]]
        scale = own.std() if len(own) > 1 else 1.0
        assert z[k] == pytest.approx((t[k] - own.mean()) / scale) and d[k] == pytest.approx(t[k] / scale)
    with pytest.raises(ValueError):
        folds.normalized(rows, "yearly")
    lo, hi = np.quantile(t, [0.2, 0.7])
    assert sorted(x.target for x in folds.clip_target(rows, (0.2, 0.7)).collect()) == pytest.approx(sorted(np.clip(t, lo, hi)))
    raw = 0.5 ** ((month.max() - month) / 6)
    assert {x.sample_id: x.weight for x in folds.recency_weights(rows, 6).collect()} == {k: pytest.approx(w) for k, w in enumerate(raw / raw.mean())}


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def test_scores(spark):
    r = np.random.default_rng(112)
    t, p, month = r.normal(size=50), r.normal(size=50), r.integers(0, 4, 50)
    rows = spark.createDataFrame([(float(a), float(b), int(m)) for a, b, m in zip(t, p, month, strict=True)], "target double, prediction double, month int")
    got, each = one(metrics.cosine_report(rows)), {m: cosine(t[month == m], p[month == m]) for m in set(month.tolist())}
    assert got.global_score == pytest.approx(cosine(t, p)) and got.monthly_mean == pytest.approx(np.mean(list(each.values()))) and got.monthly_std == pytest.approx(np.std(list(each.values())))
    assert got.worst_month == min(each, key=each.get) and got.worst_score == pytest.approx(min(each.values()))
    with pytest.raises(Exception, match="zero-norm"):
        metrics.required(metrics.cosine_report(rows.withColumn("prediction", F.lit(0.0)))).collect()
    assert metrics.baseline_report(rows, {"x": "absent"}).isEmpty()


def test_gate(spark):
    def gate(rows):
        return one(metrics.baseline_gate(spark.createDataFrame(rows, "fold string, begin int, name string, score double")))

    # The folds' names sort otherwise than their months.
    rows = [(f"fold_{k}", 10 * k, n, s) for k, model, a, b in ((9, 0.1, 0.3, 0.0), (10, 0.5, 0.2, 0.1), (11, 0.6, 0.1, 0.2)) for n, s in (("model", model), ("a", a), ("b", b))]
    g = gate(rows)
    assert (g.passed, g.late_folds_passed, g.best_baseline) == (True, True, "a") and g.model_fold_mean == pytest.approx(0.4)
    assert not gate([(f, m, n, s - (0.55 if (f, n) == ("fold_11", "model") else 0)) for f, m, n, s in rows]).passed
    undecided = gate([r for r in rows if r[2] == "model"])
    assert (undecided.passed, undecided.best_baseline) == (False, None)


def oof(spark, xs, months=None):
    return spark.createDataFrame([(k, 47 + k % 3, 0.3 * k - 1, f"f{k % 2}", float(x)) for k, x in enumerate(xs)], "sample_id int, month int, target double, fold string, prediction double")


def predictions(df):
    return [r.prediction for r in df.orderBy("sample_id").collect()]


def test_runs(spark):
    r = np.random.default_rng(113)
    xs = r.normal(size=(3, 12))
    a, b, c = (oof(spark, x) for x in xs)
    assert predictions(runs.ensemble([a, b, c], seeds=[3, 1, 4])) == pytest.approx((3 * xs[0] + xs[1] + 4 * xs[2]) / 8)
    assert predictions(runs.ensemble([a, b])) == pytest.approx((xs[0] + xs[1]) / 2)
    unit = xs / np.linalg.norm(xs, axis=1, keepdims=True)
    assert predictions(runs.blend([a, b, c], [0.2, 0.5, 1.3])) == pytest.approx((0.2 * unit[0] + 0.5 * unit[1] + 1.3 * unit[2]) / 2)
    assert predictions(runs.blend([a, b], [1, 4], normalize=False)) == pytest.approx((xs[0] + 4 * xs[1]) / 5)
    for bad in ([1.0, -1.0], [1.0], [float("inf"), 1.0]):
        with pytest.raises(ValueError):
            runs.weights_of(bad, 2)


def test_runs_that_differ(spark):
    a = oof(spark, range(1, 7))
    short, twice, other = a.where("sample_id != 4"), a.union(a.where("sample_id = 2")), a.withColumn("target", F.when(F.col("sample_id") == 3, 9.0).otherwise(F.col("target")))
    assert runs.same_rows(a, a.orderBy(F.desc("sample_id")))
    for bad, keys in ((short, {4}), (twice, {2}), (other, {3})):
        assert not runs.same_rows(a, bad) and {r.sample_id for r in runs.contract_violations([a, a, bad]).collect()} == keys
        for put in (runs.ensemble, runs.blend):
            with pytest.raises(Exception, match="runs differ"):
                put([a, bad]).collect()


def test_search_and_transform(spark):
    r = np.random.default_rng(114)
    x, y = r.normal(size=(2, 9))
    a, b = oof(spark, x), oof(spark, y)
    t = np.array([0.3 * k - 1 for k in range(9)])
    u, v = x / np.linalg.norm(x), y / np.linalg.norm(y)
    scores = [cosine(t, (1 - k / 100) * u + k / 100 * v) for k in range(101)]
    search = runs.weight_search(runs.aligned(a, b))
    assert [z.score for z in search.orderBy("weight").collect()] == pytest.approx(scores)
    rows, best = runs.blend_found(a, b)
    w = int(np.argmax(scores)) / 100
    assert best["weight"] == w and best["score"] == pytest.approx(max(scores)) and predictions(rows) == pytest.approx((1 - w) * u + w * v)
    assert len(runs.weight_search(runs.aligned(a, b.where("sample_id < 5"))).collect()) == 101
    with pytest.raises(Exception, match="disagree"):
        runs.aligned(a, b.withColumn("month", F.col("month") + 1)).collect()
    for center in (True, False):
        z = x - x.mean() if center else x
        assert predictions(runs.signed_power(a, 0.7, center)) == pytest.approx(np.sign(z) * (np.abs(z) / x.std()) ** 0.7)
    with pytest.raises(Exception, match="vary"):
        runs.signed_power(oof(spark, [5, 5, 5]), 2.0).collect()


def test_submission(spark, tmp_path):
    template = spark.createDataFrame([(k, 0.0) for k in (2, 0, 1)], "sample_id int, prediction double")
    rows = runs.submission(template, oof(spark, [0.125, -7.5, 3e-9]))
    store.write_submission(rows, tmp_path / "s.csv")
    lines = (tmp_path / "s.csv").read_text().splitlines()
    assert lines[0] == "sample_id,prediction" and [(int(k), float(p)) for k, p in (x.split(",") for x in lines[1:])] == [(0, 0.125), (1, -7.5), (2, 3e-9)]
    assert store.read_submission(spark, tmp_path / "s.csv").count() == 3 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["s.csv"]
    with pytest.raises(Exception, match="missing"):
        runs.submission(template, oof(spark, [1.0])).collect()
    with pytest.raises(ValueError, match="zero"):
        store.write_submission(rows.withColumn("prediction", F.lit(0.0)), tmp_path / "z.csv")
    with pytest.raises(ValueError, match="once"):
        store.write_submission(rows.where("sample_id > 0"), tmp_path / "z.csv")


def test_vectors(spark, tmp_path):
    xs = np.random.default_rng(115).normal(size=321)
    rows = spark.createDataFrame(list(enumerate(xs.tolist())), "sample_id int, prediction double").orderBy(F.rand(3))
    store.write_vector(rows, f"file://{tmp_path}/x.npy")
    assert np.load(tmp_path / "x.npy").tolist() == xs.tolist()
    np.save(tmp_path / "y.npy", xs[:7])
    assert [r.prediction for r in store.read_vector(spark, f"file://{tmp_path}/y.npy").orderBy("sample_id").collect()] == xs[:7].tolist()
    np.save(tmp_path / "z.npy", xs.astype("f4"))
    with pytest.raises(ValueError):
        store.read_vector(spark, f"file://{tmp_path}/z.npy")


def test_sequences(spark):
    (snaps, _, trades), (plain_snaps, _, plain_trades) = events(spark, 116)
    reference = spark.createDataFrame([(s, 1.0 + s / 100) for s in range(5)], "sample_id int, reference double")
    d = transaction.derive(trades, reference)
    names = [*(f"f{k}" for k in range(6)), "side_code"]
    for r in sequences.padded(sequences.transaction_rows(d), 4, names).collect():
        own = [e for e in plain_trades if e[0] == r.sample_id]
        last = own[-4:]
        assert r["mask"] == [False] * (4 - len(last)) + [True] * len(last)
        for x, e in zip(r["features"][4 - len(last) :], last, strict=True):
            k = own.index(e)
            bps = [math.log(y[3] / (1.0 + r.sample_id / 100)) * 1e4 for y in own]
            want = [min(e[2] / 60, 1), (own[k - 1][2] - e[2]) / 60 if k else 0, max(-10, min(10, bps[k] / 100)), max(-10, min(10, (bps[k] - bps[k - 1]) / 10)) if k else 0, math.log1p(e[4]) / 10, float(k > 0 and e[5] == own[k - 1][5]), e[5] + 1]
            assert x == pytest.approx(want, rel=1e-5, abs=1e-6)
        assert all(x == [0] * 7 for x in r["features"][: 4 - len(last)])
    for r in sequences.grid_arrays(sequences.grid(d)).collect():
        bins = {59 - int(e[2]) for e in plain_trades if e[0] == r.sample_id}
        assert len(r["grid"]) == 60 and {k for k, x in enumerate(r["grid"]) if x[9] == 1} == bins
    assert {r.bin for r in sequences.grid(d.withColumn("seconds", F.lit(1234.0))).where("g9 = 1").collect()} == {0}
    rows = sequences.market_rows(market.derive(snaps))
    assert len(rows.columns) == 17 and sequences.unsound(sequences.padded(rows, 5, [f"f{k}" for k in range(15)])).isEmpty()
    broken = sequences.padded(rows.withColumn("f3", F.lit(float("nan"))), 5, ["f3"])
    assert sequences.unsound(broken).count() == 5


def test_training(spark):
    r = np.random.default_rng(117)
    x = r.normal(size=(900, 3))
    t = x @ [0.5, -1.5, 0.0] + r.normal(size=900)
    month = r.integers(0, 71, 900)
    rows = [(k, int(month[k]), float(t[k]), *(None if r.random() < 0.02 else float(v) for v in x[k])) for k in range(900)]
    df = spark.createDataFrame(rows, "sample_id int, month int, target double, a double, b double, c double")
    plan = training.Plan(seeds=(5, 6))
    out, found = training.rolling(df, ["a", "b", "c"], plan)
    got = out.collect()
    assert len(got) == ((month >= 47)).sum() and len({y.sample_id for y in got}) == len(got) and cosine([y.target for y in got], [y.prediction for y in got]) > 0.75
    assert set(found["best"]) == {f.name for f in folds.FOLDS} and found["rounds"] == training.median_rounds([b for y in found["best"].values() for b in y.values()])
    assert training.median_rounds([1, 2, 4, 5]) == 3 and training.median_rounds([1, 2, 2, 3, 9]) == 2 and training.median_rounds([2, 3]) == 2
    test, models = training.full(df, df.drop("target", "month"), ["a", "b", "c"], plan, found["rounds"])
    assert test.count() == 900 and models[0].importance()[0][0] == "b" and models[0].importance()[-1][0] == "c"
    again, _ = training.full(df.repartition(5), df.drop("target", "month"), ["a", "b", "c"], plan, found["rounds"])
    assert predictions(again) == pytest.approx(predictions(test))
    # Without a penalty the fit is the least squares solution.
    whole = df.na.fill(0.0).withColumn("weight", F.lit(1.0))
    m = training.RidgePath(first=0.0, share=1.0).fit(whole, ["a", "b", "c"], 1, rounds=0)
    filled = np.array([[y.a, y.b, y.c, y.target] for y in whole.collect()])
    want = np.linalg.lstsq(np.column_stack([np.ones(900), filled[:, :3]]), filled[:, 3], rcond=None)[0]
    assert m.weights[1:] / m.scale == pytest.approx(want[1:], rel=1e-6)
    for bad in ({"seeds": ()}, {"seeds": (1, 1)}, {"normalization": "x"}, {"feature_clip": (0.5, 0.5)}, {"depth": 3}):
        with pytest.raises(ValueError):
            training.Plan.of(bad)


def test_browsing(spark):
    rows = spark.createDataFrame([(k % 3, k, None if k == 4 else k / 2, "t") for k in range(20)], "sample_id int, row_seq int, x double, name string")
    assert [r.row_seq for r in browse.page(rows, ["row_seq"], 5, 4).collect()] == [5, 6, 7, 8] and browse.page(rows, ["row_seq"], 19, 4).count() == 1
    with pytest.raises(ValueError):
        browse.page(rows, ["row_seq"], -1, 4)
    said = {r.name: r for r in browse.describe(rows).collect()}
    assert (said["x"].filled, said["x"].high, said["name"].low, said["name"].filled, said["row_seq"].mean) == (19, 9.5, None, 20, 9.5)
    assert [r.row_seq for r in browse.one_sample(rows, 1).collect()] == [1, 4, 7, 10, 13, 16, 19]
    many = spark.range(4000).select(F.col("id").cast("int").alias("sample_id"), F.lit(0).alias("shard"))
    parts = {r.sample_id: r.part for r in browse.split(many, 7).collect()}
    assert 0.77 < sum(p == "train" for p in parts.values()) / 4000 < 0.83 and parts == {r.sample_id: r.part for r in browse.split(many.repartition(3), 7).collect()}
    a, b = ({r.sample_id: r.place for r in browse.shuffled(many, s, 64).collect()} for s in (1, 2))
    assert sorted(a.values()) == list(range(4000)) and a != b and browse.shuffled(many, 1, 64).agg(F.max("batch")).first()[0] == 62


def test_feather(spark, tmp_path):
    path = str(tmp_path / "t.feather")
    r = np.random.default_rng(118)
    table = pa.table({"month": pa.array(r.integers(0, 9, 1000), pa.int16()), "sample_id": pa.array(np.arange(1000), pa.int32()), "target": pa.array(np.where(r.random(1000) < 0.1, np.nan, r.normal(size=1000)), pa.float32())})
    for compression in ("lz4", "uncompressed"):
        feather.write_feather(table, path, compression=compression, chunksize=130)
        rows = read_feather(spark, path, ["target", "sample_id"]).orderBy("row_seq").collect()
        assert [(x.row_seq, x.sample_id) for x in rows] == [(k, k) for k in range(1000)] and np.array_equal([x.target for x in rows], table.column("target").to_numpy(), equal_nan=True)
        assert read_feather(spark, f"file://{path}").agg(F.sum("month")).first()[0] == table.column("month").to_numpy().sum() and read_feather(spark, path).select("row_seq").distinct().count() == 1000
    with pytest.raises(Exception, match="no such columns"):
        read_feather(spark, path, ["absent"])
    with MappedFeather(path) as f:
        assert f.read_columns(["month"]).equals(table.select(["month"])) and f.schema.names == ["month", "sample_id", "target"]
    for use in (lambda: f.read_columns(["month"]), lambda: f.schema):
        with pytest.raises(RuntimeError):
            use()
    before = file_digest(path)
    feather.write_feather(table.slice(0, 999), path)
    assert file_digest(path) != before


def test_catalog(spark, tmp_path):
    (tmp_path / "train").mkdir()
    label = pa.table({"month": pa.array([3, 3], pa.int16()), "sample_id": pa.array([1, 0], pa.int32()), "target": pa.array([0.25, float("inf")], pa.float32())})
    feather.write_feather(label, str(tmp_path / "train" / "label.feather"))
    catalog = store.Catalog(spark, tmp_path)
    assert store.load_labels(catalog).where("target is null").count() == 1 and catalog.read("train", "label", max_samples=1).count() == 1
    report = {(s, t): r for s, t, r in catalog.validate()}
    assert report["train", "label"].ok and report["test", "market"] is None and len(store.failed(catalog.validate())) == 6
    feather.write_feather(label.set_column(1, "sample_id", pa.array([1, 1], pa.int32())), str(tmp_path / "train" / "label.feather"))
    with pytest.raises(ValueError, match="once"):
        store.load_labels(catalog)


@pytest.mark.parametrize("uri", [False, True])
def test_tables(spark, tmp_path, uri):
    t = store.Tables(spark, f"file://{tmp_path}/t" if uri else tmp_path / "t")
    rows = spark.range(37).select(F.col("id").cast("int").alias("sample_id"), (F.col("id") * 2).alias("x"))
    m = t.build(rows, "features", "train", "a", source="1", note="kept")
    assert m["row_count"] == 37 and m["note"] == "kept" and t.sound("features", "train", "a") and t.build(rows.limit(0), "features", "train", "a", source="1") == m
    folder = tmp_path / "t" / "features" / "train" / "a" / m["at"]
    part = next(p for p in folder.glob("part-*"))
    part.write_bytes(b"broken")
    for crc in folder.glob(".part-*.crc"):
        crc.unlink()
    assert not t.sound("features", "train", "a")
    again = t.build(rows, "features", "train", "a", source="1")
    assert again["rows"] == m["rows"] and again["at"] != m["at"] and not folder.exists() and t.sound("features", "train", "a")
    with pytest.raises(Exception, match="broken on purpose"):  # the table that was there stays
        t.build(rows.withColumn("x", F.raise_error(F.lit("broken on purpose")).cast("long")), "features", "train", "a", source="2")
    assert t.load("features", "train", "a").count() == 37
    t.build(rows.withColumnRenamed("x", "y"), "features", "train", "b")
    assert t.load_blocks("train", ("a", "b")).columns == ["sample_id", "x", "y"]
    t.build(rows.where("sample_id > 0").withColumnRenamed("x", "z"), "features", "train", "c")
    with pytest.raises(ValueError, match="different samples"):
        t.load_blocks("train", ("a", "c"))
    with pytest.raises(KeyError):
        t.load_blocks("train", ("d",))
    assert store.identity(a=1, b="x") == store.identity(b="x", a=1) != store.identity(a="1", b="x")
