"""Commands over a Spark session: validate, build, look, train, evaluate, combine and submit."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import browse, clean, cross, folds, market, metrics, order, rounds, runs, sequences, training, transaction
from .operators import windows as W
from .sources import store

BLOCKS = ("market", "order", "transaction", "cross")
EVENTS = ("market", "order", "transaction")
#: Counts up with every change of what a build makes.
VERSION = 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickloom", description=__doc__)
    p.add_argument("--data", required=True, help="folder of the feather files")
    p.add_argument("--work", required=True, help="folder of what is built")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("validate")
    for name in ("build-cache", "build-features", "build-sequences"):
        c = commands.add_parser(name)
        c.add_argument("--split", choices=(*store.SPLITS, "all"), default="all")
        c.add_argument("--max-samples", type=int)
        c.add_argument("--resume", action="store_true")
    v = commands.add_parser("view")
    v.add_argument("--split", choices=store.SPLITS, default="train")
    v.add_argument("--table", required=True)
    v.add_argument("--sample", type=int)
    v.add_argument("--offset", type=int, default=0)
    v.add_argument("--limit", type=int, default=20)
    v.add_argument("--describe", action="store_true")
    b = commands.add_parser("baselines")
    b.add_argument("--max-samples", type=int)
    t = commands.add_parser("train-tabular")
    t.add_argument("--run-id", required=True)
    t.add_argument("--sets", nargs="*", default=[], choices=cross.SETS)
    t.add_argument("--exclude", nargs="*", default=[])
    t.add_argument("--settings", type=json.loads, default={}, help="a JSON object of what a plan of training names")
    t = commands.add_parser("predict-test")
    t.add_argument("--run-id", required=True)
    q = commands.add_parser("research-20")
    q.add_argument("--queue", required=True, help="a JSON list of rounds: name, reason, sets, exclude, settings")
    e = commands.add_parser("evaluate-oof")
    e.add_argument("--run-id", required=True)
    for name in ("ensemble", "blend"):
        c = commands.add_parser(name)
        c.add_argument("--run-id", nargs="+", required=True)
        c.add_argument("--weight", nargs="+", type=float)
        c.add_argument("--output", required=True)
        if name == "blend":
            c.add_argument("--no-normalize", action="store_false", dest="normalize")
    s = commands.add_parser("postprocess")
    s.add_argument("--run-id", required=True)
    s.add_argument("--power", type=float, required=True)
    s.add_argument("--center", action="store_true")
    s.add_argument("--output", required=True)
    w = commands.add_parser("blend-search")
    w.add_argument("--run-id", nargs=2, required=True)
    w.add_argument("--output")
    m = commands.add_parser("make-submission")
    m.add_argument("--run-id", required=True)
    m.add_argument("--output", required=True)
    return p


def build_cache(catalog: store.Catalog, tables: store.Tables, split: str, n: int | None, resume: bool) -> dict[str, dict]:
    """Cleaned tables in shards, sorted by sample; manifests by table. A table is built again if its file's bytes change.
    Rows of a sample must lie together in the file, with seconds that never rise."""
    made = {}
    for t in store.tables(split):
        source = store.identity(file=catalog.source(split, t), samples=n, version=VERSION)
        rows = catalog.read(split, t, max_samples=n)
        if t != "label" and not (resume and (tables.manifest("cache", split, t) or {}).get("source") == source):
            if not clean.broken_spans(rows).isEmpty():
                raise ValueError(f"{split} {t}: the rows of some sample do not lie together")
            if not clean.sequence_order(rows.withColumn("seconds", F.col("seconds_before_predict"))).first()["ok"]:
                raise ValueError(f"{split} {t}: seconds rise within a sample")
        made[t] = tables.build(rows, "cache", split, t, source=source, resume=resume, shards=True)
    return made


def _cached(tables: store.Tables, split: str) -> dict[str, DataFrame]:
    return {t: tables.load("cache", split, t).withColumn("seconds", F.col("seconds_before_predict").cast("double")) for t in EVENTS}


def spine(catalog: store.Catalog, tables: store.Tables, split: str, n: int | None) -> DataFrame:
    """The samples that rows are asked for: those with labels, or of the template of the submission."""
    if split == "train":
        return tables.load("cache", split, "label").select("sample_id")
    ids = store.read_submission(catalog.spark, catalog.folder.at("submission.csv")).select("sample_id")
    return ids if n is None else ids.where(F.col("sample_id") < n)


def build_features(catalog: store.Catalog, tables: store.Tables, split: str, n: int | None, resume: bool) -> None:
    """The four blocks of every sample of the spine, also of those without events. Snapshots are derived once: the
    references that orders and trades need are read back from the market block."""
    cache = build_cache(catalog, tables, split, n, resume)
    rows, samples = _cached(tables, split), spine(catalog, tables, split, n)
    source = store.identity(cache={t: m["rows"] for t, m in cache.items()}, version=VERSION)
    zeros = {"market": market.zeros(), "order": order.zeros(), "transaction": transaction.zeros()}
    windows = {"market": market.WINDOWS, "order": order.WINDOWS, "transaction": transaction.WINDOWS}

    def build(name: str, block: DataFrame) -> None:
        empty = {f"{name}__w{w}__{c}" for w in windows[name] for c, zero in zeros[name].items() if zero} | {f"{name}__row_count"}
        tables.build(cross.as_features(W.on_spine(samples, block, empty)), "features", split, name, source=source, resume=resume)

    build("market", market.block(rows["market"]))
    context = tables.load("features", split, "market").select("sample_id", F.coalesce(F.col("market__reference_mid").cast("double"), F.lit(1.0)).alias("reference"))
    build("order", order.block(rows["order"], context))
    build("transaction", transaction.block(rows["transaction"], context))
    wide = cross.joined(*(tables.load("features", split, b) for b in BLOCKS[:3]))
    tables.build(cross.as_features(cross.cross(wide)), "features", split, "cross", source=source, resume=resume)


def build_sequences(catalog: store.Catalog, tables: store.Tables, split: str, n: int | None, resume: bool) -> None:
    cache = build_cache(catalog, tables, split, n, resume)
    rows = _cached(tables, split)
    source = store.identity(cache={t: m["rows"] for t, m in cache.items()}, version=VERSION)
    derived = market.derive(rows["market"])
    tables.build(market.context(derived), "context", split, source=source, resume=resume)
    trades = transaction.derive(rows["transaction"], tables.load("context", split))
    made = {
        "market": sequences.padded(sequences.market_rows(derived), sequences.STEPS["market"], [f"f{k}" for k in range(15)]),
        "transaction": sequences.padded(sequences.transaction_rows(trades), sequences.STEPS["transaction"], [*(f"f{k}" for k in range(6)), "side_code"]),
        "grid": sequences.grid_arrays(sequences.grid(trades)),
    }
    for name, table in made.items():
        tables.build(table, "sequences", split, name, source=source, resume=resume)
        if not sequences.unsound(tables.load("sequences", split, name), "grid" if name == "grid" else "features").isEmpty():
            raise ValueError(f"{split} {name}: a sequence has a value that is not finite")


def _matrix(tables: store.Tables, split: str, sets: list[str], exclude: list[str]) -> DataFrame:
    rows = tables.load_blocks(split, BLOCKS)
    rows = cross.as_features(cross.derived(rows, tuple(sets))) if sets else rows
    return cross.exclude(rows, exclude) if exclude else rows


def train(catalog: store.Catalog, tables: store.Tables, run: str, sets: list[str], exclude: list[str], settings: dict) -> dict:
    plan = rounds.plan_of(settings)
    rows = _matrix(tables, "train", sets, exclude)
    features = [c for c in rows.columns if c != "sample_id"]
    labels = tables.load("cache", "train", "label").select("sample_id", "month", "target")
    if not labels.join(rows, "sample_id", "left_anti").isEmpty():
        raise ValueError("some labelled samples have no features")
    oof, found = training.rolling(labels.join(rows, "sample_id"), features, plan)
    return tables.build(oof, "runs", run, resume=False, sets=sets, exclude=exclude, settings=settings, **found)


def research(catalog: store.Catalog, tables: store.Tables, queue: str) -> dict | None:
    """Trains and scores the rounds of a queue that its ledger lacks; the best of all. A round's run is kept as ``round-<name>``."""
    folder, name = store.place_of(catalog.spark, queue)
    ledger = rounds.Ledger(store.Folder(catalog.spark, tables.folder.at("research")), rounds.queue_of(json.loads(folder.text(name))), store.identity)

    def one(r: rounds.Round) -> dict:
        found = train(catalog, tables, f"round-{r.name}", list(r.sets), list(r.exclude), r.settings)
        report = metrics.required(metrics.cosine_report(tables.load("runs", f"round-{r.name}"))).first().asDict()
        return {"score": report["global_score"], "report": report, "rounds": found["rounds"]}

    return rounds.run(ledger, one)


def predict(tables: store.Tables, run: str) -> None:
    """Fits the run's plan on all months, for the median of its best rounds, and keeps predictions and importances."""
    m = tables.manifest("runs", run)
    plan = rounds.plan_of(m["settings"])
    rows, test = (_matrix(tables, split, m["sets"], m["exclude"]) for split in store.SPLITS)
    features = [c for c in rows.columns if c != "sample_id"]
    if rows.columns != test.columns:
        raise ValueError("train and test have different features")
    labels = tables.load("cache", "train", "label").select("sample_id", "month", "target")
    out, models = training.full(labels.join(rows, "sample_id"), test, features, plan, m["rounds"])
    tables.build(out, "predictions", run, resume=False, seeds=m["seeds"])
    tables.folder.put(json.dumps([dict(x.importance()) for x in models]), "predictions", run, "importance.json")
    store.write_vector(tables.load("predictions", run), tables.folder.at("predictions", run, "test.npy"))


def _as_run(predictions: DataFrame) -> DataFrame:
    """Test predictions with the keys of runs, which they lack."""
    return predictions.select("sample_id", F.lit(None).cast("int").alias("month"), F.lit(None).cast("double").alias("target"), F.lit("test").alias("fold"), "prediction")


def combine(tables: store.Tables, kind: str, names: list[str], weights: list[float] | None, output: str, normalize: bool = True) -> None:
    """Runs into one, by default by their numbers of seeds; their test predictions likewise, where all have them."""
    seeds = [(tables.manifest("runs", r) or {}).get("seeds", 1) for r in names]
    put = (lambda parts: runs.ensemble(parts, weights, seeds)) if kind == "ensemble" else (lambda parts: runs.blend(parts, weights, normalize))
    tables.build(put([tables.load("runs", r) for r in names]), "runs", output, resume=False, seeds=sum(seeds), of=names)
    if all(tables.manifest("predictions", r) for r in names):
        tables.build(put([_as_run(tables.load("predictions", r)) for r in names]).select("sample_id", "prediction"), "predictions", output, resume=False, seeds=sum(seeds))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    catalog, tables = store.Catalog(spark, a.data), store.Tables(spark, a.work)
    run = lambda name: tables.load("runs", name)
    splits = store.SPLITS if getattr(a, "split", None) == "all" else (getattr(a, "split", None),)
    if a.command == "validate":
        bad = store.failed(catalog.validate())
        print(json.dumps({"ok": not bad, "failed": bad}))
        return int(bool(bad))
    if a.command in ("build-cache", "build-features", "build-sequences"):
        build = {"build-cache": build_cache, "build-features": build_features, "build-sequences": build_sequences}[a.command]
        for split in splits:
            build(catalog, tables, split, a.max_samples, a.resume)
    elif a.command == "view":
        rows = catalog.read(a.split, a.table)
        rows = rows if a.sample is None else browse.one_sample(rows, a.sample)
        for r in (browse.describe(rows) if a.describe else browse.page(rows, ["row_seq"], a.offset, a.limit)).collect():
            print(json.dumps(r.asDict()))
    elif a.command == "baselines":
        rows = store.load_labels(catalog, a.max_samples).join(tables.load_blocks("train", ("market", "transaction")), "sample_id")
        found = [r.asDict() for r in metrics.baseline_report(folds.in_folds(rows).where("part = 'valid'"), metrics.BASELINES).collect()]
        tables.folder.put(json.dumps(found), "metrics", "baselines.json")
        for r in found:
            print(json.dumps(r))
    elif a.command == "train-tabular":
        print(json.dumps(train(catalog, tables, a.run_id, a.sets, a.exclude, a.settings)["best"]))
    elif a.command == "predict-test":
        predict(tables, a.run_id)
    elif a.command == "research-20":
        print(json.dumps(research(catalog, tables, a.queue)))
    elif a.command == "evaluate-oof":
        found = metrics.required(metrics.cosine_report(run(a.run_id))).first().asDict()
        tables.folder.put(json.dumps(found), "metrics", f"{a.run_id}.json")
        print(json.dumps(found))
    elif a.command in ("ensemble", "blend"):
        combine(tables, a.command, a.run_id, a.weight, a.output, getattr(a, "normalize", True))
    elif a.command == "postprocess":
        m = tables.manifest("runs", a.run_id) or {}
        tables.build(runs.signed_power(run(a.run_id), a.power, a.center), "runs", a.output, resume=False, seeds=m.get("seeds", 1))
        if tables.manifest("predictions", a.run_id):
            tables.build(runs.signed_power(tables.load("predictions", a.run_id), a.power, a.center), "predictions", a.output, resume=False)
    elif a.command == "blend-search":
        rows, best = runs.blend_found(run(a.run_id[0]), run(a.run_id[1]))
        print(json.dumps(best))
        if a.output:
            tables.build(rows, "runs", a.output, resume=False, **best)
    elif a.command == "make-submission":
        template = store.read_submission(spark, catalog.folder.at("submission.csv"))
        held = ("predictions", a.run_id) if tables.manifest("predictions", a.run_id) else ("runs", a.run_id)
        store.write_submission(runs.submission(template, tables.load(*held)), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
