"""The commands over a made-up market, from Feather files to a submission."""

import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
import pytest

from tickloom import cli
from tickloom.sources import store

SILENT = 5  # a sample without snapshots, orders or trades


def written(root, samples):
    """Random walks of a price, whose next step shows in the book; sample i belongs to month i mod 71."""
    r = random.Random(12)
    for split in ("train", "test"):
        (root / split).mkdir(parents=True)
        book, orders, trades, labels = [], [], [], []
        for s in range(samples):
            lean = r.uniform(-1, 1)
            labels.append((s % 71, s, lean * 0.004 + r.gauss(0, 0.001)))
            if s == SILENT:
                continue
            for k in range(r.randint(2, 7)):
                mid, wide = 1 + 0.003 * r.gauss(0, 1), r.choice([0.0004, 0.0012])
                traded = r.random() < 0.6
                book.append((s, 40.0 - 6 * k, mid if traded else None, 30 * (k + 1) if traded else 0, k + 1 if traded else 0, mid + wide, int(700 - 400 * lean), mid - wide, int(700 + 400 * lean), mid + 2 * wide, 350, mid - 2 * wide, 360))
            for k in range(r.randint(1, 5)):
                orders.append((s, 50.5 - 11 * k, 1 + r.gauss(0, 0.01), r.randint(1, 30_000), r.randint(0, 1), r.randint(0, 1)))
            for k in range(r.randint(1, 6)):
                trades.append((s, 55.0 - 9.5 * k, 1 + r.gauss(0, 0.002), r.randint(1, 900), int(r.random() > 0.5 + lean / 2)))
        made = {"market": book, "order": orders, "transaction": trades} | ({"label": labels} if split == "train" else {})
        kinds = {"int": pa.int32(), "float": pa.float32(), "tinyint": pa.int8(), "smallint": pa.int16()}
        for name, rows in made.items():
            fields = store.RAW[name].fields
            columns = {f.name: pa.array([x[k] for x in rows], kinds[f.dataType.simpleString()]) for k, f in enumerate(fields)}
            feather.write_feather(pa.table(columns), str(root / split / f"{name}.feather"), chunksize=50)
    (root / "submission.csv").write_text("sample_id,prediction\n" + "".join(f"{k},0.0\n" for k in range(samples)))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    written(root / "data", 142)
    at = ["--data", str(root / "data"), "--work", f"file://{root}/work"]
    cli.main([*at, "build-features", "--resume"])
    return root, at, store.Tables(spark, f"file://{root}/work")


def test_features(built, spark):
    root, at, tables = built
    assert cli.main([*at, "validate"]) == 0
    rows = tables.load_blocks("train", cli.BLOCKS)
    assert len(rows.columns) == 736 and rows.count() == 142
    silent = rows.where(f"sample_id = {SILENT}").first()
    assert silent.order__w60__event_count == 0 and silent.market__row_count == 0 and silent.market__w5__mid_bps__last is None
    shard = tables.load_shards("train", ("market", "order"), [0], {"order": ["sample_id", "price"]})
    assert shard["order"].columns == ["sample_id", "price"] and shard["market"].select("sample_id").distinct().count() == 141
    assert tables.load_shards("train", ("market",), [1])["market"].isEmpty()


def test_a_replaced_file_is_noticed(built, spark):
    root, at, tables = built
    before = tables.manifest("features", "test", "order")
    cli.main([*at, "build-features", "--split", "test", "--resume"])
    assert tables.manifest("features", "test", "order") == before
    path = root / "data" / "test" / "order.feather"
    kept = path.read_bytes()
    table = feather.read_table(str(path))
    feather.write_feather(table.set_column(3, "volume", pa.array(np.asarray(table.column("volume")) + 1, pa.int32())), str(path), chunksize=50)
    cli.main([*at, "build-features", "--split", "test", "--resume"])
    assert tables.manifest("features", "test", "order")["rows"] != before["rows"] and tables.manifest("features", "test", "market")["source"] != before["source"]
    table = feather.read_table(str(path))
    feather.write_feather(table.take(pa.array(np.arange(len(table))[::-1])), str(path))
    with pytest.raises(ValueError, match="order"):
        cli.main([*at, "build-cache", "--split", "test"])
    path.write_bytes(kept)


def test_runs(built, spark, capsys):
    root, at, tables = built
    settings = ["--settings", json.dumps({"seeds": [1, 2], "feature_clip": [0.01, 0.99]})]
    cli.main([*at, "train-tabular", "--run-id", "a", "--exclude", "market__w[136]*", "order__*", "cross__*", *settings])
    cli.main([*at, "train-tabular", "--run-id", "b", "--exclude", "market__*", "order__*", "--sets", "order_pressure", "--settings", '{"seeds": [3], "half_life": 12, "recent": 40, "normalization": "monthly_std"}'])
    m = tables.manifest("runs", "a")
    assert m["seeds"] == 2 and set(m["best"]) == {"f1", "f2", "f3", "f4"} and 0 <= m["rounds"] < 20
    for run in ("a", "b"):
        cli.main([*at, "predict-test", "--run-id", run])
    names = list(json.loads(tables.folder.text("predictions", "a", "importance.json"))[0].values())
    assert names == sorted(names, reverse=True)
    cli.main([*at, "ensemble", "--run-id", "a", "b", "--output", "c"])
    a, b, c = ({r.sample_id: r.prediction for r in tables.load("runs", x).collect()} for x in "abc")
    assert len(c) == 48 and all(c[k] == pytest.approx((2 * a[k] + b[k]) / 3) for k in c) and tables.manifest("runs", "c")["seeds"] == 3
    held = np.load(root / "work" / "predictions" / "a" / "test.npy")
    assert held.shape == (142,) and {r.sample_id: r.prediction for r in store.read_vector(spark, f"file://{root}/work/predictions/a/test.npy").collect()} == dict(enumerate(held.tolist()))
    cli.main([*at, "blend", "--run-id", "a", "b", "--output", "d"])
    cli.main([*at, "postprocess", "--run-id", "d", "--power", "1.2", "--output", "e"])
    cli.main([*at, "blend-search", "--run-id", "a", "b", "--output", "f"])
    capsys.readouterr()
    cli.main([*at, "evaluate-oof", "--run-id", "a"])
    assert json.loads(capsys.readouterr().out)["global_score"] > 0.5
    cli.main([*at, "baselines"])
    assert capsys.readouterr().out.count("global_score") == 3 and len(json.loads(tables.folder.text("metrics", "baselines.json"))) == 3
    cli.main([*at, "make-submission", "--run-id", "e", "--output", str(root / "s.csv")])
    lines = (root / "s.csv").read_text().splitlines()
    assert len(lines) == 143 and lines[0] == "sample_id,prediction" and [x.split(",")[0] for x in lines[1:]] == [str(k) for k in range(142)]


def test_queue_of_rounds(built, capsys):
    root, at, tables = built
    rounds = [{"name": n, "exclude": ["market__*", "order__*", "cross__*", "transaction__w[1236]*", *more], "settings": {"seeds": [1], "feature_clip": None}} for n, more in (("all", []), ("fewer", ["*price*"]))]
    queue = root / "queue.json"
    queue.write_text(json.dumps(rounds[:1]))
    cli.main([*at, "research-20", "--queue", str(queue)])
    first = json.loads(capsys.readouterr().out)
    assert first["name"] == "all" and first["score"] == pytest.approx(first["report"]["global_score"])
    before = tables.manifest("runs", "round-all")
    cli.main([*at, "research-20", "--queue", str(queue)])  # nothing is pending
    assert tables.manifest("runs", "round-all") == before
    queue.write_text(json.dumps(rounds))
    with pytest.raises(ValueError, match="another queue"):
        cli.main([*at, "research-20", "--queue", str(queue)])
    for bad in ([], rounds[:1] * 2, [{"name": "x", "depth": 3}], [{"name": "x", "settings": {"trees": 5}}]):
        queue.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            cli.main([*at, "research-20", "--queue", str(queue)])


def test_sequences_and_views(built, capsys):
    root, at, tables = built
    cli.main([*at, "build-sequences", "--split", "train", "--resume"])
    assert {tables.manifest("sequences", "train", x)["row_count"] for x in ("grid", "market", "transaction")} == {141}
    capsys.readouterr()
    cli.main([*at, "view", "--table", "order", "--sample", "3"])
    assert all(json.loads(x)["sample_id"] == 3 for x in capsys.readouterr().out.splitlines())
    cli.main([*at, "view", "--table", "label", "--describe"])
    said = {x["name"]: x for x in map(json.loads, capsys.readouterr().out.splitlines())}
    assert said["sample_id"]["high"] == 141 and said["month"]["filled"] == 142
    cli.main([*at, "view", "--table", "label", "--offset", "10", "--limit", "5"])
    assert [json.loads(x)["sample_id"] for x in capsys.readouterr().out.splitlines()] == [10, 11, 12, 13, 14]
    with pytest.raises(SystemExit):
        cli.parser().parse_args([*at, "unknown"])
