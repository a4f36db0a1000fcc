"""Every query with SQL agrees with it on the smallest tables."""

import math

import duckdb
import pytest

from tickloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(([clean(r[i]) for i in order] for r in rows), key=repr), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = duck.sql(catalogue.ORACLES[name])
    want, columns = rows_of(r.columns, r.fetchall())
    assert names == columns and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=1.1e-4) if isinstance(x, float) else x == y


def test_grid_of_bins_without_volume(spark, tmp_path):
    events = "values (0, timestamp '2024-01-01 00:00:00', 1, 'view', 0e0), (1, timestamp '2024-01-02 00:00:00', 1, 'error', 50.25), (2, timestamp '2024-01-09 00:00:00', 1, 'click', 0e0), (3, timestamp '2024-01-09 00:00:01', 2, 'click', 0e0)"
    c = duckdb.connect()
    c.sql(f"copy (select * from ({events}) t(event_id, ts, user_id, event_type, value)) to '{tmp_path}/events.parquet'")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = catalogue.QUERIES["txn_grid_dense"](spark, str(tmp_path))
    r = c.sql(catalogue.ORACLES["txn_grid_dense"])
    got, want = rows_of(df.columns, [tuple(x) for x in df.collect()]), rows_of(r.columns, r.fetchall())
    assert got == want and len(got[0]) == 120


def test_halves_are_rounded_like_the_sql(spark):
    xs = [-0.559375, 0.653125, 0.303125, 0.266875, 0.015625, 2.5e-5, 1.5, -7.0, 1e300, None]
    got = [r.x for r in catalogue.rounded(spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k long, x double"), 5).orderBy("k").collect()]
    assert got == [duckdb.execute("select round(?::double, 5)", [x]).fetchone()[0] for x in xs]


def test_entry(spark):
    import __spark_entry__ as e

    assert {"score", "month", "n"} == set(e.entry(spark).columns)
    assert set(e.oracle_sql()) <= set(e.queries())
