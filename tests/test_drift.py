"""Drift of batches against its SQL where dates are few, alike or at half of a thousandth."""

import datetime
import math

import duckdb
import pytest

from lexigrid.plans import catalog, culture

DAYS = {
    "equal rates": {1: [0, 1, 2, 3], 2: [3, 2, 1, 0], 3: [1, 2]},
    "equal rates of a fraction": {d: [1] * 499 + [0] * 501 for d in range(1, 8)},
    "one date": {1: [0, 1, 3]},
    "two dates": {1: [0, 1, 3], 2: [2, 3]},
    "halves": {1: [1] * 201 + [0] * 199, 2: [1, 2], 3: [0, 3, 3]},
    "outlier": {d: [3, 3] if d == 9 else [0, 1, d % 2] for d in range(1, 20)},
}


@pytest.mark.parametrize("name", sorted(DAYS))
def test_query_agrees_with_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    rows = [(4 * i + k, datetime.datetime(2024, 1, day, 12), 1, "view", 1.0, "{}") for day, ks in DAYS[name].items() for i, k in enumerate(ks)]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    want = sorted(con.sql(f"SELECT batch, n, rate, z, drifted FROM ({catalog.ORACLE['batch_drift']})").fetchall())
    got = sorted(map(tuple, catalog.QUERIES["batch_drift"](spark, str(tmp_path)).select("batch", "n", "rate", "z", "drifted").collect()))
    shown = lambda t: [tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in t]
    assert shown(got) == shown(want)


def test_guarded_drift_flags_nothing_without_spread(spark):
    rows = [(datetime.date(2024, 1, d), 1) for d in (1, 2, 3)]
    got = culture.batch_drift(spark.createDataFrame(rows, "at date, n int"), "at", "n").collect()
    assert [(r["z"], r["drifted"]) for r in got] == [(None, False)] * 3
    two = culture.batch_drift(spark.createDataFrame([(rows[0][0], 1), (rows[1][0], 3)], "at date, n int"), "at", "n").collect()
    assert sorted((r["z"], r["drifted"]) for r in two) == [(-1.0, False), (1.0, False)]
