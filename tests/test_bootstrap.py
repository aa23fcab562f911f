"""The bootstrap of large groups against the normal interval, and over other partitions."""

import math

import numpy as np
import pytest

from lexigrid.plans import culture

SCHEMA = "i long, kind string, x double"


def made(n=4000):
    x = np.random.default_rng(3).normal(10, 2, n)
    return [(i, "hot" if i % 3 else None, float(x[i])) for i in range(n)] + [(n, "hot", None)]


def by_kind(df):
    return {r["kind"]: (r["mean"], r["low"], r["high"]) for r in df.collect()}


def test_intervals_are_near_the_normal_ones_and_do_not_depend_on_partitions(spark):
    rows = made()
    got = by_kind(culture.bootstrap_large(spark.createDataFrame(rows, SCHEMA).repartition(1), "kind", "x", "i"))
    again = by_kind(culture.bootstrap_large(spark.createDataFrame(rows, SCHEMA).repartition(7), "kind", "x", "i"))
    for kind in ("hot", None):
        x = np.array([v for _, k, v in rows if k == kind and v is not None])
        half = 1.96 * x.std(ddof=1) / math.sqrt(len(x))
        mean, low, high = got[kind]
        assert mean == pytest.approx(x.mean()) and again[kind] == pytest.approx(got[kind])
        assert mean - low == pytest.approx(half, rel=0.15) and high - mean == pytest.approx(half, rel=0.15)


def test_empty_and_equal(spark):
    assert culture.bootstrap_large(spark.createDataFrame([], SCHEMA), "kind", "x", "i", 50).collect() == []
    df = spark.createDataFrame([(i, "a", 2.0) for i in range(40)], SCHEMA)
    assert by_kind(culture.bootstrap_large(df, "kind", "x", "i", 50)) == {"a": (2.0, 2.0, 2.0)}
