"""Fits of whole groups by their sums against numpy's least squares, and numbers within large groups."""

import numpy as np
import pytest

from lexigrid.functions import metalog
from lexigrid.operators import ranking

SCHEMA = "kind string, p double, x double"


@pytest.mark.parametrize("k", [2, 3, 5])
@pytest.mark.parametrize("kind", [metalog.UNBOUNDED, metalog.LOWER, metalog.BOUNDED])
def test_sums_give_the_plain_fit(spark, k, kind):
    p = np.arange(1, 400) / 400
    x = 3 + 2 * np.sin(p * 2) + p
    df = spark.createDataFrame([("a", float(q), float(v)) for q, v in zip(p, x)], SCHEMA).repartition(3)
    got = metalog.fitted(df, "kind", "p", "x", k, kind, 0.0, 10.0).collect()
    want = metalog.fit_least_squares(p, x, k, kind, 0.0, 10.0)
    assert [r["kind"] for r in got] == ["a"] and got[0]["coeffs"] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-6)


def test_groups_without_a_fit(spark):
    rows = [("few", 0.5, 1.0), ("few", None, 2.0), ("twice", 0.5, 1.0), ("twice", 0.5, 2.0), ("edge", 0.0, 1.0), ("edge", 0.5, 2.0), (None, 0.25, 1.0), (None, 0.75, 3.0)]
    got = {r["kind"]: r["coeffs"] for r in metalog.fitted(spark.createDataFrame(rows, SCHEMA), "kind", "p", "x", 2).collect()}
    assert got["few"] is None and got["twice"] is None and got["edge"] is None
    assert got[None] == pytest.approx([2.0, 1 / np.log(3)])
    assert metalog.fitted(spark.createDataFrame([], SCHEMA), "kind", "p", "x", 2).collect() == []


def test_numbers_within_a_group_that_holds_most_rows(spark):
    rows = [("hot" if i % 5 else f"g{i % 20}", float(i % 3), i) for i in range(2000)] + [(None, 1.0, 5000)]
    df = spark.createDataFrame(rows, "kind string, x double, i long").repartition(4)
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((x, i) for kind, x, i in rows if kind == g)
        want |= {i: (n + 1, len(own)) for n, (x, i) in enumerate(own)}
    got = {r["i"]: (r["number"], r["of"]) for r in ranking.numbered(df, "kind", "x", "i").collect()}
    assert got == want
