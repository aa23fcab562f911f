"""Global orders where most rows share a score, against plain sorting."""

import math

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import ranking
from lexigrid.plans import culture


def scores(kind: str, n: int = 3000) -> list:
    if kind == "one":
        return [1.5] * n
    if kind == "hot":
        return [2.0 if i % 3 else float(i % 17) for i in range(n)]
    return [None if i % 10 == 0 else float((i * 7919) % n) for i in range(n)]


def table(spark, kind):
    return spark.createDataFrame([(f"law/of/one/long/prefix/{(i * 31) % 3000:05d}", s) for i, s in enumerate(scores(kind))], "name string, score double").repartition(4).cache()


@pytest.mark.parametrize("kind", ["one", "hot", "spread"])
def test_rank_by_score_and_tie(spark, kind):
    df = table(spark, kind)
    rows = sorted(df.collect(), key=lambda r: (r["score"] is None, -(r["score"] or 0.0), r["name"]))
    got = {r["name"]: (r["rank"], r["rating"]) for r in ranking.rate_by_rank(df, "score", "name").collect()}
    n = len(rows)
    assert got == {r["name"]: (i, "HIGH" if i < int(n * 0.2) else "LOW" if i >= int(n * 0.67) else "MEDIUM") for i, r in enumerate(rows)}


@pytest.mark.parametrize("kind", ["one", "hot", "spread"])
def test_stretches_stay_small_whatever_the_ties(spark, kind):
    rows, _ = ranking.ordered(table(spark, kind), "score", "name", descending=True)
    assert rows.groupBy("_stretch").count().agg(F.max("count")).first()[0] <= 3 * 3000 / ranking.STRETCHES


@pytest.mark.parametrize("kind", ["one", "hot", "spread"])
def test_percent_ranks(spark, kind):
    df = table(spark, kind)
    every = [-math.inf if s is None else s for s in scores(kind)]
    for r in ranking.percent_ranks(df, "score", "share").collect():
        own = -math.inf if r["score"] is None else r["score"]
        assert r["share"] == pytest.approx(sum(s < own for s in every) / (len(every) - 1))


def test_more_bounds_than_a_step_and_few_places(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PLACES", 150)
    df = table(spark, "spread")
    rows = sorted(df.collect(), key=lambda r: (r["score"] is None, -(r["score"] or 0.0), r["name"]))
    got = [r["name"] for r in ranking.rate_by_rank(df, "score", "name").orderBy("rank").collect()]
    assert got == [r["name"] for r in rows]


def test_discoveries_with_equal_values(spark):
    values = [0.001] * 40 + [0.02] * 10 + [0.2] * 30 + [0.9] * 20
    df = spark.createDataFrame([(p,) for p in values], "p double")
    cut = max((p for p in values if p <= sum(x <= p for x in values) / len(values) * 0.05), default=-1.0)
    assert sorted(r["p"] for r in culture.discoveries(df).where("rejected").collect()) == sorted(p for p in values if p <= cut)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "name string, score double")
    assert ranking.rate_by_rank(none, "score", "name").collect() == []
    assert ranking.percent_ranks(none, "score", "share").collect() == []
    one = spark.createDataFrame([("a", None)], "name string, score double")
    assert ranking.percent_ranks(one, "score", "share").first()["share"] == 0.0
    assert ranking.rate_by_rank(one, "score", "name").first()["rank"] == 0
