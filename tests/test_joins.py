"""Joins against brute force, and how many rows they make."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import joins


def most_joined(df) -> int:
    """The most rows that a join of a table that was run put out."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def best(left, right, score):
    out = {}
    for ident, key, x in left:
        for tie, other, y in right:
            s = None if key is None or key != other else score(x, y)
            if s is not None and s >= 0.5:
                out[ident] = min(out.get(ident, (-s, tie)), (-s, tie))
    return sorted((i, tie, -s) for i, (s, tie) in out.items())


@pytest.mark.parametrize("alone", [True, False])
def test_best_match_agrees_with_all_pairs(spark, alone):
    r = random.Random(5)
    # Keys that one side lacks, ties, scores below the least, nulls, and idents that repeat.
    left = [(i // 2, r.choice([None, *range(7)]), float(r.randint(1, 3))) for i in range(200)]
    right = [(i, r.choice([None, *range(2, 9)]), r.choice([None, 0.1, 0.5, 0.7, 0.9])) for i in range(150)]
    a, b = spark.createDataFrame(left, "ident long, key long, x double"), spark.createDataFrame(right, "tie long, key long, y double")
    score = F.col("y") if alone else F.col("y") * F.col("x") / 2
    got = joins.best_match(a, b, "key", score, 0.5, "tie", "ident", **({"alone": True} if alone else {}))
    want = best(left, right, lambda x, y: None if y is None else y if alone else y * x / 2)
    assert sorted(map(tuple, got.select("ident", "tie", "score").collect())) == want


def test_best_match_by_the_right_row_makes_no_pairs(spark):
    left = spark.range(3000).select(F.col("id").alias("ident"), (F.col("id") % 2).alias("key"))
    right = spark.range(1000).select(F.col("id").alias("tie"), (F.col("id") % 2).alias("key"), (F.col("id") % 10 / 10).alias("y"))
    got = joins.best_match(left, right, "key", F.col("y"), 0.5, "tie", "ident", alone=True)
    assert sorted((r["ident"], r["tie"], r["score"]) for r in got.collect()) == [(i, 8 if i % 2 == 0 else 9, 0.8 if i % 2 == 0 else 0.9) for i in range(3000)]
    assert most_joined(got) == 3000


def test_the_query_meets_each_order_with_one_part(spark):
    from lexigrid.plans import catalog

    got = catalog.QUERIES["best_scored_match"](spark, "/root/testdata/sf0.001")
    assert len(got.collect()) == most_joined(got)
