import random

from lexigrid.llm import common
from lexigrid.llm.common import connected_components, lookup


def test_components_have_their_smallest_node_as_root(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == find(n) for n in root)


def test_a_step_of_the_stars_takes_no_edge_both_ways(spark, monkeypatch):
    plans, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    edges = [(i, i + 1) for i in range(20)] + [(30, k) for k in range(31, 50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {k: 30 for k in range(31, 50)}
    assert len(plans) > 1 and all(plan.count("Generate") <= 1 for plan in plans)


def test_lookup_of_hot_and_rare_keys(spark):
    left = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS key")
    right = spark.range(0, 2000, 2).selectExpr("id AS key", "id * 10 AS value").unionByName(spark.sql("SELECT 7L AS key, 70L AS value"))
    got = {r.id: r.value for r in lookup(left, right, "key").collect()}
    assert len(got) == 2000 and got[3] == 70 and got[4] == 40 and got[5] is None
