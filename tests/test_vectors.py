"""Vector search against plain numpy: the grid, the index, its reach and what it leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import vectors

SCHEMA = "ident long, within string, v array<float>"


def made(n=3000, dims=8, seed=1):
    """Vectors around 30 points, a third of them under one law; one row without a vector and one of length zero."""
    r = np.random.default_rng(seed)
    around = r.normal(size=(30, dims)) * 3
    v = around[r.integers(0, 30, n)] + r.normal(size=(n, dims))
    laws = ["hot" if i % 3 == 0 else f"L{i % 40}" for i in range(n)]
    rows = [(i, laws[i], [float(np.float32(x)) for x in v[i]]) for i in range(n)]
    rows[7] = (7, "hot", None)
    rows[11] = (11, "L11", [0.0] * dims)
    return rows


def nearest(rows, k, cosine, within):
    """The k nearest by plain loops: {query: [(ident, score)]}."""
    have = [(i, w, np.array(v)) for i, w, v in rows if v is not None]
    out = {}
    for i, w, q in have:
        if i % 20:
            continue
        found = []
        for j, u, x in have:
            if within and u != w:
                continue
            if cosine:
                size = np.sqrt(q @ q) * np.sqrt(x @ x)
                score = round(float(q @ x / size), 6) if size else float("nan")
                found.append((np.inf if score != score else -score, j, score))
            else:
                score = round(float(((q - x) ** 2).sum()), 6)
                found.append((score, j, score))
        out[i] = [(j, s) for _, j, s in sorted(found)[:k]]
    return out


def asked(df):
    return df.where("ident % 20 = 0").withColumnRenamed("ident", "query")


def listed(found):
    out = {}
    for r in found.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["ident"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6, nan_ok=True), q
        assert len({j for j, _ in got[q]} ^ {j for j, _ in want[q]}) <= 2  # ties to six digits


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("within", [True, False])
def test_exact_equals_loops_over_many_blocks_and_slices(spark, table, monkeypatch, cosine, within):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "SLICE", 300)
    same(listed(vectors.exact(asked(table), table, 5, cosine, within)), nearest(made(), 5, cosine, within))


@pytest.mark.parametrize("cosine", [True, False])
def test_index_holds_every_row_and_finds_nine_of_ten(spark, table, cosine):
    index = vectors.build(table, vectors.fit(table, cosine=cosine), cosine)
    assert index.rows.count() == 2999 and index.rows.select("ident").distinct().count() == 2999
    right = vectors.exact(asked(table), table, 5, cosine)
    share = vectors.calibrated(index, asked(table), 5)
    assert 0 < share < 0.6
    got = vectors.recall(vectors.search(index, asked(table), 5, share=share, seen=0), right)
    assert got.agg(F.avg("recall")).first()[0] >= 0.9 and got.count() == 150
    looked = vectors.probed(index, asked(table), share=0.0, probes=3, seen=0)
    assert looked.groupBy("query").count().where("count <> 3").count() == 0


def test_a_law_of_few_rows_is_searched_in_full(spark, table):
    index = vectors.build(table, vectors.fit(table))
    got = listed(vectors.search(index, asked(table), 5, within=True, share=0.0, probes=1, seen=2000))
    same(got, nearest(made(), 5, True, True))


def test_written_index_is_read_again(spark, table, tmp_path):
    index = vectors.build(table, vectors.fit(table, 20, cosine=False), False)
    vectors.write(index, str(tmp_path / "index"))
    again = vectors.read(spark, str(tmp_path / "index"))
    assert np.array_equal(again.centres, index.centres) and again.cosine is False
    assert listed(vectors.search(again, asked(table), 4, share=0.2, seen=0)) == listed(vectors.search(index, asked(table), 4, share=0.2, seen=0))


def test_empty_tables_equal_vectors_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vectors.exact(asked(none), none, 3).collect() == []
    index = vectors.build(none, vectors.fit(none))
    assert vectors.search(index, asked(none), 3).collect() == []
    one = spark.createDataFrame([(20 + k // 2, "a", [1.0, 2.0]) for k in range(8)], SCHEMA)
    want = [(20, 1.0), (20, 1.0), (21, 1.0)]
    assert listed(vectors.exact(asked(one).distinct(), one, 3))[20] == want
    index = vectors.build(one, vectors.fit(one))
    assert len(index.centres) == 1 and listed(vectors.search(index, asked(one).distinct(), 3))[20] == want
    assert vectors.exact(asked(one), none, 3).collect() == []


def test_nearest_within_label_agrees_with_sql_beyond_what_the_index_searches_in_full(spark, tmp_path):
    import duckdb

    from lexigrid.plans import catalog

    n, r = 5000, np.random.default_rng(3)
    v = r.normal(size=(n, 32)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], 0 if i % 7 else 1) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT query, vec_id, rank, score FROM ({catalog.ORACLE['nearest_within_label']})").fetchall()
    got = catalog.QUERIES["nearest_within_label"](spark, str(tmp_path)).select("query", "vec_id", "rank", "score").collect()
    assert len(want) == 5 * n // 20
    assert sorted(map(tuple, got)) == sorted(want)
