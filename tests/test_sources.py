import pytest

from lexigrid.operators import joins, lookup, merge
from lexigrid.sources import tables


def test_missing_tables_and_names_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        lookup.identifier("a; drop table b")
    with pytest.raises(lookup.NotFound):
        lookup.one(spark.range(3), "id", 9)


def test_load_append_and_pages(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS twice").write.parquet(str(tmp_path / "t.parquet"))
    df = tables.load(spark, str(tmp_path / "t.parquet"), "loaded")
    assert tables.has_tables(spark, "loaded") and not tables.has_tables(spark, "no_such_table")
    tables.replace(df, "kept_rows")
    tables.append(df.limit(2), "kept_rows")
    assert spark.table("kept_rows").count() == 12
    assert [r.id for r in tables.paged(df, "id > 2", ["id"], 2, 3).collect()] == [5, 6, 7]
    spark.sql("DROP TABLE kept_rows")


def test_arrow_csv_and_json(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, null")
    assert sorted(tables.from_ipc(spark, tables.to_ipc(df)).collect()) == sorted(df.collect())
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), schema="a int, b string").count() == 2
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert dict(tables.normalised(spark.sql("SELECT null AS n, timestamp_ntz'2024-01-01' AS t")).dtypes) == {"n": "string", "t": "timestamp"}


def test_an_equal_tier_is_not_rewritten(spark):
    old = spark.createDataFrame([(1, "regex", "a"), (2, "classifier", "a"), (3, "regex", "a")], "k int, method string, v string")
    new = spark.createDataFrame([(1, "regex", "b"), (2, "regex", "b"), (3, "agentic", "b"), (4, "regex", "b")], "k int, method string, v string")
    got = {r.k: r.v for r in merge.protected(old, new, ["k"], "method", ["v"]).collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: "b"}
    assert {r.v for r in merge.protected(old, new, ["k"], "method", ["v"], force=True).collect()} == {"b"}


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 2)], "grp string, at int")
    right = spark.createDataFrame([("g", 2, 7), ("g", 2, 9), ("g", 1, None)], "grp string, at int, v int")
    got = {(r.grp, r.at): r.found for r in joins.as_of(left, right, "grp", "at", "v", "found").collect()}
    assert got == {("g", 1): None, ("g", 2): None, ("g", 3): 9, ("h", 2): None}
