import collections
import random

import duckdb
import pytest

from lexigrid.llm import exact, queries

SCHEMA = "doc_id long, text string, digest string, _metadata string, kept string"


def brute(rows):
    """(id, keep_id, size) of each row, sorted, and how many rows stay."""
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    keep = {t: max(ids, key=lambda d: (d is not None, d or 0)) for t, ids in groups.items()}
    return sorted((str(d), str(keep[t or ""]), len(groups[t or ""])) for d, t in rows), len(groups)


def written(spark, rows, path, files=5):
    spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA).repartition(files).write.mode("append").parquet(path)


def rows_of(seed, n):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "A", "a ", "é", "é", "a\x00", "hot", "long " * 5000, *(f"t{i}" for i in range(150))]
    return [(None if rng.random() < 0.03 else rng.randrange(n), "hot" if rng.random() < 0.33 else rng.choice(texts)) for _ in range(n)]


def told(df):
    got = df.collect()
    return sorted((str(r.id), str(r.keep_id), r.group_size) for r in got), sum(r.kept for r in got)


@pytest.mark.parametrize("digest", [exact.sha256, lambda text: exact.F.unhex(exact.F.substring(exact.F.sha2(text, 256), 1, 2)), lambda text: exact.F.unhex(exact.F.lit("00"))], ids=["sha256", "8 bits", "no bits"])
def test_groups_by_brute_force_whatever_the_digest(spark, tmp_path, digest):
    path, rows = f"{tmp_path}/docs.parquet", rows_of(1, 900)
    written(spark, rows, path)
    df = exact.dedup(spark, path, digest=digest)
    assert told(df) == brute(rows)
    stay = exact.kept_documents(spark, path, df).collect()
    assert sorted(r.text or "" for r in stay) == sorted({t or "" for _, t in rows}) and {(r.digest, r["_metadata"], r.kept) for r in stay} == {("x", "y", "z")}


def test_the_state_outlives_the_query_and_takes_new_files_only(spark, tmp_path):
    path, where, rows = f"{tmp_path}/docs.parquet", f"{tmp_path}/state", []
    for seed in (1, 2, 3):
        more = rows_of(seed, 300)
        rows += more
        written(spark, more, path, 3)
        assert told(exact.dedup(spark, path, where, batch_bytes=1)) == brute(rows)  # one file in each micro-batch
    batches = spark.read.parquet(f"{where}/changes").groupBy("batch").count().count()
    assert batches == 9
    counted = exact.registry(spark, where).agg({"n": "sum"}).first()[0]
    assert counted == len(rows)


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    path, where, rows = f"{tmp_path}/docs.parquet", f"{tmp_path}/state", rows_of(4, 400)
    written(spark, rows, path, 2)
    exact.feed(spark, path, where, batch_bytes=1)
    last = max((tmp_path / "state/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (last.parent / f".{last.name}.crc").rename(tmp_path / "lost crc")
    last.rename(tmp_path / "lost")  # as if the driver had died before it noted the batch
    assert told(exact.dedup(spark, path, where, batch_bytes=1)) == brute(rows)


def test_an_empty_table_and_one_row(spark, tmp_path):
    written(spark, [], f"{tmp_path}/none.parquet", 1)
    assert exact.dedup(spark, f"{tmp_path}/none.parquet").collect() == []
    written(spark, [(None, None)], f"{tmp_path}/one.parquet", 1)
    assert told(exact.dedup(spark, f"{tmp_path}/one.parquet")) == ([("None", "None", 1)], 1)


def test_the_session_keeps_its_state_store(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    written(spark, [(1, "a")], f"{tmp_path}/one.parquet", 1)
    exact.feed(spark, f"{tmp_path}/one.parquet", f"{tmp_path}/state")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_the_query_agrees_with_sql_and_has_no_python(spark):
    folder = "/root/testdata/sf0.001"
    df = queries.QUERIES["op12_exact"](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    rel = con.sql(queries.ORACLE["op12_exact"])
    assert rel.columns == df.columns
    got = df.collect()
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in got)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
