import json

from lexigrid.streaming import events

EMPTY = "law_name string, updated_at timestamp"


def line(table, action, law, at):
    return json.dumps({"table": table, "action": action, "metadata": {"law_name": law, "count": 1}, "timestamp": at})


LINES = [
    line("lat", "persist", "L1", "2024-01-01T00:00:00Z"),
    line("lat", "lat_deleted", "L1", "2024-01-02T00:00:00Z"),
    line("lat", "persist", "L1", "2024-01-03T00:00:00Z"),
    line("lrt", "persist", "L2", "2024-01-01T00:00:00Z"),
    line("lat", "lat_deleted", "L2", "2024-01-01T00:00:00Z"),
    line("other", "persist", "L3", "2024-01-01T00:00:00Z"),
    "not json",
    line("lrt", "persist", "L4", "2024-01-05T00:00:00Z"),
]


def test_a_batch_keeps_the_last_event_of_each_law(spark):
    raw = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = events.apply(spark.createDataFrame([], EMPTY), events.decode(raw)).collect()
    assert sorted(r.law_name for r in got) == ["L1", "L4"]


def test_the_stream_equals_the_batch(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    spark.createDataFrame([], EMPTY).write.parquet(f"{state}/v0")
    for i, part in enumerate((LINES[:3], LINES[3:])):
        (source / f"{i}.txt").write_text("\n".join(part))
        events.watch(spark, str(source), str(state), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(f"{state}/v2").collect()
    assert sorted(r.law_name for r in got) == ["L1", "L4"]


def test_the_queue_retries_thrice(spark):
    laws = spark.createDataFrame([("L1", "making"), ("L2", "not_making"), ("L3", "uncertain")], "law_name string, class string").selectExpr("*", "timestamp'2024-01-01' AS updated_at")
    queue = events.enqueue(spark.createDataFrame([], "law_name string, added_at timestamp, pending boolean, retries int"), laws)
    for _ in range(3):
        queue = events.settle(queue, spark.createDataFrame([("L1", False), ("L3", True)], "law_name string, ok boolean"))
    rows = {r.law_name: r for r in queue.collect()}
    assert rows["L1"].pending and rows["L1"].retries == 3 and not rows["L3"].pending and rows["L3"].retries is None
    assert events.due(queue).collect() == []


def test_the_audit_chain_shows_changes(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "entry_id long, what string")
    good = events.chained(log, "entry_id", ["entry_id", "what"])
    assert events.broken(good, "entry_id", ["entry_id", "what"]).count() == 0
    bad = good.selectExpr("entry_id", "CASE WHEN entry_id = 2 THEN 'x' ELSE what END AS what", "hash", "previous")
    assert [r.entry_id for r in events.broken(bad, "entry_id", ["entry_id", "what"]).collect()] == [2]


def test_keys(spark):
    df = spark.sql("SELECT 'a/b/L1' AS k UNION ALL SELECT 'a/**'")
    assert [r[0] for r in df.select(events.law_of_key("k")).collect()] == ["L1", None]
