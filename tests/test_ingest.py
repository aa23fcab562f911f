import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lexigrid.streaming import events, ingest

EMPTY = "law_name string, updated_at timestamp"


def line(table, action, law, second):
    return json.dumps({"table": table, "action": action, "metadata": {"law_name": law, "count": 1}, "timestamp": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"})


def batches(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        rows = [(rng.choice(["lat", "lrt"]), rng.choice(["persist", "persist", "lat_deleted", "deleted", "update"]), f"L{rng.randrange(12)}", rng.randrange(900)) for _ in range(rng.randrange(1, 15))]
        yield rows + [("result", rng.choice(["ok", "failed", "failed"]), f"L{rng.randrange(12)}", 0) for _ in range(6)]


KIND = {f"L{i}": ["making", "uncertain", "not_making"][i % 3] for i in range(12)}


def brute(given):
    """(laws, queue, number of changes) after all batches."""
    law, queue, changes = {}, {}, 0
    key = lambda e: (e[3], e[1] in ingest.DELETED, e[1])
    for rows in given:
        for name in sorted({r[2] for r in rows}):
            own = [r for r in rows if r[2] == name and r[0] != "result"]
            if own:
                last = max(own, key=key)
                if name not in law or key(last) > key(law[name]):
                    law[name] = last
                    changes += 1
                    if last[1] not in ingest.DELETED and KIND[name] != "not_making" and not queue.get(name, (0, False))[1]:
                        queue[name] = (last[3], True, 0)
            for r in rows:
                if r[2] == name and r[0] == "result" and queue.get(name, (0, False))[1]:
                    at, _, tries = queue[name]
                    queue[name] = (at, False, None) if r[1] == "ok" else (at, True, tries + 1)
                    changes += 1
    return {n: e[3] for n, e in law.items() if e[1] not in ingest.DELETED}, queue, changes


def told(spark, where):
    seconds = lambda c: (F.unix_micros(c) / 1_000_000 - 1704067200).cast("int").alias("s")
    laws = {r.law_name: r.s for r in ingest.laws_of(spark, where).select("law_name", seconds("updated_at")).collect()}
    queue = {r.law_name: (r.s, r.pending, r.retries) for r in ingest.queue_of(spark, where).select("law_name", seconds("added_at"), "pending", "retries").collect()}
    return laws, queue, ingest.audit(spark, where).where("cause <> 'due'").count()


@pytest.fixture
def known(spark):
    return spark.createDataFrame(list(KIND.items()), "law_name string, class string")


def test_the_stream_equals_the_batch_through_restarts(spark, tmp_path, known):
    source, where, given = tmp_path / "in", str(tmp_path / "out"), list(batches(1, 6))
    source.mkdir()
    for i, rows in enumerate(given):
        (source / f"{i}.txt").write_text("\n".join([*(line(*r) for r in rows), "not json", line("other", "persist", "L1", 3)]))
        ingest.ingest(spark, str(source), where, known, lambda df: df).awaitTermination()
        if i == 3:  # as if the driver had died before it noted the batch
            last = max((tmp_path / "out/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
            (last.parent / f".{last.name}.crc").unlink()
            last.unlink()
    laws, queue, changes = told(spark, where)
    assert (laws, queue, changes) == brute(given)
    raw = spark.createDataFrame([(line(*r),) for rows in given for r in rows if r[0] != "result"], "value string")
    whole = events.apply(spark.createDataFrame([], EMPTY), events.decode(raw)).collect()
    assert {r.law_name for r in whole} == set(laws)
    versions = ingest.audit(spark, where).groupBy("law_name").agg(F.max("version").alias("m"), F.count("*").alias("n"), F.count_distinct("version").alias("d")).collect()
    assert all(r.m == r.n == r.d for r in versions)


def test_a_batch_writes_what_it_brings(spark, tmp_path, known):
    source, where = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "0.txt").write_text("\n".join(line("lat", "persist", f"L{i}", 5) for i in range(12)))
    ingest.ingest(spark, str(source), where, known, lambda df: df).awaitTermination()
    (source / "1.txt").write_text(line("lat", "persist", "L3", 9))
    ingest.ingest(spark, str(source), where, known, lambda df: df).awaitTermination()
    rows = spark.read.parquet(f"{where}/changes").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in rows if r["count"]) == [1, 12]


def test_a_stream_that_goes_on_and_its_timers(spark, tmp_path, known):
    source, where = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    given = [*batches(2, 2), [("lat", "persist", "L0", 1), ("lat", "persist", "L1", 1)]]
    query = ingest.ingest(spark, str(source), where, known, lambda df: df, every="1 second", retry_ms=1)
    try:
        for i, rows in enumerate(given):
            (source / f".{i}.txt").write_text("\n".join(line(*r) for r in rows))
            (source / f".{i}.txt").rename(source / f"{i}.txt")
            time.sleep(4)  # each file in a batch of its own
        for _ in range(30):
            if query.exception() is None and told(spark, where)[:2] == brute(given)[:2] and ingest.audit(spark, where).where("cause = 'due'").count():
                break
            time.sleep(1)
    finally:
        query.stop()
    laws, queue, _ = told(spark, where)
    assert (laws, queue) == brute(given)[:2]
    assert ingest.audit(spark, where).where("cause = 'due'").count() > 0
