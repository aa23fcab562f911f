import hashlib

import pytest

from lexigrid.llm.sharding import directory, shard

SCHEMA = "doc_id long, text string, depth string"


def brute(rows, limit):
    """Shards of rows with distinct keys, by splitting buckets one bit at a time."""
    bits = lambda d: f"{int(hashlib.md5(str('' if d is None else d).encode()).hexdigest()[:8], 16):032b}"
    out = {}

    def split(prefix, own):
        if sum(len((t or "").encode()) for _, t in own) <= limit or len(own) <= 1 or len(prefix) == 32:
            out.update({d: prefix for d, _ in own})
            return
        for b in "01":
            if part := [x for x in own if bits(x[0])[len(prefix)] == b]:
                split(prefix + b, part)

    split("", [(d, t) for d, t, _ in rows])
    return out


@pytest.mark.parametrize("limit", [50, 400, 10**6])
def test_only_oversized_buckets_split(spark, limit):
    rows = [(i, "x" * (i * 7 % 90), "kept?") for i in range(200)] + [(1000, None, "a"), (1001, "", "a"), (None, "é" * 30, "a"), (2000, "y" * 5000, "a")]
    got = shard(spark.createDataFrame(rows, SCHEMA), limit).collect()
    assert {r.doc_id: r.shard for r in got} == brute(rows, limit)
    assert len(got) == len(rows) and all(len(r.shard) == r.depth for r in got)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(r.shard_bytes == size[r.shard] for r in got)
    assert all(r.shard_bytes <= limit or r.shard_rows == 1 for r in got)


def test_a_hot_key_is_parted_by_text_and_place(spark):
    rows = [(7, "same text", "a")] * 300 + [(7, f"other {i}", "a") for i in range(100)] + [(i, "z", "a") for i in range(50)]
    got = shard(spark.createDataFrame(rows, SCHEMA), 200).collect()
    assert len(got) == len(rows)
    assert max(r.shard_bytes for r in got) <= 200


def test_directory_entries_cover_every_prefix_once(spark):
    got = directory(shard(spark.createDataFrame([(i, "x" * 40, "a") for i in range(100)], SCHEMA), 300)).collect()
    deepest = max(r.depth for r in got)
    covered = sorted(e for r in got for e in range(r.first_entry, r.first_entry + r.entries))
    assert covered == list(range(2**deepest))


def test_an_empty_table_has_no_shard(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_that_no_bits_part_raise(spark, monkeypatch):
    from lexigrid.llm import sharding

    monkeypatch.setattr(sharding, "route", lambda: sharding.F.lit(5).cast("long"))
    with pytest.raises(ValueError, match="agree in all"):
        shard(spark.createDataFrame([(i, "x" * 40, "a") for i in range(9)], SCHEMA), 100)
