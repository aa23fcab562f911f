import hashlib
import random

import pytest

from lexigrid.llm.suffixes import dedup_substrings, repeated, suffix_array


def brute(rows, least=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    owner = {}
    for d, t in texts:
        rank = (d is None, d or 0)
        for i in range(len(t) - least + 1):
            w = t[i : i + least]
            owner[w] = min(owner.get(w, rank), rank)
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - least + 1):
            if owner[t[i : i + least]] < (d is None, d or 0):
                gone[i : i + least] = [True] * least
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_arrays_are_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(500):
        text = [rng.randrange(1, rng.choice([2, 3, 6]) + 1) for _ in range(rng.randrange(60))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeats_belong_to_the_smallest_document():
    strings = [b"abcdefgh", b"xxcdefyy", b"cdefcdef"]
    assert sorted(repeated(strings, [1, 0, 2], 4)) == [(0, 2), (2, 0), (2, 4)]


def test_one_suffix_array_takes_time_in_proportion():
    steps = lambda n: sum(len(x) for x in [suffix_array([1 + (i * i) % 7 for i in range(n)] + [0])])
    assert steps(20_000) == 20_001
    assert suffix_array([2] * 5000 + [0]) == list(range(5000, -1, -1))


#: The sizes of production, where this table is one group, one bucket and one array; and many of each.
SIZES = [{}, {"group": 700, "bucket": 500, "array": 300}, {"group": 3000, "bucket": 90, "array": 4000}, {"group": 900, "bucket": 700, "hot": 2}, {"hot": 1}]


@pytest.mark.parametrize("seed, sizes", [(0, 0), (1, 0), (2, 0), (0, 1), (3, 1), (1, 2), (0, 3), (4, 3), (1, 4)])
def test_removal_matches_brute_force(spark, seed, sizes):
    rng = random.Random(seed)
    words = ["the", "of", "é", "long-word", "zz", "a\nb", "ß", "token"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    shared = [prose(rng.randrange(8, 60)) for _ in range(5)]
    rows = []
    for _ in range(40):
        text = " ".join(rng.choice([prose(rng.randrange(30)), rng.choice(shared), rng.choice(shared)[rng.randrange(20) :]]) for _ in range(rng.randrange(6)))
        rows.append((rng.randrange(60), text))
    rows += [(None, shared[0] * 2), (None, shared[0] * 2), (3, None), (4, ""), (5, "x" * 130), (99, "y" + "x" * 130), rows[7], (70, rows[7][1]), (71, rows[7][1])]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), **SIZES[sizes]).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_an_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, g string, _key string")
    assert dedup_substrings(empty).collect() == []
    one = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, text string, g string, _key string")
    assert [r.n_bytes for r in dedup_substrings(one).collect()] == [1]


def test_hash_buckets_are_even():
    import pyarrow as pa

    from lexigrid.llm.suffixes import Anchors

    rng = random.Random(1)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(60)]
    table = pa.table({"doc_id": pa.array(range(60), pa.int64()), "_key": pa.array(range(60), pa.int64()), "text": texts})
    sizes = [len(h) for _, h, _, _ in Anchors(table).packed(3)]
    assert len(sizes) == 8 and max(sizes) < 1.3 * min(sizes)


def test_very_long_texts_and_a_passage_in_every_document(spark):
    rng = random.Random(9)
    passage = " ".join(f"common{i}" for i in range(12))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(150)] + [(900, " ".join(str(rng.random()) for _ in range(30_000)) + passage)]
    for hot in (20_000, 50):
        got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), group=20_000, bucket=9000, array=5000, hot=hot).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    assert [r.n_removed >= len(passage) for r in sorted(got)] == [False] + [True] * 150
