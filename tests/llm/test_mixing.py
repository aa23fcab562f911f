import math
import re
import struct

import numpy as np
import pytest
import xxhash

from lexigrid.llm.mixing import mix_counts, mix_documents, permute, targets

SCHEMA = "doc_id long, text string, source string, n_chars long, size string"


def docs():
    rows = []
    for i in range(240):
        source = ["b", "a", "c", "é", None][i % 5] if i % 3 else "hot"
        rows.append((i, " ".join(f"w{i}_{j}" for j in range(i * 13 % 70)), source, 0, "x"))
    return rows + [(900, None, "a", 0, "x"), (901, "\t \n", None, 0, "x"), (5, "dup dup dup", "a", 0, "x"), (5, "dup dup dup", "a", 0, "x"), (None, "no id", "b", 0, "x")]


def test_targets_reshare_what_is_above_twice_the_size():
    got = targets([10, 100, 1000])
    assert got[0] == 20 and abs(sum(got) - 1.5 * 1110) < 1e-9
    assert all(t <= 2 * s for t, s in zip(got, [10, 100, 1000]))
    assert targets([]) == [] and targets([0, 0]) == [0.0, 0.0]


def test_permutations_are_permutations_with_an_inverse():
    for n in (1, 2, 3, 17, 64, 1000):
        p = permute(np.arange(n), n, 99)
        assert sorted(p) == list(range(n))
        assert (permute(p, n, 99, back=True) == np.arange(n)).all()


def test_every_source_gives_its_target(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    got = mix_counts(df, block=16, shard=32).collect()
    assert len(got) == len(docs())
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    names = sorted((s for s in by if s is not None)) + [None]
    assert [round(by[s][0].target, 6) for s in names] == [round(t, 6) for t in targets([by[s][0].source_size for s in names])]
    again = mix_counts(df.repartition(3), block=16, shard=32).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_the_mix_holds_the_words_it_counts(spark):
    df = spark.createDataFrame([r for r in docs() if r[0] != 5 or r[1] != "dup dup dup"], SCHEMA)
    counts = {r.doc_id: r.taken for r in mix_counts(df, block=16, shard=32).collect()}
    words = {}
    for r in mix_documents(df, block=16, shard=32).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and r.size == "x"
    assert words == {d: n for d, n in counts.items() if n}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_counts(empty).collect() == [] and mix_documents(empty).collect() == []


def brute_mix(rows, block, bucket, seed=17):
    """Words taken of each document, word by word from the definition: its source's stream in blocks, whole epochs and part of one more."""
    h64 = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    buckets = max(1, len(rows) // bucket)
    streams = {}
    for d, t, source in rows:
        h = 42 if t is None else h64(t.encode(), 42)
        of = h64(struct.pack("<i", seed), h64(struct.pack("<Q", h), h64(struct.pack("<q", d), 42)))
        streams.setdefault(source, []).append((signed(of) % buckets, d, signed(h), words(t)))
    names = sorted(s for s in streams if s is not None) + [s for s in streams if s is None]
    taken = {}
    for sid, (name, goal) in enumerate(zip(names, targets([sum(x[3] for x in streams[s]) for s in names]), strict=True)):
        stream = [d for _, d, _, n in sorted(streams[name]) for _ in range(n)]
        left, epoch = math.floor(goal + 0.5), 0
        blocks = [stream[i : i + block] for i in range(0, len(stream), block)]
        taken |= {x[1]: 0 for x in streams[name]}
        while left and blocks:
            for b in permute(np.arange(len(blocks)), len(blocks), (seed << 40) + (sid << 8) + epoch):
                for d in blocks[b][:left]:
                    taken[d] += 1
                left -= min(left, len(blocks[b]))
            epoch += 1
    return taken


@pytest.mark.parametrize("block, bucket", [(16, 1000), (7, 20), (256, 3)])
def test_what_is_taken_matches_brute_force(spark, block, bucket):
    rows = [(d, t, s) for d, t, s, *_ in docs() if d is not None and d != 5] + [(950, "long " * 20_000, "b")]
    got = mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=block, shard=32, bucket=bucket).collect()
    assert {r.doc_id: r.taken for r in got} == brute_mix(rows, block, bucket)
