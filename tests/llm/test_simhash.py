import random
import re

import numpy as np
import pytest
import xxhash

from lexigrid.llm.simhash import family_links, join_tries, links, near_duplicates, scheme, simhash, simhashes, view_links

SCHEMA = "doc_id long, text string, fp string"


def plain_simhash(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def components(items, near):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = list(items)
    for n, a in enumerate(items):
        for b in items[:n]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_fingerprint_matches_plain_form():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40):
        text = " É ".join(rng.choice(["The", "CAT", "ß", "x\x0by", "z"]) for _ in range(n))
        assert simhash(text.encode()) == plain_simhash(text)


def scattered(seed, n=12, copies=20):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(n)]
    return sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for s in seeds for _ in range(copies)} | {0, 2**64 - 1})


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_tries_find_the_components_of_all_links(bits):
    prints = scattered(bits)
    union = join_tries(np.array(prints, np.uint64), bits, 4)
    got = components(range(len(prints)), lambda a, b: union.label[a] == union.label[b])
    assert got == components(range(len(prints)), lambda a, b: prints[a] >> (64 - bits) == prints[b] >> (64 - bits) and (prints[a] ^ prints[b]).bit_count() <= 4)


@pytest.mark.parametrize("n, budget, shared", [(1000, 4, 1), (5_000_000, 4, 2), (5 * 10**9, 4, 3), (10**6, 6, 2)])
def test_more_fingerprints_share_more_segments(n, budget, shared):
    assert scheme(n, budget) == (budget + shared, shared)


@pytest.mark.parametrize("group, hot, batch", [(1024, 65536, 32768), (1, 65536, 20), (1024, 16, 20), (8, 30, 50)])
def test_links_span_all_components_however_they_are_dealt(spark, group, hot, batch):
    prints = scattered(group, 20, 30)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = {(r.u % 2**64, r.v % 2**64) for r in links(df, 4, group, hot, batch).collect()}
    got = components(prints, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == components(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_near_copies_that_every_view_links_make_one_star(spark):
    base = 0x5555555555555555
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    prints = [signed(p) for p in [base, *(base ^ 1 << bit for bit in range(64))]]
    found = {(r.u, r.v) for r in links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4).collect()}
    assert found == {(p, min(prints)) for p in prints} - {(min(prints),) * 2}


def test_families_link_what_any_of_them_links(spark):
    rng = random.Random(8)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    near = lambda p: p ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(8)))
    seeds = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(8)]
    rows = sorted({(near(a), near(b)) for a, b in seeds for _ in range(12)})
    edges = family_links(spark.createDataFrame([tuple(map(signed, r)) for r in rows], "fp long, fp1 long"), 2, 4).collect()
    found = {(r.u % 2**64, r.v % 2**64) for r in edges}
    firsts = sorted({a for a, _ in rows})
    want = components(range(len(rows)), lambda i, j: any((x ^ y).bit_count() <= 4 for x, y in zip(rows[i], rows[j], strict=True)))
    got = components(firsts, lambda a, b: (a, b) in found or (b, a) in found)
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            assert (want[i] == want[j]) == (got[a] == got[b])


def test_all_families_stand_in_one_plan(spark):
    prints = spark.range(50).selectExpr("id AS fp", "id * 3 AS fp1", "id * 7 AS fp2", "id * 11 AS fp3")
    plan = family_links(prints, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


@pytest.mark.parametrize("hot, batch", [(65536, 32768), (16, 20)])
def test_values_of_unlike_views_are_never_linked(spark, hot, batch):
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    prints = scattered(4, 12, 20)
    rows = [(1000 * view + i, signed(p), view) for view in (0, 1) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "fp long, value long, view long")
    edges = {(r.u, r.v) for r in view_links(df, len(prints), 2, 4, 1024, hot, batch).collect()}
    want = components(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = components([r[0] for r in rows], lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == {1000 * view + i: 1000 * view + j for view in (0, 1) for i, j in want.items()}


def test_very_long_texts_are_read_whole():
    long = "word " * 200_000 + "tail"
    assert simhash(long.encode()) == plain_simhash(long)
    assert simhash((long + " end").encode(), 5) == simhashes((long + " end").encode(), 5, families=3)[0]


def test_every_row_gets_its_component(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200", "changed")
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(5, base, "a"), (3, near, "b"), (9, base, "c"), (9, base, "c"), (1, other, None), (None, other, "x"), (7, None, "x"), (8, "", "x"), (6, " \t\n", "x"), (None, "lone words here", "x")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of == {5: 3, 3: 3, 9: 3, 1: 1, 7: 6, 8: 6, 6: 6}
    assert {r.component_id for r in got if r.doc_id is None} == {1, None}


def test_an_empty_table_gives_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
