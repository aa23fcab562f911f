import random
import re

import numpy as np
import pyarrow as pa

from lexigrid.llm.decontamination import clean, contaminated, index, leaks, maximal, tile

SCHEMA = "doc_id long, text string, item_id string"
ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from tall trees".split()


def brute_tiles(doc, item, least):
    """Greedy string tiling straight from its definition."""
    p_used, q_used, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in p_used and q + n not in q_used:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < least:
            return sorted(out)
        n, p, q = best
        out.append((p, q, n))
        p_used.update(range(p, p + n))
        q_used.update(range(q, q + n))


def test_tiles_match_the_definition():
    rng = random.Random(5)
    for k in range(300):
        doc = [rng.randrange(k % 4 + 1) for _ in range(rng.randrange(30))]
        item = [rng.randrange(k % 4 + 1) for _ in range(rng.randrange(20))]
        found = {}
        for q in range(len(item) - 2):
            own = [p for p in range(len(doc) - 2) if doc[p : p + 3] == item[q : q + 3]]
            if own:
                found[q] = np.array(own)
        runs = maximal(list(found), list(found.values()), 3)
        assert sorted(tile(runs, len(item), 3)) == brute_tiles(doc, item, 3)


def brute_leaks(texts, items, least=5, cover=0.5):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for r, t in enumerate(texts):
        for i, x in enumerate(items):
            doc, item = words(t), words(x)
            if 2 <= len(item) < least:
                at = next((p for p in range(len(doc)) if doc[p : p + len(item)] == item), None)
                tiles = [] if at is None else [(at, 0, len(item))]
            else:
                tiles = brute_tiles(doc, item, least) if len(item) >= least else []
            share = sum(n for _, _, n in tiles) / max(1, len(item))
            if tiles and share >= cover:
                out.append((r, i, share, tiles))
    return sorted(out)


def test_leaks_match_brute_force():
    rng = random.Random(2)
    vocabulary = ["ä", "bee", "c3", "Dog", "e"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    for _ in range(20):
        items = [text(rng.randrange(12)) for _ in range(6)] + [None, "", "one", "bee c3", "ä bee", "bee c3"]
        texts = [text(rng.randrange(25)) for _ in range(12)] + [None, "", *items[:3]]
        got = [(r, i, share, tiles) for r, i, share, tiles in leaks(pa.array(texts, pa.string()), index(list(range(len(items))), items))]
        assert sorted(got) == brute_leaks(texts, items)


def test_a_phrase_repeated_without_end_stays_small():
    text, item = "again " * 200_000, "again " * 400
    ((_, _, share, tiles),) = leaks(pa.array([text]), index([1], [item]))
    assert share == 1.0 and tiles == [(0, 0, 400)]


def test_reordered_passages_are_found_and_clean_ones_left(spark):
    moved = " ".join(ITEM[9:] + ["between"] * 3 + ITEM[:9]).upper()
    rows = [
        (1, "before, " + "; ".join(ITEM) + " after", "x"),
        (2, moved, "x"),
        (3, " ".join(ITEM[:6]), "x"),
        (4, " ".join(reversed(ITEM)), "x"),
        (5, None, "x"),
        (6, "", "x"),
        (2, moved, "x"),
        (None, " ".join(ITEM), "x"),
    ]
    bench = spark.createDataFrame([(10, " ".join(ITEM)), (11, "too short"), (12, None), (10, " ".join(ITEM)[:0])], "item_id long, text string")
    df = spark.createDataFrame(rows, SCHEMA)
    got = contaminated(df, bench).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in got) == sorted(["(1, 10)", "(2, 10)", "(2, 10)", "(None, 10)"])
    assert {r.n_tiles for r in got if r.doc_id == 2} == {2}
    assert {r.coverage for r in got if r.doc_id == 1} == {1.0}
    assert sorted(str(r.doc_id) for r in clean(df, bench).collect()) == ["3", "4", "5", "6"]
    blocks = contaminated(df, bench, most=20).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in blocks) == sorted(str((r.doc_id, r.item_id)) for r in got)
    assert sorted(str(r.doc_id) for r in clean(df, bench, most=20).collect()) == ["3", "4", "5", "6"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    assert contaminated(df, some).collect() == [] and contaminated(df, none).collect() == []
    assert clean(df, some).collect() == []
