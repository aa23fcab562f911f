import datetime
import hashlib
import random
import re
import struct

import pytest
import xxhash

from pyspark.sql import functions as F

from lexigrid.llm.syncmers import _bucket, fingerprints, matches, with_anchors, with_edits

SCHEMA = "doc_id long, text string, n_chars string"
PROSE = " ".join(f"word{i * i % 977}" for i in range(400))


def edited(rows):
    """The edit of distinct documents, by hand."""
    order = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(order):
        n = len(t) // 3
        out[d] = t[: len(t) - n] + order[(i + 1) % len(order)][1][:n]
    return out


def test_edits_follow_the_descending_order(spark):
    rows = [(i * 3, PROSE[i * 11 : i * 11 + i * 29] + "é😀"[: i % 3]) for i in range(60)] + [(500, None), (501, ""), (502, "ab"), (None, "no id here")]
    got = with_edits(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    want = edited(rows)
    assert {r.doc_id: r.edited_sha256 for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
    assert {r.doc_id: r.n_chars for r in got} == {d: len(t or "") for d, t in rows}
    assert len(got) == len(rows)


def test_equal_texts_have_equal_fingerprints_and_edits_stay_near(spark):
    other = " ".join(f"else{i * 7 % 1009}" for i in range(400))
    rows = [(1, PROSE), (2, other), (3, PROSE), (4, other + " tail"), (5, PROSE)]
    got = {r.doc_id: r for r in with_edits(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got[1].fingerprint == got[3].fingerprint == got[5].fingerprint != got[2].fingerprint
    assert all(0.3 < r.near_edited < 0.7 for r in got.values())
    assert all(r.near_next < 0.05 for d, r in got.items() if d != 1)
    assert got[1].near_next == 1.0  # after the last comes the first, whose text is the same


def test_repeated_rows_and_one_document(spark):
    got = with_edits(spark.createDataFrame([(1, PROSE, "x")] * 3, SCHEMA)).collect()
    n = len(PROSE) // 3
    assert len(got) == 3 and len(set(map(tuple, got))) == 1
    assert got[0].edited_sha256 == hashlib.sha256((PROSE[: len(PROSE) - n] + PROSE[:n]).encode()).hexdigest()
    assert with_edits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_anchors_depend_on_their_own_words_only(spark):
    left = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    right = spark.createDataFrame([(2, "some other words come first " + PROSE[600:2000])], "doc_id long, text string")
    got = matches(left, right).collect()
    assert len(got) == 1 and got[0].n_anchors > 20
    prints = [r.fingerprint for r in fingerprints(left.unionByName(left)).collect()]
    assert prints[0] == prints[1] and len(prints[0]) % 8 == 0


#: As PIECE of the operator, in Python's words.
PIECES = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]|[^\x20\x09-\x0D぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]{1,16}")


def fold(parts, seed=42):
    """XXH64 of longs in turn, each seeded by the hash before it."""
    for x in parts:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
    return seed


def brute_codes(text):
    """The codes of a text's closed syncmers, from their definition."""
    pieces = [xxhash.xxh64_intdigest(p.encode(), 42) for p in PIECES.findall(text or "")]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    if not pieces:
        return set()
    if len(pieces) < 5:
        return {xxhash.xxh64_intdigest(" ".join(str(signed(p)) for p in pieces).encode(), 42) >> 32}
    inner = [fold(pieces[i : i + 2]) for i in range(len(pieces) - 1)]
    out = set()
    for i in range(len(pieces) - 4):
        window = [signed(h) for h in inner[i : i + 4]]
        if min(window) in (window[0], window[-1]):
            out.add(fold([inner[i], inner[i + 2], pieces[i + 4]]) >> 32)
    return out


def test_fingerprints_and_likenesses_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["Word", "é", "a" * 40, "漢字", "x\u3000y", "한국어", "\x0bt", "zz"]
    rows = [(i, " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.choice([0, 2, 4, 5, 6, 60, 4000])))) for i in range(24)] + [(90, None)]
    got = {r.doc_id: r for r in with_edits(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    order = sorted(dict(rows), reverse=True)
    text = {d: t or "" for d, t in rows}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, d in enumerate(order):
        after = order[(k + 1) % len(order)]
        n = len(text[d]) // 3
        own, new = brute_codes(text[d]), brute_codes(text[d][: len(text[d]) - n] + text[after][:n])
        assert got[d].near_edited == pytest.approx(alike(own, new)) and got[d].near_next == pytest.approx(alike(own, brute_codes(text[after])))
        sample = sorted(own)[: max(128, sum(c < 1 << 29 for c in own))]
        assert got[d].fingerprint[16:] == "".join(f"{c:08x}" for c in sample)
        assert got[d].next_id == after


def test_a_fingerprint_shows_a_change_anywhere_in_a_long_text(spark):
    words = [f"w{i}" for i in range(30_000)]
    other = [*words[:29_000], "changed", *words[29_001:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    a, b = (r.fingerprint for r in fingerprints(df).collect())
    assert a[:16] != b[:16] and len(a) > 16 + 8 * 1000


def test_hot_and_null_doc_ids_have_many_buckets(spark):
    rng = random.Random(5)
    rows = [(7, f"hot {i} " + PROSE[: rng.randrange(200)]) for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(i, f"own {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.withColumn("_key", F.xxhash64("doc_id", "text"))
    sizes = [r["count"] for r in keyed.withColumn("b", _bucket(keyed)).groupBy("b").count().collect()]
    assert max(sizes) < 30
    got = [r.next_id for r in with_edits(df).collect()]
    assert len(got) == 900 and sum(x is None for x in got) == 300 and sum(x == 7 for x in got) == 301


def test_doc_ids_may_be_dates_but_not_strings(spark):
    rows = spark.createDataFrame([(datetime.date(2024, 1, k), f"text {k}") for k in range(1, 9)], "doc_id date, text string")
    got = {r.doc_id.day: r.next_id.day for r in with_edits(rows).collect()}
    assert got == {k: k - 1 or 8 for k in range(1, 9)}
    with pytest.raises(ValueError):
        with_edits(rows.withColumn("doc_id", rows.doc_id.cast("string")))


def test_likeness_counts_all_anchors_of_long_texts(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(6000))
    passage = " ".join(f"same{i}" for i in range(100))
    df = spark.createDataFrame([(1, words("a") + " " + passage), (2, passage + " " + words("b"))], "doc_id long, text string")
    got = {r.doc_id: r for r in with_edits(df).collect()}
    sets = {r.doc_id: {x.hash >> 32 for x in r.a} for r in with_anchors(df, "text", "a").collect()}
    shared = len(sets[1] & sets[2])
    assert shared > 20
    assert got[1].near_next == got[2].near_next == shared / len(sets[1] | sets[2])
