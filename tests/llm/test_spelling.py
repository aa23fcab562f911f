import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import queries
from lexigrid.llm.spelling import deletion_keys, group_spellings, shared, variants

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def counted(rows, length=5, times=3, noise=97):
    n = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if noise and h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= times}


def edits(word):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in LETTERS}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in LETTERS}
    return out - {word}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def brute(n, ratio=2, near=None):
    near = near or (lambda w: edits(w) & n.keys())
    form, count = {}, {}
    for w in n:
        own = near(w)
        count[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


@pytest.mark.parametrize("letters", ["ab", "abcé÷", LETTERS])
def test_variants_by_brute_force(spark, letters):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    words = {w for b in base for w in [b, *rng.sample(sorted(edits(b)), 15)] if w}
    n = {w: rng.choice([1, 1, 2, 3, 6, 12, 25, 100]) for w in words}
    assert told(variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_words_of_documents_by_brute_force(spark):
    rng = random.Random(5)
    base = ["Straße", "naïveté", "colour", "Color", "colors", "ÉTUDE", "étude", "hello", "helllo", "abcdefgh", "x" * 40, "İstanbul", "Kelvin", "été×jour", "short", "tiny", "don't", "foo_bar12baz"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(60))) for i in range(150)] + [(None, "colour étude " * 9), (7, None), (8, ""), (9, "colour colour"), (9, "colour colour"), (10, "12 -- ...")]
    got = group_spellings(spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, word string, n int"), noise=97)
    want = counted(rows)
    assert told(got) == brute(want) and len(want) > 20
    assert told(group_spellings(spark.createDataFrame(rows, "doc_id long, text string"), 2, 1, 3)) == brute(counted(rows, 2, 1, 0), 3)


def test_very_long_words(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abc") for _ in range(100_000))
    same = "z" * 50_000
    n = {long: 9, long[:70] + "d" + long[71:]: 4, long + "a": 1, long[1:]: 1, long[:-1] + "q": 20, same: 5, same + "z": 50, same + "zz": 1, same[1:] + "y": 2}
    got = told(variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n, near=lambda w: {x for x in n if one_apart(w, x)})


def test_rows_that_share_a_key_across_batches():
    key = np.array([1, 1, 2, 3, 3, 3, 4, 5, 5], np.int64)
    for size in (1, 2, 3, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(np.arange(i, min(9, i + size)))], ["key", "id"]) for i in range(0, 9, size)]
        got = [x for b in shared(iter(batches)) for x in b.column("id").to_pylist()]
        assert got == [0, 1, 3, 4, 5, 7, 8]


def test_keys_that_clash_are_told_apart_by_their_strings(spark, monkeypatch):
    n = {"abcde": 9, "abcdf": 3, "vwxyz": 8, "vwxy": 2, "qqqqq": 1}
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(["aab", "ab"])], ["id", "word"])
    made = deletion_keys(batch)
    rows = list(zip(*(made.column(c).to_pylist() for c in ("key", "id", "slot", "at")), strict=True))
    assert [r[1:] for r in rows] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 1), (0, -1, 0), (0, -1, 2), (1, -1, 0), (1, -1, 1), (0, -1, -1), (1, -1, -1)]
    assert rows[5][0] == rows[10][0] and len({r[0] for r in rows}) == 10
    import lexigrid.llm.spelling as spelling

    def clashing(batches):
        for b in batches:
            out = deletion_keys(b)
            yield out.set_column(0, "key", pa.array(out.column("key").to_numpy() % 2))

    monkeypatch.setattr(spelling, "_hash", clashing)
    assert told(variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_an_empty_table(spark):
    assert group_spellings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query_over_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    df = queries.QUERIES["op13_spelling"](spark, folder)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert told(df) == brute(counted(rows))
