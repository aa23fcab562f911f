import random
from collections import Counter

import numpy as np
import pandas as pd

from lexigrid.llm.langid import _counts, build, held_out, identify, normalise, train

SCHEMA = "doc_id long, text string, lang string, score string"
SOUNDS = {"xx": ["ka", "to", "mi", "ra", "ne"], "yy": ["sch", "ung", "ein", "ber", "ö"], "zz": ["ção", "lh", "nh", "os", "ar"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def docs():
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randrange(5, 60)), lang, "x") for i, lang in enumerate(rng.choice(list(SOUNDS)) for _ in range(300))]
    return rows + [(1000, None, "xx", "x"), (1001, "", "xx", "x"), (1002, "123 --- 456", "yy", "x"), (1003, prose(rng, "xx", 30), None, "x"), (None, prose(rng, "yy", 30), "yy", "x")]


def test_normalised_text_keeps_letters_and_single_spaces():
    codes, at, sizes = normalise(["Ab--c ", None, "!!", "é"], 3)
    assert "".join(map(chr, codes[at])) == "ab c é" and sizes.tolist() == [5, 0, 0, 1]


def test_held_out_documents_are_recognised(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    model = train(df)
    rows = df.select("doc_id", "text", held_out().alias("held"))
    got = {r.doc_id: r for r in identify(rows, model, "doc_id", "held").collect()}
    want = {d: lang for d, t, lang, _ in docs() if d is not None and d < 300}
    held = [d for d in want if got[d].held]
    assert 40 < len(held) < 120
    assert all(got[d].lang_pred == want[d] and not got[d].rejected for d in want)
    assert all(0 < got[d].score <= 1 for d in want)
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0 and got[1000].rejected
    assert got[1003].lang_pred == "xx" and got[None].lang_pred == "yy"


def test_probabilities_of_seen_contexts_sum_to_less_than_one(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    model = train(df)
    keys, logs = model.grams[0]
    total = np.exp(logs.astype(float)).sum(axis=0)
    assert ((total > 0.8) & (total <= 1.0001)).all()


def test_noise_is_rejected_and_no_language_is_und(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    rng = random.Random(9)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    got = identify(spark.createDataFrame([(1, noise, None, "x")], SCHEMA), train(df), "doc_id").collect()
    assert got[0].rejected
    none = identify(df, train(df.where("lang = 'nowhere'")), "doc_id").collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(docs())
    assert identify(df.limit(0), train(df), "doc_id").collect() == []


def test_noise_is_rejected_beside_a_rare_language_and_among_short_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    noise = spark.createDataFrame([(i, " ".join(word() for _ in range(80)), None, "x") for i in range(20)], SCHEMA)
    for most, sizes in ((60, {"xx": 150, "yy": 150, "zz": 6}), (60, {"xx": 150, "yy": 150, "zz": 1}), (8, {"xx": 100, "yy": 100, "zz": 100})):
        rows = [(1000 * j + i, prose(rng, x, rng.randrange(5, most)), x, "x") for j, (x, n) in enumerate(sizes.items()) for i in range(n)]
        model = train(spark.createDataFrame(rows, SCHEMA))
        assert np.isfinite(model.limit).all() and np.isfinite(model.floor).all()
        assert all(r.rejected for r in identify(noise, model, "doc_id").collect())
        fresh = [(9000 + i, prose(rng, x, rng.randrange(5, most)), x, "x") for i, x in enumerate(sizes) for _ in range(10) if sizes[x] > 1]
        assert not any(r.rejected for r in identify(spark.createDataFrame(fresh, SCHEMA), model, "lang").collect())


def test_a_model_of_nothing_is_empty():
    assert build(pd.DataFrame({"lang": [], "high": [], "low": [], "n": []})).languages == []


def brute_kneser_ney(texts, all_letters, order=5):
    """log p(character | those before it) of one language's interpolated Kneser-Ney model, by dictionaries and recursion."""
    counts = Counter()
    for t in texts:
        line = " " * (order - 1) + t
        counts.update(line[i - order + 1 : i + 1] for i in range(order - 1, len(line)))
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discounts, total, kinds = {}, {}, {}
    for n, c in levels.items():
        ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        discounts[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        for g, x in c.items():
            total[g[:-1]] = total.get(g[:-1], 0) + x
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / all_letters
        below, context = p(gram[1:]), gram[:-1]
        if not total.get(context):
            return below
        d = discounts[n]
        return max(levels[n][gram] - d, 0) / total[context] + d * kinds[context] / total[context] * below

    return p


def test_entropies_match_brute_force_kneser_ney():
    rng = random.Random(7)
    corpus = {x: [prose(rng, x, rng.randrange(1, 30)) for _ in range(8)] for x in SOUNDS}
    plain = lambda t: "".join(map(chr, (lambda c: c[0][c[1]])(normalise([t]))))
    model = build(pd.concat([_counts(ts).assign(lang=x) for x, ts in corpus.items()]))
    letters = len({c for ts in corpus.values() for t in ts for c in plain(t)}) + 1
    tests = [prose(rng, x, 20) for x in SOUNDS] + ["ünknown Letters wq", "k", "12 a 3", "ka " * 50_000]
    every, sizes = model.entropy(tests)
    for k, x in enumerate(model.languages):
        p = brute_kneser_ney([plain(t) for t in corpus[x]], letters)
        for r, t in enumerate(tests[:-1]):
            line = "    " + plain(t)
            want = -sum(np.log(p(line[i - 4 : i + 1])) for i in range(4, len(line))) / sizes[r]
            assert abs(every[r, k] - want) < 1e-3, (x, t)
    assert sizes[-1] == 150_000 - (0 if plain(tests[-1]).endswith(" ") else 1) and np.isfinite(every).all()


def test_without_labels_only_texts_without_letters_are_rejected(spark):
    df = spark.createDataFrame([(d, t, None, "x") for d, t, *_ in docs()], SCHEMA)
    got = identify(df, train(df), "doc_id", "text").collect()
    assert {r.lang_pred for r in got} == {"und"} and {r.score for r in got} == {0.0}
    assert {r.doc_id for r in got if r.rejected} == {1000, 1001, 1002}


def test_n_grams_reach_the_driver_as_columns_not_as_rows(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    rows = spark.createDataFrame([(i, words(), "xx") for i in range(40)], "doc_id long, text string, lang string")
    frame, collected = type(rows), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (collected.append(len(got := collect(self))), got)[1])
    assert len(train(rows).grams[-1][0]) > 1000
    assert max(collected) <= 40
