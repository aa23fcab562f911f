import random
import re

import pytest

from lexigrid.llm.licenses import ALL, PHRASES, TEMPLATES, scan

SCHEMA = "doc_id long, text string, tid string"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_match_brute_force(spark):
    rng = random.Random(8)
    bits = ["Under the MIT License", "apache", "license", "version", "2", "CC-BY-NC", "cc", "by", "nc", "é", "under the", "mit", "Apache License, Version 2.0", "\n", "K", "K"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(25))), "x") for i in range(80)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "cc by nc " * 300, "x"), (202, "cc by nc " * 300, "x"), (None, "under the mit license", "x")]
    got = scan(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_templates_are_found_with_words_put_in_or_left_out(spark):
    bsd = dict(TEMPLATES)["bsd"].split()
    changed = " ".join(bsd[:6] + ["every"] + bsd[6:])
    far = " ".join(bsd[:10])
    got = {r.doc_id: r for r in scan(spark.createDataFrame([(1, " ".join(bsd), "x"), (2, "so " + changed.upper(), "x"), (3, far, "x")], SCHEMA)).collect()}
    assert got[1].labels == got[2].labels == "bsd" and got[3].labels == ""
    assert got[1].score == 1 and 0.8 <= got[2].score < 1 and got[3].score == 0


def test_notices_by_name_and_one_changed_word(spark):
    by = "This work is licensed under a Creative Commons Attribution{} License."
    lgpl = dict(TEMPLATES)["lgpl"]
    rows = [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("Under the GNU Lesser General Public License.", "lgpl"),
        ("See the GNU Affero General Public License v3.", "agpl"),
        ("Mozilla Public License", "mpl"),
        ("Licensed under CC BY-SA 3.0", "cc-by-sa"),
        (by.format(" 3.0 International"), "cc-by"),
        (by.format("-ShareAlike 4.0 International"), "cc-by-sa"),
        (by.format("-NonCommercial-ShareAlike 2.5 International"), "cc-by-nc-sa"),
        (lgpl, "lgpl"),
        (lgpl + " " + "x " * 50 + dict(TEMPLATES)["gpl"], "gpl,lgpl"),
        ("a general public license of the creative commons", ""),
    ]
    got = {r.doc_id: r for r in scan(spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], SCHEMA)).collect()}
    assert [got[i].labels for i in range(len(rows))] == [x for _, x in rows]
    assert all((r.score > 0.7) == bool(r.labels) for r in got.values())


def test_an_empty_table(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_labels(text):
    """Labels and score of a text from the definition of diagonal voting."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    own = {}
    for i in range(len(words) - 2):
        own.setdefault(tuple(words[i : i + 3]), []).append(i)
    spans = []
    for label, template in ALL:
        t = template.split()
        votes = {}
        for j in range(len(t) - 2):
            for i in own.get(tuple(t[j : j + 3]), ()):
                votes.setdefault(i - j, set()).add((i, j))
        merged, last = [], None
        for d in sorted(votes):
            if last is None or d - last > 3:
                merged.append(set())
            merged[-1] |= votes[d]
            last = d
        n = len(t) - 2
        for m in merged:
            met = len({j for _, j in m})
            if met / n >= 0.8 or (n >= 9 and n - met <= 3):
                spans.append((min(i for i, _ in m), max(i for i, _ in m) + 3, met, met / n, label))
    beats = lambda a, b: a[4] != b[4] and a[0] < b[1] and b[0] < a[1] and (a[2], a[3]) > (b[2], b[3])
    best = [a for a in spans if not any(beats(b, a) for b in spans)]
    base = brute(text)[4]
    labels = sorted({a[4] for a in best} | set(filter(None, base.split(","))))
    return ",".join(labels), max([1.0 if base else 0.0, *(a[3] for a in best)])


def test_labels_and_scores_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 4)):
            part = rng.choice(ALL)[1].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], ["other"], [part[at], "more"], [part[at]]])
            words += part[rng.randrange(3) if rng.random() < 0.3 else 0 :] + ["filler"] * rng.randrange(4)
        rows.append((i, " ".join(words), "x"))
    rows.append((500, "plain " * 150_000 + ALL[4][1] + " end" * 100_000, "x"))
    got = {r.doc_id: (r.labels, r.score) for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, text, _ in rows:
        labels, score = brute_labels(text)
        assert got[d][0] == labels and abs(got[d][1] - score) < 1e-9, (d, text[:200])


def test_short_phrases_raise(spark):
    with pytest.raises(ValueError, match="fewer than"):
        scan(spark.createDataFrame([(1, "gpl", "x")], SCHEMA), phrases=(("gpl", "gnu gpl"),))
