import corpus_pipeline
from lexigrid.llm.simhash import simhashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Three languages by their syllables; copies, a near copy, a benchmark passage, and texts without letters."""
    import random

    rng = random.Random(6)
    sounds = {"xx": ["ka", "to", "mi", "ra", "ne"], "yy": ["sch", "ung", "ein", "ber", "ö"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    rows = [(i, prose("xx" if i % 3 else "yy", 60 + i % 50), "xx" if i % 3 else "yy", f"s{i % 4}") for i in range(120)]
    item = prose("xx", 40)
    long = prose("xx", 500)
    rows += [(200, rows[5][1], "xx", "s1"), (201, long, "xx", "s0"), (202, long + " " + "ka", "xx", "s0"), (203, prose("xx", 30) + " " + item + " " + prose("xx", 30), "xx", "s2"), (204, None, None, "s0"), (205, "123 456", "xx", None), (206, prose("yy", 80), None, None)]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], item


def test_each_stage_decides_about_its_own_input(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    every = {r[0] for r in rows}
    kept = {r.doc_id for r in seen["language"]}
    assert kept == every - {204, 205}
    assert {r.doc_id: r.lang for r in seen["language"]}[206] == "yy"

    prints = {d: simhashes(t.encode(), 5, families=4, whole=5) for d, t, *_ in rows if d in kept}
    group = {d: d for d in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and min((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= 6:
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    unique = {d for d in kept if group[d] == d}
    assert {r.doc_id for r in seen["near_duplicates"]} == unique and 200 not in unique and 202 not in unique
    assert {r.doc_id for r in seen["decontamination"]} == unique - {203}
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(seen["mixing"]) - 1.5 * words(seen["decontamination"])) < 10
    assert sorted((r.doc_id, r.text) for r in seen["sharding"]) == sorted((r.doc_id, r.text) for r in seen["mixing"])
    assert sum(r.n_bytes for r in seen["sharding"]) == sum(len(r.text.encode()) for r in seen["mixing"])


def test_one_document_of_each_group_stays_whatever_the_doc_ids(spark):
    text, other = "one two three four five six seven", "entirely different words stand in this text here"
    rows = [(7, text, "a"), (7, text, "a"), (3, text, "b"), (None, text, "c"), (None, other, "d"), (None, other, "d"), (9, "x y", "e"), (8, "x y z", "f"), (5, None, "g"), (6, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [r for r in df.collect() if (r.doc_id, r._n) in [(3, "b"), (9, "e"), (8, "f"), (5, "g")]] + [r for r in df.collect() if r._n == "d"][:1]))


def test_what_near_duplicates_returns_is_a_small_plan(spark):
    docs = spark.createDataFrame([(i, f"ka to mi {i} " * 9, "xx", "s", 9) for i in range(9)], SCHEMA)
    plan = corpus_pipeline.drop_near_duplicates(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = SCHEMA + ", _key string, n_bytes string, score string, _row string"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"ka to mi {i} " * 30, "xx", "s", 9, "k", "b", "s", "f") for i in range(30)]
    for k, own in enumerate(([], rows)):
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert bool(docs.count()) == bool(own)
        assert {(r._key, r.score, r._row) for r in docs.collect()} <= {("k", "s", "f")}
