import random

from lexigrid.llm.lines import dedup_lines

SCHEMA = "doc_id long, text string, n_lines string"


def brute(rows):
    seen, out = {}, []
    order = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    owner = {}
    for none, d, t in order:
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            owner.setdefault(tuple(lines[i : i + 3]), (none, d, t, i))
    for none, d, t in order:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            if owner[tuple(lines[i : i + 3])] != (none, d, t, i):
                gone |= {i, i + 1, i + 2}
        seen[none, d, t] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), sum(i in gone and i - 1 not in gone for i in range(len(lines))))
    for d, t in rows:
        out.append((d, *seen[d is None, d or 0, t]) if t is not None else (d, None, 0, 0, 0))
    return sorted(out, key=str)


def test_later_windows_go(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "é", "long line"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a\nb"), (None, "u\nv\nw"), (103, "u\nv\nw"), (104, "u\nv\nw\nu\nv\nw\nx"), (105, "q\n" * 50)]
    rows += [(106, "r\ns\nt\nu\nv"), (106, "r\ns\nt\nu\nv")]
    got = dedup_lines(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_spans) for r in got), key=str) == brute(rows)


def test_an_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_very_long_text_and_columns_named_like_inner_ones(spark):
    many = "\n".join(f"line {i % 700}" for i in range(30_000))
    rows = [(1, many, "a", "b"), (2, "x\n" + "\n".join(f"line {i}" for i in range(5)), "a", "b")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, _key string, starts string")).collect()}
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_spans) for r in got.values()) == brute([(d, t) for d, t, *_ in rows])
