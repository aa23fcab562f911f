import hashlib
import re

import duckdb
import pytest

from lexigrid.llm import queries
from lexigrid.llm.infilling import fill_in_middle, restore, units

SCHEMA = "doc_id long, text string, form string, row string"
GRAMMARS = {
    "token": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "run": r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "line": r"[^\n]*\n|[^\n]+",
}
TEXTS = [None, "", " ", "\n", "one", " one", "one ", "one two  three\t\nfour\n", "  x y", "a\U0001f600 \U0001f600b ́c", "with <P> in it", "x <S>", "<M>", "< P>", "\x00 \x1f \x85 a", "<P <S <M < P>S> M>", "é " * 50, "x\r\ny\n\nz", "same text of many", "same text of many"]


def brute(doc_id, text, grammar=GRAMMARS["token"], rate=50, first=80, seed=42):
    text = text or ""
    own = re.findall(grammar, text)
    assert "".join(own) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(own), "plain", None, None, None, text
    a, b = sorted((h[0] % (len(own) + 1), h[1] % (len(own) + 1)))
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    if h[3] % 100 < first:
        return len(own), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(own), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", sorted(GRAMMARS))
def test_units_are_those_of_the_grammar(spark, unit):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(t or "",) for t in TEXTS], "text string").select("text", units(F.col("text"), unit).alias("u")).collect()
    for r in got:
        assert r.u == re.findall(GRAMMARS[unit], r.text), r.text


@pytest.mark.parametrize("unit", sorted(GRAMMARS))
@pytest.mark.parametrize("rate", [50, 100, 0])
def test_all_forms_by_brute_force_and_undone(spark, unit, rate):
    rows = [(i, TEXTS[i % len(TEXTS)], "clash", "clash") for i in range(400)] + [(None, "null id here too", "a", "b"), (7, "a b c d", "x", "y"), (7, "a b c d", "x", "y")]
    got = fill_in_middle(spark.createDataFrame(rows, SCHEMA), unit, rate)
    assert got.columns == ["doc_id", "text", "row", "n_units", "form", "prefix", "middle", "suffix", "output"]
    got = got.withColumn("back", restore("output", "form")).collect()
    assert sorted((str(r.doc_id), str(r.text), r.n_units, r.form, str(r.prefix), str(r.middle), str(r.suffix), r.output) for r in got) == sorted(
        (str(d), str(t), n, f, str(p), str(m), str(s), o) for d, t, _, _ in rows for n, f, p, m, s, o in [brute(d, t, GRAMMARS[unit], rate)]
    )
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == ({"plain"} if not rate else {"plain", "spm", "psm"})


def test_a_very_long_text(spark):
    text = "  word\n" * 200_000
    ids = [i for i in range(40) if brute(i, "a b")[1] != "plain"][:3]
    got = fill_in_middle(spark.createDataFrame([(i, text, "", "") for i in ids], SCHEMA)).withColumn("back", restore("output", "form")).collect()
    assert all(r.back == text and r.n_units == 200_001 and (r.n_units, r.form, r.prefix, r.middle, r.suffix, r.output) == brute(r.doc_id, text) for r in got)


def test_an_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_query_agrees_with_sql(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        df = queries.QUERIES["op11_infilling"](spark, folder)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'/*.parquet' if folder == str(tmp_path) else ''}'")
        rel = con.sql(queries.ORACLE["op11_infilling"])
        assert rel.columns == df.columns
        assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in df.collect())
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
