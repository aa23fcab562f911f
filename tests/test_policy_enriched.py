"""What policy provisions are searched for, against the same patterns without a look for their literals first."""

import random
import string

import regex
from pyspark.sql import functions as F

from lexigrid.functions import actors, obligations, policy, screens, taxa

BITS = ["The employer", "NDA", "mandate", "the NDA", "Nuclear Decommissioning Authority", "a local authority", "persons", "the person who then imports", "inspectors", "Secretary of State", "the competent authority", "operators"]
BITS += ["shall not", "must", "is to", "are required", "nothing", "ſhall", "should", "a. ", "(b) ", ". (iv) ", "is accountable for", "in consultation with", "must be informed", "reported to", "Competent Person", "CERTİFIED"]
BITS += ["Example Regulations 2004", "the Health Act\n1974", "Act", "JSP 375 Chapter 8", "BS EN 5", "HSE L5", "XL5", "INDG 73", "The Health Board (HB)", "(ABC)", "lorem ipsum " * 30]


def texts(n=300):
    r = random.Random(8)
    return ["", *BITS] + ["".join(r.choice(BITS) + r.choice([" ", ". ", ", ", "", "\n"]) for _ in range(r.randint(1, 9))) for _ in range(n)]


def plainly(text, patterns):
    whole = left = f" {text} "
    found = {}
    for w in patterns:
        if m := w.pattern.search(left):
            word = m[0].strip().strip(string.punctuation)
            place = whole.find(word)
            found.setdefault(w.label, (w.label, word.lower(), len(whole[: place if place >= 0 else m.start()].encode())))
            left = left[: m.start()] + left[m.end() :]
    return sorted(found.values())


def test_actors_are_those_of_searches_from_the_start():
    words = actors.compiled(actors.DICTIONARY)
    for patterns in words.core.values():
        got = [actors.matched(t, patterns, words) for t in texts()]
        assert got == [plainly(t, patterns) for t in texts()] and any(got)


def test_a_pattern_is_not_searched_where_its_own_case_is_missing():
    words = actors.compiled([("Body", "governed", (), ("Nuclear Body|NDA|[Tt]he NDA",))])
    assert words.core["governed"][0].own == ("Nuclear Body", "NDA", "he NDA")
    assert actors.matched("a mandate", words.core["governed"], words) == [] and len(actors.matched("the NDA", words.core["governed"], words)) == 1
    assert screens.own_words("(?i)NDA") == screens.own_words("NDA|[a-z]") == () and screens.own_words(r"\bAB?C{2}DE\.F\b") == ("DE.F",)


def test_segments_start_at_the_markers():
    for t in texts():
        starts = [m.start() for m in regex.finditer(obligations.MARKER, t)]
        cuts = sorted({0, *starts, len(t)})
        assert obligations.segments(t) == ([t] if len(starts) < 2 else [s for a, b in zip(cuts, cuts[1:]) if (s := t[a:b].strip())]), t


def test_modals_and_citations_are_those_of_their_patterns(spark):
    df = spark.createDataFrame([(t,) for t in [None, *texts()]], "t string")
    low = F.lower("t")
    name = F.coalesce(*(F.when(low.rlike("(?U)" + p), m) for p, m, *_ in taxa.MODALS))
    counts = [F.size(F.regexp_extract_all("t", F.lit(p), F.lit(0))) for p, k in policy.REFERENCES if k != "legislation"]
    cited = [F.size(policy._cited(F.col("t"), p, k, *by)) for (p, k), by in zip(policy.REFERENCES, policy._CITED_BY, strict=True) if k != "legislation"]
    rows = df.select(taxa.modal("t")["modal"].alias("x"), name.alias("y"), F.array(*cited).alias("c"), F.array(*counts).alias("d")).collect()
    assert all(r["x"] == r["y"] and r["c"] == r["d"] for r in rows) and any(r["x"] for r in rows)


def test_a_text_goes_to_one_python_process(spark):
    from lexigrid.plans import policies

    df = policies.enriched(spark.createDataFrame([(t,) for t in texts(20)], "t string"), "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
