"""Roles of policy documents against all patterns over the whole text."""

import random

from pyspark.sql import functions as F

from lexigrid.functions import actors
from lexigrid.functions.dictionary import POLICIES

WORDS = ["Duty Holder", "duty holder", "Senior Duty Holder", "DUTY HOLDER", "CO", "co", "ACO", "CO2", "HoE", "USO", "manager", "Line Manager", "line manager", "Secretary of State", "Secretary of State for Defence"]
WORDS += ["Range Authorised Officer", "range authorising officer", "Chief Environmental and Safety Officer", "Defence Fire Regulator", "Defence Fire Safety Regulator", "Operator", "co-operator", "operators", "EPA", "TLB", "Person in Charge"]
MARKS = [" ", ", ", ".", "-", "é", "’", " ", "\n", "ſ", "K", "\0", "x"]


def texts():
    r = random.Random(11)
    out = [None, "", " ", "CO", "User", *WORDS]
    for _ in range(400):
        filler = lambda: "lorem ipsum " * r.choice([0, 0, 1, 16, 17, 18, 60])
        out.append("".join(r.choice(MARKS) + r.choice([r.choice(WORDS), filler()]) + r.choice(MARKS) for _ in range(r.randint(1, 6))))
    for n in (3, 49, 50, 51, 199, 400, 900):  # white space, of which a pattern takes any length
        out += [f"the Secretary of State{' ' * n}for Defence may", f"the Secretary of State{' ' * n}may", f"lorem {' ' * n} CO {' ' * n} ipsum"]
    return out


def whole(text, kind):
    """Every pattern of a kind over the whole text: labels with the first of their patterns that matches."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    each = []
    for label, own, _, patterns in POLICIES:
        if own == kind and patterns:
            ps = [f"{actors.EDGE}(?:{x}){actors.EDGE}" for x in patterns]
            word = F.coalesce(*(F.when(padded.rlike(p), F.lower(F.trim(F.regexp_extract(padded, p, 0)))) for p in ps))
            each.append(F.when(word.isNotNull(), F.concat(F.lit(label + "="), word)))
    return F.array_join(F.filter(F.array(*each), lambda x: x.isNotNull()), "|")


def test_policy_actors_are_those_of_the_whole_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i long, t string").repartition(4)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["label"], x["keyword"])), "|")
    got = df.select("i", actors.policy_actors("t").alias("a")).select("i", shown("a.governed").alias("x"), shown("a.government").alias("y"))
    want = df.select("i", whole(F.col("t"), "governed").alias("x"), whole(F.col("t"), "government").alias("y"))
    got, want = ({r["i"]: (r["x"], r["y"]) for r in d.collect()} for d in (got, want))
    assert got == want
    assert sum(1 for x, y in got.values() if x) > 100 and sum(1 for x, y in got.values() if y) > 20


def test_patterns_run_over_little_of_a_long_text(spark):
    long = "lorem ipsum " * 5000
    df = spark.createDataFrame([(f"{long}the Duty Holder {long}",), (long,)], "t string")
    near = df.select(actors.surroundings(F.col("t"), {"duty holder": 0}, {"CO": 1}).alias("x")).select("x.present", "x.near").collect()
    assert [r["present"] for r in near] == [[0], []]
    assert "the Duty Holder" in near[0]["near"] and len(near[0]["near"]) <= 2 * actors.NEARBY and near[1]["near"] == ""
