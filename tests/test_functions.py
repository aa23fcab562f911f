import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import metalog, scalars, taxa
from lexigrid.plans import making, sif


def column(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_sort_keys_ascend_in_document_order(spark):
    order = ["1", "2", "3", "3ZA", "3ZB", "3A", "3AA", "3AB", "3B", "4", "10", "41ZA", "100"]
    keys = column(spark, order, scalars.sort_key)
    assert keys == sorted(keys) and keys[3] == "003.001.000" and keys[6] == "003.010.010"
    assert column(spark, ["", " 19dza "], scalars.sort_key) == ["000.000.000", "019.040.001"]


def test_clean_text(spark):
    got = column(spark, ["<p>(1) The&nbsp;employer’s  duty</p>", "2. A – B", "", None], scalars.clean)
    assert got == ["The employer's duty", "A - B", "", None]


def test_dates_and_units(spark):
    texts = ["shall come into force on 1st April 2024", "comes into force in May 2021", "made on 3 May 2020", "ceased to have effect on 12 July 1999"]
    assert column(spark, texts, scalars.commencement_date) == ["2024-04-01", "2021-05-01", None, "1999-07-12"]
    assert column(spark, ["height 3 m", "10 feet up", "none"], scalars.metres) == [3.0, pytest.approx(3.048), None]
    assert column(spark, ["11kV line", "230 volts"], scalars.volts) == [11000.0, 230.0]
    assert column(spark, ["30 mph", "50 km/h"], scalars.kmh) == [pytest.approx(48.27), 50.0]


def test_purposes_and_modals(spark):
    assert column(spark, ["The employer shall ensure safety", "", "blue sky"], taxa.purposes) == [["Process+Rule+Constraint+Condition"], [], ["Unclassified"]]
    assert column(spark, ["He shall not", "they will act", "nothing"], lambda c: taxa.modal(c)["modal"]) == ["shall not", "will", None]
    assert column(spark, ["JSP 375 Chapter 8", "jsp 418", "Act 1974"], taxa.policy_citation) == ["JSP-375-CH08", "JSP-418", None]


def test_metalog_round_trips(spark):
    df = spark.createDataFrame([(2.0, 5.0, 8.0, "unbounded"), (1.0, 3.0, 9.0, "lower"), (0.2, 0.5, 0.7, "bounded"), (-9.0, -3.0, -1.0, "upper")], "a double, b double, c double, kind string")
    low, high = F.lit(0.0), F.when(F.col("kind") == "upper", 0.0).otherwise(1.0)
    fit = df.withColumn("k", metalog.fit_triplet("a", "b", "c", "kind", low, high))
    for p, name in ((0.1, "a"), (0.5, "b"), (0.9, "c")):
        rows = fit.select(metalog.quantile(p, "k", "kind", low, high).alias("q"), name, metalog.cdf(F.col(name), "k", "kind", low, high).alias("p"), metalog.feasible("k").alias("ok")).collect()
        assert all(r.q == pytest.approx(r[name]) and r.p == pytest.approx(p) and r.ok for r in rows)


def test_seeded_numbers_do_not_depend_on_partitions(spark):
    got = {r.trial: r.u for r in metalog.trials(spark, 500).repartition(7).collect()}
    want = metalog.uniforms(np.arange(1, 501), 1, 1)
    assert [got[i] for i in range(1, 501)] == want.tolist()
    assert 0 < want.min() and want.max() < 1 and abs(want.mean() - 0.5) < 0.05


def test_least_squares_recovers_a_triplet():
    p = np.array([0.1, 0.5, 0.9])
    got = metalog.fit_least_squares(p, np.array([2.0, 5.0, 8.0]), 3)
    assert got == pytest.approx([5.0, 6 / (2 * math.log(9)), 0.0], abs=1e-9)
    with pytest.raises(ValueError):
        metalog.fit_least_squares(p, p, 4)


def test_sif_chance(spark):
    df = spark.createDataFrame([(0.1, 0.1, 0.1), (0.01, 0.02, 0.03), (0.05, 0.1, 0.3), (0.4, 0.6, 0.8)], "a double, b double, c double")
    p = [r[0] for r in df.select(sif.p_sif("a", "b", "c")).collect()]
    assert p[0] == 1.0 and p[1] < 0.05 and p[2] == pytest.approx(0.5, abs=1e-3) and p[3] > 0.95


def test_making_scores(spark):
    rows = [(None, None, None, None), ("The X (Commencement) Order", None, None, None), (None, "An Act to make provision for securing health", 120, 0), ("The X (Amendment) (Revocation) Order", "", 2, 80)]
    got = making.detect(spark.createDataFrame(rows, "title string, description string, body_paras int, schedule_paras int")).collect()
    assert got[0].score == 0.173 and got[0]["class"] == "not_making" and got[0].tier == 0
    assert got[1].score == round(0.173 * (1 - 0.99 * 0.95), 4) and got[1].tier == 1
    assert got[2]["class"] == "making" and got[2].tier == 4
    assert [s.name for s in got[3].signals] == ["title_revocation", "title_amendment", "low_body_high_schedule", "very_low_body_paras"]


def test_actors_take_their_words_out(spark):
    from lexigrid.functions.actors import actors

    rows = [("The Secretary of State for Defence shall consult every employer and employee.", None), ("Ministers and employers", None), ("the public interest", None), (None, None), ("a diver dives", "OH&S: Offshore Safety")]
    words = (("Spc: Diver", "governed", ("OH&S: Offshore",), ("[Dd]ivers?",)),)
    from lexigrid.functions.actors import DICTIONARY

    df = spark.createDataFrame(rows, "text string, family string")
    got = [r[0] for r in df.select(actors("text", "family", DICTIONARY + words)).collect()]
    labels = [([a.label for a in r.governed], [a.label for a in r.government]) for r in got]
    assert labels == [(["Ind: Employee", "Org: Employer"], ["Gvt: Minister: Secretary of State for Defence"]), (["Org: Employer"], ["Gvt: Minister"]), ([], []), ([], []), (["Spc: Diver"], [])]
    assert got[0].government[0].offset == 5


def test_policy_text(spark):
    from lexigrid.functions import policy

    text = "See JSP 375 Volume 1, Chapter 8, BS EN ISO 14001 and the Health and Safety at Work etc. Act 1974: a fire risk assessment and a hazard log."
    assert [r.kind for r in column(spark, [text], policy.artefacts)[0]] == ["Risk Assessment", "Hazard Log"]
    cites = [r.citation for r in column(spark, [text], policy.references)[0]]
    assert "JSP 375 Volume 1, Chapter 8" in cites and "BS EN ISO 14001" in cites
    assert column(spark, ["see Regulation 4 and regulation 4, section 2(1)"], policy.cross_references) == [["Regulation 4", "section 2(1)"]]
    assert column(spark, ["The employer shall ensure no offence"], policy.modal_features)[0] == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 0, 0, 0, 1.0, 0]
    got = column(spark, ['{"title": "You must check", "linked_provisions": ["a"]}'], lambda c: policy.control_flags(c, F.array(F.lit("b")), {"nature": ("x",)}))[0]
    assert "DEONTIC: must" in got and "INVALID_REF: a" in got and "INVALID_ENUM: nature" in got and "MISSING_FIELD: description" in got
    assert column(spark, ["a"], lambda c: policy.softmax_class(F.array(F.lit(1.0), F.lit(0.0)), [[2.0, 0.0], [0.0, 5.0]], [0.0, 0.0], ["p", "q"])["label"]) == ["p"]


def test_inferred_actors(spark):
    from lexigrid.plans import reconcile

    rows = [(1, "Ind: Employee", "active", "Obligation"), (2, "Ind: Employee", "active", "Liberty"), (3, "EU: Member State", "active", None), (4, "Ind: Employee", "active", "Obligation"), (4, "Org: Employer", "mentioned", None)]
    df = spark.createDataFrame(rows, "section_id int, actor_label string, position string, drrp string")
    got = {(r.section_id, r.actor_label) for r in reconcile.infer(df, reconcile.rules(spark)).collect()}
    assert got == {(1, "Org: Employer"), (3, "Org: Responsible Undertaking")}


def test_obligations_and_terms():
    from lexigrid.functions.actors import DICTIONARY, compiled
    from lexigrid.functions.obligations import of_text, segments, terms_of

    text = "Managers are to: a. The employer must train staff. b. An employee is accountable for the permit. c. nothing here"
    assert len(segments(text)) >= 3 and segments("no list") == ["no list"]
    got = of_text("(a) The employer must use a competent person. (b) The employee is accountable for the permit.", compiled(DICTIONARY))
    assert [(o["modal"], [(r["label"], r["role"]) for r in o["roles"] if r["label"] in ("Org: Employer", "Ind: Employee")]) for o in got] == [("must", [("Org: Employer", "R")]), (None, [("Ind: Employee", "A")])]
    assert got[0]["competence"] == ["competent person"] and of_text(None, compiled(DICTIONARY)) == []
    terms = terms_of('The Defence Safety Authority (DSA) acts. A "safe place" means a room. See the Defence Safety Authority (DSA).')
    assert [(t["term"], t["acronym"]) for t in terms] == [("The Defence Safety Authority", "DSA"), ("safe place", None)]


def test_spans():
    from lexigrid.functions.spans import clause_span, nearest_qualifier

    source = "Unless exempt, the employer shall ensure safety so far as is practicable."
    start, end, text, ratio = clause_span("The Employer SHALL ensure safety", source)
    assert source[start:end] == text == "the employer shall ensure safety" and ratio == 1.0
    assert nearest_qualifier(source, start, end) == "so far as is practicable"
    assert clause_span("zzzz", source) is None and clause_span("", source) is None


def test_applicability_trees(spark):
    from lexigrid.plans.applicability import compile_laws, holds

    dims = {"employer": "personal", "mine": "place"}
    rows = [("A", 1, "AppliesTo", ["Employer", "mine"]), ("A", 2, "DisappliesTo", ["ship"]), ("A", 3, "DisappliesTo", ["mine"]), ("A", 4, "AppliesTo", ["2020-01-01"]), ("B", 1, "DisappliesTo", ["ship"]), ("C", 1, "AppliesTo", []), ("D", 1, "DisappliesTo", ["2021-01-01"])]
    laws = {r.law_name: json.loads(r.tree) for r in compile_laws(spark.createDataFrame(rows, "law_name string, id int, polarity string, entities array<string>"), dims).collect()}
    assert sorted(laws) == ["A", "D"] and laws["D"] == {"op": "TimeWindow", "from": None, "to": "2021-01-01"}
    tree = laws["A"]
    assert tree["op"] == "And" and [c["op"] for c in tree["children"]] == ["And", "Not", "TimeWindow"]
    here = {"personal": {"employer"}, "place": {"mine"}}
    assert holds(tree, here, "2021-05-01") and not holds(tree, here, "2019-05-01")
    assert not holds(tree, here | {"material": {"ship"}}, "2021-05-01") and not holds(tree, {"place": {"mine"}}, "2021-05-01")


def test_clauses(spark):
    from lexigrid.functions import clauses

    texts = ["First part. The employer shall keep records; and (b) notify the agency. More text.", "no modal here ", ", an operator may not enter the premises without", "The authority must"]
    assert column(spark, texts, clauses.refine) == ["The employer shall keep records; and (b) notify the agency.", "no modal here", "an operator may not enter the premises", "The authority must"]
    got = column(spark, ["Where a fire occurs, or smoke is seen, the employer must not delay, so far as is reasonably practicable, in writing.", "It shall be the duty of every owner to maintain the road", "nothing", "He shall"], clauses.decompose)
    assert (got[0].applicability, got[0].modal, got[0].qualifiers) == ("Where a fire occurs, or smoke is seen", "MustNot", ["Sfairp", "InWriting", "InSoFarAs"])
    assert got[0].action.startswith("delay,") and (got[1].modal, got[1].action) == ("HasDutyTo", "maintain the road")
    assert got[2] is None and got[3] is None


def test_duties():
    from lexigrid.functions.actors import DICTIONARY, compiled
    from lexigrid.functions.duties import strongest

    words = compiled(DICTIONARY)
    kind = lambda t: None if not (d := strongest(t, words)) or not d["actor"] else (d["actor"], d["kind"], d["duty_type"], d["confidence"])
    assert kind("Every employer shall ensure the safety of employees.") == ("Org: Employer", "GeneralDuty", "Obligation", 0.90)
    assert kind("The employer must not smoke.") == ("Org: Employer", "Prohibitive", "Obligation", 0.85)
    assert kind("An employee may leave the room.") == ("Ind: Employee", "Enabling", "Liberty", 0.50)
    assert kind("It shall be the duty of every employer to assess the risks.")[1:] == ("RiskAssessment", "Obligation", 0.85)
    assert kind("The plan must be prepared by the employer.")[1:] == ("Prescriptive", "Obligation", 0.65)
    assert kind("The employer may be late.") is None and kind("Clouds drift.") is None and kind(None) is None
    assert kind("Where an employer is absent, the officer shall act.") is None
    why = lambda t: {(x["reason"], x["actor"]) for x in strongest(t, words)["rejected"]}
    assert why("The employer may be late.") == {("epistemic_may", "Org: Employer")}
    assert why("Where an employer is absent, the officer shall act.") == {("subordinate_clause", "Org: Employer")}
    every = strongest("The employer shall not smoke and an employee may leave.", words)
    assert every["n_candidates"] == len(every["signals"]) > 2 and {s["tier"] for s in every["signals"]} == {"governed"}
    got = strongest("é The employer shall act.", words)
    assert (got["actor_start"], got["modal_start"], got["modal_end"]) == (7, 16, 21)


def test_government_offences_and_decisions(spark):
    from lexigrid.functions import decisions

    rows = [("The Secretary of State shall make regulations.", True), ("An inspector may serve a notice on the owner", True), ("The authority may charge a fee", True), ("Water flows", False)]
    df = spark.createDataFrame(rows, "text string, gov boolean")
    got = [[(s.tier, s.kind, s.confidence) for s in r[0]] for r in df.select(decisions.government("text", "gov")).collect()]
    assert got[0] == [("government_1", "RegulationMaking", 0.90), ("government_1", "Prescriptive", 0.60)]
    assert got[1] == [("government_1", "Enabling", 0.85), ("government_1", "Enabling", 0.55)] and got[3] == []
    texts = ["It is an offence for a person to smoke, liable to a fine.", "A person liable to a fine who commits an offence if late", "A person guilty of an offence is liable to a fine", "no"]
    assert [len(x) for x in column(spark, texts, decisions.offences)] == [1, 0, 0, 0]
    signals = F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(k).alias("kind"), F.lit(c).alias("confidence")) for t, k, c in (("offence", "Prohibitive", 0.9), ("government_2", "Fees", 0.7), ("government_2", "Enabling", 0.7))))
    won = column(spark, ["x shall y", "Nothing in this shall be done"], lambda c: decisions.decide(c, signals, F.lit(False)))
    assert (won[0].tier, won[0].kind, won[0].duty_type, won[0].n_candidates) == ("government_2", "Enabling", "Liberty", 3)
    assert (won[1].reason, won[1].kind) == ("legal_fiction", None)


def test_duties_of_persons_and_their_clauses(spark):
    from lexigrid.functions import duties

    texts = [
        "First. But no person shall enter the site; (a) at night. Then more.",
        "It shall be the duty of every person to ensure the health and safety of others.",
        "A person must not smoke.",
        "A person must be treated as an owner.",
        "Any person at work may ask for a copy within a day.",
        "the person responsible shall keep the register",
        "Nothing is said here",
        None,
    ]
    got = column(spark, texts, duties.duties)
    assert [(r.kind, r.confidence) if r.kind else None for r in got] == [("Prohibitive", 0.8), ("GeneralDuty", 0.9), ("Prohibitive", 0.8), None, ("Enabling", 0.5), ("Prescriptive", 0.65), None, None]
    assert got[0].clause == "But no person shall enter the site; (a) at night." and got[0].actor == "Ind: Person"


def test_rules_of_things(spark):
    from lexigrid.functions import records

    texts = ["Traffic routes must be suitable.", "The equipment of an employer must be safe, and the floor shall be dry.", "The premises may be used.", "An employer must act.", "x" * 90 + " routes " + "y" * 90 + " must be", None]
    kinds = [r[0].kind if r else None for r in column(spark, texts, records.rules_of_things)]
    assert kinds == ["ThingObligation", "ThingObligation", "Enabling", None, None, None]


def test_fitness_rules_turn_at_an_exception(spark):
    from lexigrid.functions import fitness

    texts = ["This Part shall not apply to ships, but shall apply to any dwelling in Scotland, see section 4(2).", "These Regulations apply to England.", "No such thing is said.", ""]
    got = column(spark, texts, fitness.rules)
    assert [[(r.polarity, [t.term for t in r.tags], list(r.references)) for r in rs] for rs in got] == [
        [("DisappliesTo", ["ship"], []), ("AppliesTo", ["Scotland", "dwelling"], ["section 4(2)."])],
        [("AppliesTo", ["England"], [])],
        [],
        [],
    ]
    assert [t.term for t in column(spark, ["a young person"], lambda c: fitness.tags(c, F.lit("OH&S: Offshore")))[0]] == ["young person"]
    assert column(spark, ["a young person"], fitness.tags) == [[]]


def test_full_records(spark):
    from lexigrid.functions import records

    rows = [(1, "3. The employer shall ensure, so far as is reasonably practicable, the safety of employees. More is said."), (2, "These Regulations may be cited as the Example Regulations 2024."), (3, " "), (4, None), (5, "The Secretary of State may make regulations on fees.")]
    got = {r.id: r for r in records.record(spark.createDataFrame(rows, "id int, text string"), "text").collect()}
    first = got[1]
    assert first.decision.tier == "governed" and first.duty.actor == "Org: Employer" and first.clause_parts.modal == "Shall"
    assert first.clause == "The employer shall ensure, so far as is reasonably practicable, the safety of employees." and first.clause_confidence > 0.8
    assert {p.label: p.position for p in first.positions}["Org: Employer"] == "active"
    assert got[2].decision.reason == "purpose_gated" and got[2].duty is None and got[2].clause is None
    assert got[3].decision.reason == got[4].decision.reason == "empty_text"
    assert got[5].decision.tier.startswith("government") and got[5].positions is None


def test_upserted_actors(spark):
    from lexigrid.operators import merge

    columns = [(c, "double" if c.endswith("confidence") else "string") for names in merge.SOURCES.values() for c in names if c]
    old = spark.createDataFrame([("s", "A", "Org")], "section_id string, actor_label string, category string").withColumns({c: F.lit("old").cast(t) if t == "string" else F.lit(0.1) for c, t in columns})
    signals = [("s", "A", None, "Duty", "active", "slm", 0.9, 2), ("s", "A", None, None, "mentioned", "slm", 0.8, 1), ("s", "B", "Ind", "Right", "active", "llm", None, 1), ("s", "C", "Ind", "Right", "active", "guess", None, 1)]
    got = {r.actor_label: r for r in merge.upsert_actors(old, spark.createDataFrame(signals, "section_id string, actor_label string, category string, drrp string, position string, tier string, confidence double, at int")).collect()}
    assert sorted(got) == ["A", "B"] and got["A"].category == "Org"
    assert (got["A"].slm_drrp, got["A"].slm_position, got["A"].slm_confidence, got["A"].regex_drrp) == ("Duty", "active", 0.9, "old")
    assert (got["B"].llm_drrp, got["B"].regex_drrp) == ("Right", None)


def test_global_orders_agree_with_one_window(spark):
    from pyspark.sql.window import Window

    from lexigrid.operators import ranking

    df = spark.range(500).select("id", F.when(F.col("id") % 50 != 7, (F.col("id") * 37 % 91).cast("double")).alias("x"))
    whole = df.withColumn("want", F.row_number().over(Window.orderBy(F.desc("x"), "id")) - 1)
    got = ranking.rate_by_rank(df, "x", "id").join(whole.select("id", "want"), "id").collect()
    assert all(r["rank"] == r.want for r in got) and len(got) == 500
    ranks = ranking.percent_ranks(df.where("x is not null"), "x", "p").withColumn("want", F.percent_rank().over(Window.orderBy("x"))).collect()
    assert all(abs(r.p - r.want) < 1e-12 for r in ranks)
    assert ranking.rate_by_rank(df.limit(0), "x", "id").collect() == []


def test_overlapping_citations_keep_the_longest(spark):
    from lexigrid.functions import policy

    texts = ["ECE Regulation 13 and BS EN ISO 14001, BS EN ISO 14001", "the Noise at Work Regulations 2005 and the Noise at Work Regulations 2005", "none", None]
    got = column(spark, texts, policy.references)
    assert [(r.kind, r.citation) for r in got[0]] == [("standard", "ECE Regulation 13"), ("standard", "BS EN ISO 14001")]
    assert [r.kind for r in got[1]] == ["legislation"] and got[2] == [] and got[3] is None


def test_models_are_loaded_by_the_task_and_fed_in_batches(spark):
    from lexigrid.functions import models

    def load():
        def model(texts):
            assert 0 < len(texts) <= 3
            return [[float(len(t)), float(t.count("a"))] for t in texts]

        return model

    rows = [(i, None if i == 4 else "a" * i) for i in range(11)]
    got = models.applied(spark.createDataFrame(rows, "id int, text string"), "text", "vector", "array<double>", load, batch=3).collect()
    assert {r.id: r.vector for r in got} == {i: None if t is None else [float(i), float(i)] for i, t in rows}

