"""Decisions and their trails against a plain-Python fold over signals that are found anew by the tables' patterns."""

import json

import pytest
import regex
from pyspark.sql import functions as F

from lexigrid.functions import decisions, duties, records, taxa
from lexigrid.functions.actors import DICTIONARY, compiled, extract
from lexigrid.functions.dictionary import GOVERNMENT_WORDS
from lexigrid.plans import catalog
from lexigrid.plans.bindings import bound

FOLDER = "/root/testdata/sf0.001"


def has(pattern, text):
    m = regex.search(pattern, text, regex.IGNORECASE)
    return m and m.start() + 1


def government(text, named):
    may, must = has(taxa.ENABLING, text), has(taxa.OBLIGATION, text)
    free = bool(may and (not must or may < must))
    out = []
    for tier, table in (("government_1", decisions.FIRST), ("government_2", decisions.SECOND)):
        for kind, confidence, needs, pattern in table:
            if has(pattern, text) and (named or not needs):
                out.append((tier, "Enabling" if free else kind, confidence))
    if named and must and not free:
        out.append(("government_1", "Prescriptive", decisions.BLUNT_OBLIGATION))
    if named and free:
        out.append(("government_1", "Enabling", decisions.BLUNT_ENABLING))
    return out


def offences(text):
    if has(decisions.PENALTY_FIRST, text):
        return [], [("offence", "penalty_provision", None)]
    signals, rejected, penalty = [], [], has(decisions.PENALTY, text)
    for confidence, pattern in decisions.OFFENCES:
        if at := has(pattern, text):
            if penalty and penalty < at:
                rejected.append(("offence", "penalty_provision", None))
            else:
                signals.append(("offence", "Prohibitive", confidence))
    return signals, rejected


def decided(text, own, actor, words, rules=()):
    """(reason, winner, candidates, rejected) of a text with these purposes."""
    structural = {taxa.ENACTMENT, taxa.INTERPRETATION, taxa.AMENDMENT, taxa.REPEAL}
    gated = bool(own) and (taxa.AMENDMENT in own or (not actor and (taxa.REPEAL in own or taxa.OFFENCE in own or set(own) <= structural or own[0] in (taxa.INTERPRETATION, taxa.ENACTMENT, taxa.UNCLASSIFIED, taxa.APPLICATION))))
    if gated:
        return "purpose_gated", None, 0, []
    if has(taxa.SUMMARY, text):
        return "descriptive_summary", None, 0, []
    governed = (regex.search(duties.WORDS, text) and duties.strongest(text, words)) or {"signals": [], "rejected": []}
    signals = [(s["tier"], s["kind"], s["confidence"]) for s in governed["signals"]] + government(text, any(w in text.lower() for w in GOVERNMENT_WORDS))
    rejected = [(r["tier"], r["reason"], r["actor"]) for r in governed["rejected"]]
    more, no = offences(text)
    signals, rejected = [*signals, *more, *rules], rejected + no
    if has(taxa.FICTION, text) and not has(taxa.IMMUNITY, text):
        return "legal_fiction", None, 0, rejected + [(tier, "legal_fiction", None) for tier, _, _ in signals]
    if not signals:
        return "no_signals", None, 0, rejected
    first = min(decisions.TIERS.index(t) for t, _, _ in signals)
    best = max((c, i) for i, (t, _, c) in enumerate(signals) if decisions.TIERS.index(t) == first)
    return "tier_priority", signals[best[1]], len(signals), rejected


@pytest.fixture(scope="module")
def words():
    return compiled(DICTIONARY)


def test_decisions_of_whole_texts(spark, words):
    texts = {r.doc_id: (r.sentence, r.own, r.gov) for r in bound(spark, FOLDER, "texts").select("doc_id", "sentence", taxa.purposes("sentence").alias("own"), decisions.names_government("sentence").alias("gov")).collect()}
    got = catalog.QUERIES["duty_decisions"](spark, FOLDER).collect()
    assert len(got) == len(texts) and len({r.reason for r in got}) >= 3
    for r in got:
        text, own, gov = texts[r.doc_id]
        assert gov == any(w in text.lower() for w in GOVERNMENT_WORDS)
        reason, winner, n, rejected = decided(text, own, gov, words)
        assert (r.reason, r.n_candidates) == (reason, n), text
        assert (r.tier, r.kind, r.confidence) == (winner or (None, None, None))
        assert r.rejected == "|".join("/".join(x for x in row if x is not None) for row in rejected)


TEXTS = [
    "The employer shall be treated as an occupier and an employee may leave the site.",
    "The employer may be late.",
    "Where an employer is absent, the officer shall act.",
    "A person guilty of an offence shall be liable to a fine.",
    "Regulations made under this Act shall require notices.",
    "The council shall keep the bridge open.",
    "This Act imposes duties; these Regulations require notice.",
    "These Regulations impose duties on the employer, who shall act.",
    "A contractor liable on conviction to a fine commits an offence if the notice is late.",
    "The employer shall not smoke, but an employee may smoke at the gate.",
    "The handrail shall be strong.",
    "Clouds drift.",
    "",
    "  ",
    None,
]


def test_trails_list_winner_candidates_and_rejections(spark, words):
    df = records.record(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string"), "text")
    rules = df.select("id", records.rules_of_things("clean_text").alias("rules"), "purposes", "clean_text", "decision", records.trail().alias("trail"), F.size("actors.government").alias("n_gov")).collect()
    seen = set()
    for r in rules:
        trail = json.loads(r.trail)
        assert trail["candidates"] == r.decision.n_candidates and trail["rejections"] == len(trail["rejected"])
        if not (r.clean_text or "").strip():
            assert trail["reason"] == "empty_text" and trail["candidates"] == 0
            continue
        reason, winner, n, rejected = decided(r.clean_text, r.purposes, r.n_gov > 0, words, [tuple(x) for x in r.rules])
        seen.add(reason)
        assert (trail["reason"], trail["candidates"]) == (reason, n), r.clean_text
        assert [(x["tier"], x["reason"], x.get("actor")) for x in trail["rejected"]] == rejected
        assert tuple(trail.get("winner", {}).values()) == (winner or ())
    assert {"tier_priority", "legal_fiction", "purpose_gated"} <= seen
    assert extract(TEXTS[4], None, words)["government"] == [] and government(TEXTS[4], True)
