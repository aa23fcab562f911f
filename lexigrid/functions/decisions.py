"""Signals of governmental duties and of offences as duties, and the decision among all signals; native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions import screens
from lexigrid.functions.dictionary import GOVERNMENT_WORDS
from lexigrid.functions.taxa import ENABLING, OBLIGATION, descriptive_summary, found, legal_fiction, let

# What governments do: (kind, confidence, needs a governmental actor, pattern), in two tiers.
FIRST = (
    ("Prescriptive", 0.85, False, r"\bmember states?\b.*\bshall\b.*\b(?:ensure|require|establish|provide|take)\b"),
    ("RegulationMaking", 0.90, False, r"secretary of state\b.*\bshall\b.*\bmake\b.*\bregulations\b"),
    ("RegulationMaking", 0.85, False, r"\bpower to make regulations\b"),
    ("CodeApproval", 0.85, False, r"\bapprove\b.*\bcode of practice\b"),
    ("Enforcement", 0.85, False, r"\b(?:inspector|enforcing authority)\b.*\b(?:serve|issue)\b.*\b(?:notice|prohibition)\b"),
    ("Enforcement", 0.80, False, r"\bimprovement notice\b|\bprohibition notice\b"),
)
SECOND = (
    ("Direction", 0.80, False, r"\b(?:secretary of state|minister|authority)\b.*\bgive\b.*\bdirection"),
    ("Guidance", 0.75, True, r"\bissue\b.*\bguidance\b"),
    ("ConsultationObligation", 0.75, False, r"\b(?:secretary of state|minister)\b.*\bconsult\b"),
    ("Appointment", 0.80, False, r"\bappoint\b.*\binspector"),
    ("Delegation", 0.70, True, r"\bdelegate\b|\btransfer\b.*\bfunction"),
    ("Fees", 0.65, True, r"\bfees?\b|\bcharges?\b|\blevy\b"),
    ("ParliamentaryReporting", 0.80, False, r"\breport\b.*\bparliament\b|\blaid? before parliament\b"),
)
BLUNT_ENABLING, BLUNT_OBLIGATION = 0.55, 0.60
OFFENCES = (
    (0.70, r"\bit (?:is|shall be) an offence for\b"),
    (0.70, r"\bcommits? an offence if\b"),
    (0.65, r"\b(?:shall be|is) guilty of an offence if\b"),
    (0.70, r"\bit (?:is|shall be) unlawful for\b"),
)
PENALTY_FIRST = r"(?:^|\. )\s*(?:a |any )?person (?:who is |)guilty of (?:an |the |such an? |)offence (?:under |is |shall be )(?:liable|punishable)|(?:^|\. )\s*(?:is |shall be )liable (?:on |to )"
PENALTY = r"\bliable (?:on (?:summary )?conviction|to (?:a fine|imprisonment|a penalty))"
#: Tiers in order of priority.
TIERS = ("governed", "government_1", "government_2", "offence", "rule")
SIGNAL = "array<struct<tier:string,kind:string,confidence:double>>"
REJECTED = "array<struct<tier:string,reason:string,actor:string>>"
PENALTY_PROVISION, LEGAL_FICTION = "penalty_provision", "legal_fiction"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _place(text: Column, pattern: str) -> Column:
    """Where the first match starts, from 1; null without one."""
    at = F.regexp_instr(text, F.lit("(?iU)" + pattern))
    return F.when(at > 0, at)


def enabling_first(text: str | Column) -> Column:
    """Whether the first modal allows and does not oblige."""
    may, must = _place(_c(text), ENABLING), _place(_c(text), OBLIGATION)
    return may.isNotNull() & (must.isNull() | (may < must))


def names_government(text: str | Column) -> Column:
    """Whether a text has any word of governments, as part of longer words, too."""
    return F.size(screens.present(_c(text), {w: i for i, w in enumerate(GOVERNMENT_WORDS)})) > 0


def government(text: str | Column, actor: str | Column) -> Column:
    """Signals of both tiers; a kind becomes Enabling where the first modal allows. A governmental actor with a modal is a blunt signal of its own."""
    text, actor = _c(text), _c(actor)
    return let(F.coalesce(enabling_first(text), F.lit(False)), lambda free: _of_governments(text, actor, free))


def _of_governments(text: Column, actor: Column, free: Column) -> Column:
    one = lambda tier, kind, confidence, when: F.when(when, F.struct(F.lit(tier).alias("tier"), F.when(free, "Enabling").otherwise(F.lit(kind)).alias("kind"), F.lit(confidence).alias("confidence")))
    out = [one(tier, kind, c, found(text, p) & (actor if needs else F.lit(True))) for tier, table in (("government_1", FIRST), ("government_2", SECOND)) for kind, c, needs, p in table]
    out.append(one("government_1", "Prescriptive", BLUNT_OBLIGATION, actor & found(text, OBLIGATION) & ~free))
    out.append(one("government_1", "Enabling", BLUNT_ENABLING, actor & free))
    return F.filter(F.array(*out).cast(SIGNAL), lambda s: s.isNotNull())


def offences(text: str | Column) -> Column:
    """Prohibitions told as offences; none in a text that opens with a penalty, nor after a penalty phrase."""
    return offences_and_rejections(text)["signals"]


def offences_and_rejections(text: str | Column) -> Column:
    """struct<signals, rejected>: prohibitions told as offences, and what a penalty made of them: one rejection for a text that opens with one, else one for each place after one."""
    text = _c(text)
    penalty = _place(text, PENALTY)
    out, no = [], []
    reject = F.struct(F.lit("offence").alias("tier"), F.lit(PENALTY_PROVISION).alias("reason"), F.lit(None).cast("string").alias("actor"))
    for confidence, pattern in OFFENCES:
        at = _place(text, pattern)
        after = F.coalesce(penalty < at, F.lit(False))
        out.append(F.when(at.isNotNull() & ~after, F.struct(F.lit("offence").alias("tier"), F.lit("Prohibitive").alias("kind"), F.lit(confidence).alias("confidence"))))
        no.append(F.when(after, reject))
    there = lambda each, kind: F.filter(F.array(*each).cast(kind), lambda s: s.isNotNull())
    opens = found(text, PENALTY_FIRST)
    signals = F.when(opens, F.array().cast(SIGNAL)).otherwise(there(out, SIGNAL))
    return F.struct(signals.alias("signals"), F.when(opens, F.array(reject)).otherwise(there(no, REJECTED)).alias("rejected"))


def decide(text: str | Column, signals: str | Column, gated: str | Column, rejected: str | Column | None = None) -> Column:
    """struct<reason, tier, kind, confidence, duty_type, n_candidates, rejected>: gates first, then the highest tier's surest signal, the last of equals.

    Nothing is left of a provision that its purpose or an introductory phrase gates. Legal fiction turns all its signals into
    rejections, after those that came with them.
    """
    text, signals, gated = _c(text), F.coalesce(_c(signals), F.array().cast(SIGNAL)), _c(gated)
    rejected = F.array().cast(REJECTED) if rejected is None else F.coalesce(_c(rejected), F.array().cast(REJECTED))
    rank = lambda s: -F.array_position(F.lit(list(TIERS)), s["tier"])
    keyed = F.transform(signals, lambda s, i: F.struct(rank(s).alias("r"), s["confidence"].alias("c"), i.alias("i"), s.alias("s")))
    reason = F.when(gated, "purpose_gated").when(descriptive_summary(text), "descriptive_summary").when(legal_fiction(text), LEGAL_FICTION).when(F.size(signals) == 0, "no_signals").otherwise("tier_priority")
    return let(F.struct(reason.alias("reason"), F.array_max(keyed)["s"].alias("best")), lambda d: _told(d["reason"], d["best"], signals, rejected))


def _told(reason: Column, best: Column, signals: Column, rejected: Column) -> Column:
    won = lambda x: F.when(reason == "tier_priority", x)
    kind = best["kind"]
    fiction = F.transform(signals, lambda s: F.struct(s["tier"].alias("tier"), F.lit(LEGAL_FICTION).alias("reason"), F.lit(None).cast("string").alias("actor")))
    kept = F.when(reason.isin("purpose_gated", "descriptive_summary"), F.array().cast(REJECTED)).when(reason == LEGAL_FICTION, F.concat(rejected, fiction.cast(REJECTED))).otherwise(rejected)
    n = F.when(reason == "tier_priority", F.size(signals)).otherwise(0)
    return F.struct(reason.alias("reason"), won(best["tier"]).alias("tier"), won(kind).alias("kind"), won(best["confidence"]).alias("confidence"), won(F.when(kind == "Enabling", "Liberty").otherwise("Obligation")).alias("duty_type"), n.alias("n_candidates"), kept.alias("rejected"))
