"""Classification of provision text by native expressions: purposes, scope, gates, categories and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions import screens
from lexigrid.functions.patterns import CATEGORIES, PURPOSES

ENACTMENT, INTERPRETATION, APPLICATION, EXTENT, EXEMPTION, PROCESS = (x for x, _ in PURPOSES[:6])
OFFENCE, REPEAL, AMENDMENT, TRANSITIONAL, UNCLASSIFIED = "Offence", "Repeal+Revocation", "Amendment", "Transitional Arrangement", "Unclassified"
# Section types, modal phrases and patterns that decide about a provision.
STRUCTURAL = (ENACTMENT, INTERPRETATION, AMENDMENT, REPEAL, EXTENT, TRANSITIONAL)
OUT_TYPES = ("heading", "part", "chapter", "signed", "title", "table", "commencement", "note", "schedule")
DUTY_MODALS = (" shall ", " must ", " ensure ", " required to ", " responsible for ")
OTHER_MODALS = (" entitled to ", " has the right ", " have the right ", " may ", " has the power ", " have the power ")
TITLES = (
    ("(Amendment", AMENDMENT),
    ("(Revocation)", REPEAL),
    ("(Repeal)", REPEAL),
    ("(Commencement", ENACTMENT),
    ("(Application)", APPLICATION),
    ("(Transitional", TRANSITIONAL),
    ("(Extent)", EXTENT),
    ("(Extension", EXTENT),
)
OBLIGATION = r"\bshall\b|\bmust\b|\bis required to\b|\bhas a duty\b"
PROHIBITION = r"\bshall not\b|\bmust not\b|\bno person shall\b|\bprohibit"
ENABLING = r"\bmay\b|\bpower to\b|\bauthori[sz]e|\benable|\bentitled\b"
FICTION = r"\bshall\b\s+(?:be\s+(?:treated|deemed|construed|read|applied)|have\s+(?:the\s+)?effect|not\s+(?:affect|authorise|prejudice|apply\b|prevent|be\s+taken))|(?:^|[.;]\s*)Nothing\s+in\b"
IMMUNITY = r"Nothing\s+in\b.{0,60}\bshall\b.{0,30}\b(?:compel|require|oblige)|\bshall\s+not\s+affect\b.{0,40}\b(?:entitlement|right|privilege)|Nothing\s+in\b.{0,60}\b(?:taken|construed)\s+to\s+(?:compel|require)"
SUMMARY = r"^(?:the(?:se)?|this) (?:regulations?|act|order|rules?)\s+(?:impose|require|provide|give effect|implement|extend|place|create|establish|set out|supplement|make provision)"
HEAT_MODAL = r"\b(?:shall|must|is required to|has a duty)\b"
HEAT_ENABLING = r"\b(?:may|power to|entitled to|authorise|authorize)\b"
RELEVANT_TYPES = ("Obligation", "Liberty", "Rule", "Discretionary", "Process, Rule, Constraint, Condition")
# Modals of policy documents in order of priority: pattern, name, strength, type.
MODALS = (
    (r"(?:shall\s+not|must\s+not|may\s+not|will\s+not)\b", "shall not", "Mandatory", "Obligation"),
    (r"\bshall\b", "shall", "Mandatory", "Obligation"),
    (r"\bmust\b", "must", "Mandatory", "Obligation"),
    (r"\bwill\b", "will", "Mandatory", "Obligation"),
    (r"\b(?:is|are)\s+to\b", "is to", "Mandatory", "Obligation"),
    (r"\b(?:is|are)\s+(?:required|responsible)\b", "is required to", "Mandatory", "Obligation"),
    (r"\bshould\b", "should", "Recommended", "Recommendation"),
    (r"\bmay\b", "may", "Permissive", "Permission"),
)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found(text: str | Column, pattern: str) -> Column:
    """A match that ignores case, by Unicode's rules for letters and white space; texts without what it needs are not searched."""
    return screens.found(_c(text), pattern)


def _labels(text: Column, pairs) -> Column:
    marked = lambda hits: F.filter(F.array(*(F.when(hit, label) for hit, (label, _) in zip(hits, pairs, strict=True))), lambda x: x.isNotNull())
    return screens.each_found(text, [p for _, p in pairs], marked)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def purposes(text: str | Column) -> Column:
    """All purposes in order of priority; Unclassified if there is none, nothing for an empty text."""
    text = _c(text)
    labels = let(_labels(text, PURPOSES), lambda x: F.when(F.size(x) == 0, F.array(F.lit(UNCLASSIFIED))).otherwise(x))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(labels)


def title_purpose(title: str | Column) -> Column:
    """The purpose that a law's title names, or null."""
    title = _c(title)
    return F.coalesce(*(F.when(title.contains(t), p) for t, p in TITLES))


def categories(text: str | Column, types: str | Column | None = None) -> Column:
    """Management-system categories in order; with duty types of a relevant kind, Risk Control where there is none."""
    text = _c(text)
    labels = F.when(text == "", F.array().cast("array<string>")).otherwise(_labels(text, CATEGORIES))
    if types is None:
        return labels
    relevant = F.coalesce(F.arrays_overlap(_c(types), F.lit(list(RELEVANT_TYPES))), F.lit(False))
    return let(labels, lambda x: F.when((F.size(x) == 0) & relevant, F.array(F.lit("Risk Control"))).otherwise(x))


def _any(low: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def _only(array: Column, allowed) -> Column:
    return F.forall(array, lambda p: p.isin(*allowed))


def scope(section_type: str | Column, text: str | Column, purposes_: str | Column) -> Column:
    """out, structural or substantive; lengths are in bytes, and a modal makes a structural provision substantive."""
    kind, text, own = _c(section_type), _c(text), _c(purposes_)
    modal = _any(F.lower(text), DUTY_MODALS + OTHER_MODALS)
    return (
        F.when(F.coalesce(F.lower(kind).isin(*OUT_TYPES), F.lit(False)) | (F.octet_length(text) < 20), "out")
        .when(F.size(own) == 0, "substantive")
        .when(_only(own, STRUCTURAL) & ~modal, "structural")
        .otherwise("substantive")
    )


def skip_types(purposes_: str | Column, government: str | Column) -> Column:
    """Whether a provision is too structural to be searched for duties; a governmental actor opens most gates."""
    own, government = _c(purposes_), _c(government)
    has = lambda p: F.array_contains(own, p)
    first = F.get(own, F.lit(0))
    gated = has(REPEAL) | has(OFFENCE) | _only(own, (ENACTMENT, INTERPRETATION, AMENDMENT, REPEAL)) | first.isin(INTERPRETATION, ENACTMENT, UNCLASSIFIED, APPLICATION)
    return F.when(F.size(own) == 0, False).when(has(AMENDMENT), True).when(gated, ~government).otherwise(False)


def only_mentioned(purposes_: str | Column, text: str | Column) -> Column:
    """Whether actors are merely mentioned: structural purposes and no modal of duty."""
    return _only(_c(purposes_), STRUCTURAL) & ~_any(F.lower(_c(text)), DUTY_MODALS)


def legal_fiction(text: str | Column) -> Column:
    return found(text, FICTION) & ~found(text, IMMUNITY)


def descriptive_summary(text: str | Column) -> Column:
    return found(text, SUMMARY)


def may_bear_duty(purposes_: str | Column) -> Column:
    return F.exists(_c(purposes_), lambda p: ~p.isin(ENACTMENT, INTERPRETATION, AMENDMENT, REPEAL, APPLICATION, EXTENT))


def clause_confidence(clause: str | Column, captured: str | Column) -> Column:
    """0.25 for a captured action, 0.25 for a full stop or semicolon at the end, 0.20 over 30 bytes, 0.15 for a strong modal."""
    clause, captured = _c(clause), _c(captured)
    part = lambda when, v: F.when(when, v).otherwise(0.0)
    total = part(captured, 0.25) + part(clause.rlike(r"[.;]$"), 0.25) + part(F.octet_length(clause) > 30, 0.20) + part(found(clause, r"\b(?:shall|must)\b"), 0.15)
    return F.when(clause == "", 0.0).otherwise(F.round(total, 2))


def heat(text: str | Column, purposes_: str | Column, governed: str | Column, government: str | Column) -> Column:
    """How likely an unclassified provision is a missed duty."""
    text, own, governed, government = map(_c, (text, purposes_, governed, government))
    p = lambda when, v: F.when(when, v).otherwise(0)
    structural = (F.size(own) > 0) & _only(own, (INTERPRETATION, AMENDMENT, REPEAL, TRANSITIONAL))
    return p(found(text, HEAT_MODAL), 3) + p(governed, 2) + p(found(text, HEAT_ENABLING), 1) + p(government, 1) + p(F.array_contains(own, PROCESS), 1) + p(structural, -2) + p(F.octet_length(text) < 50, -1)


def modal(text: str | Column) -> Column:
    """struct<modal, strength, kind> of the first modal in order of priority; null if there is none."""

    def first(low: Column) -> Column:
        # A pattern runs only where the words that it needs stand; those of negated ones share a word that tells more.
        there = lambda p, m: screens.may_match(p, low.contains) & (low.contains("not") if "not" in m else F.lit(True))
        return F.coalesce(*(F.when(there(p, m) & low.rlike("(?U)" + p), F.struct(F.lit(m).alias("modal"), F.lit(s).alias("strength"), F.lit(k).alias("kind"))) for p, m, s, k in MODALS))

    return let(F.lower(_c(text)), first)


def policy_citation(citation: str | Column) -> Column:
    """``JSP 375 Chapter 8`` as ``JSP-375-CH08``; null for other text."""
    low = F.lower(_c(citation))
    number, chapter = F.regexp_extract(low, r"jsp\s*-?\s*(\d+)", 1), F.regexp_extract(low, r"(?:chapter|ch\.?)\s*(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("JSP-"), number, F.when(chapter != "", F.concat(F.lit("-CH"), F.when(F.length(chapter) < 2, F.lpad(chapter, 2, "0")).otherwise(chapter))).otherwise("")))


def keyword_score(title: str | Column, keywords: str | Column) -> Column:
    """The share of keywords that a title contains; 0 without keywords."""
    title, keywords = F.lower(_c(title)), _c(keywords)
    return F.when(F.size(keywords) == 0, 0.0).otherwise(F.size(F.filter(keywords, lambda k: title.contains(F.lower(k)))) / F.size(keywords))
