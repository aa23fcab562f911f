"""Policy documents: mandated artefacts, references, features of modals, polarity of scope, and control lint."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions.screens import each_found
from lexigrid.functions.taxa import found

# Artefacts that text can mandate, special phrases before general ones.
ARTEFACTS = (
    (r"\brisk\s+assessment", "Risk Assessment"),
    (r"\bfire\s+risk\s+assessment", "Risk Assessment"),
    (r"\bDSEAR\s+assessment", "Risk Assessment"),
    (r"\bsafety\s+case", "Safety Case"),
    (r"\bhazard\s+log", "Hazard Log"),
    (r"\bpermit\s+to\s+work", "Permit"),
    (r"\bemergency\s+plan", "Emergency Plan"),
    (r"\bemergency\s+(?:arrangements?|procedures?)", "Emergency Plan"),
    (r"\bmethod\s+statement", "Method Statement"),
    (r"\bsafe\s+system\s+of\s+work", "Method Statement"),
    (r"\btraining\s+(?:course|record|programme|requirement)", "Training Record"),
    (r"\bcompetence\s+(?:record|assessment|certificate)", "Training Record"),
    (r"\binspection\s+(?:record|report|regime|programme)", "Inspection Report"),
    (r"\btest(?:ing)?\s+(?:record|report|regime|certificate)", "Inspection Report"),
    (r"\binspection\s+and\s+test", "Inspection Report"),
    (r"\bperiodic\s+inspection", "Inspection Report"),
    (r"\baudit\s+(?:programme|report|record|trail)", "Audit Report"),
    (r"\bsafety\s+audit", "Audit Report"),
    (r"\bsafety\s+procedure", "Procedure"),
    (r"\breporting\s+procedure", "Procedure"),
    (r"\bwritten\s+procedure", "Procedure"),
    (r"\bsafety\s+management\s+(?:system|plan)", "Procedure"),
    (r"\bmaintenance\s+record", "Maintenance Record"),
    (r"\boccurrence\s+report", "Occurrence Report"),
    (r"\bincident\s+report", "Occurrence Report"),
    (r"\bsafety\s+occurrence", "Occurrence Report"),
)
# How laws, policies, standards and guidance are cited.
REFERENCES = (
    (r"(?:the\s+)?([A-Z][A-Za-z.,()&\s]{3,80}?(?:Act|Order)\s+\d{4})", "legislation"),
    (r"(?:the\s+)?([A-Z][A-Za-z.,()&\s]{3,80}?(?:Regulations?|Rules?)\s+\d{4})", "legislation"),
    (r"JSP\s+(\d{3})\s*(?:,\s*)?(?:Vol(?:ume)?\s*(\d+)\s*(?:,\s*)?)?(?:Ch(?:apter)?\s*(\d+))?", "jsp"),
    (r"BS\s+(?:EN\s+)?(?:ISO\s+)?(\d+)(?::(\d{4}))?", "standard"),
    (r"ECE\s+Regulation\s+(\d+)", "standard"),
    (r"\bHSG\s*(\d+)\b", "guidance"),
    (r"\b(?:HSE\s+)?L(\d+)\b", "guidance"),
    (r"\bINDG\s*(\d+)\b", "guidance"),
)
#: For each way of citing, the words of which a text must hold one, and what a match ends in where that tells more.
_CITED_BY = ((("Act", "Order"), r"(?:Act|Order)\s+\d{4}"), (("Regulation", "Rule"), r"(?:Regulations?|Rules?)\s+\d{4}"), (("JSP",), None), (("BS",), None), (("ECE",), None), (("HSG",), None), (("L",), r"L\d"), (("INDG",), None))
CROSS_REFERENCE = r"\b(?:regulations?|paragraphs?|sub-paragraphs?|sections?|articles?|schedules?|parts?)\s+[\d(]+[\d().a-z]*"
MODAL_FEATURES = (("shall",), ("must",), (" may ",), ("requir",), ("ensur",), ("prohibit",), ("duty", "duties"), ("right",), ("power",), ("responsib",), ("penalt",), ("offence",), ("exempt",))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _offset(text: Column, pattern: str) -> Column:
    """The byte at which the first match starts."""
    return F.octet_length(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(pattern)) - 1))


def artefacts(text: str | Column) -> Column:
    """array<struct<offset, kind, matched>>: each kind once, by its first phrase that occurs, in order of place."""
    text = _c(text)
    patterns = [p for p, _ in ARTEFACTS]

    def listed(hits: list[Column]) -> Column:
        by_kind: dict[str, list[Column]] = {}
        for hit, (pattern, kind) in zip(hits, ARTEFACTS, strict=True):
            p = "(?iU)" + pattern
            one = F.struct(_offset(text, p).alias("offset"), F.lit(kind).alias("kind"), F.regexp_extract(text, p, 0).alias("matched"))
            by_kind.setdefault(kind, []).append(F.when(hit, one))
        return F.array_sort(F.filter(F.array(*(F.coalesce(*each) for each in by_kind.values())), lambda x: x.isNotNull()))

    return each_found(text, patterns, listed)


_CITED = "array<struct<place:int,kind:string,citation:string>>"


def _cited(text: Column, pattern: str, kind: str, words: tuple[str, ...], end: str | None) -> Column:
    """Citations of one pattern with their places, each looked for after the one before; only where one of its words and its end are found."""
    start = F.struct(F.lit(1).alias("after"), F.array().cast(_CITED).alias("found"))

    def step(s: Column, x: Column) -> Column:
        place = F.call_function("locate", x, text, s["after"])
        one = F.struct(place.alias("place"), F.lit(kind).alias("kind"), F.trim(x).alias("citation"))
        return F.struct((place + F.length(x)).alias("after"), F.concat(s["found"], F.array(one)).alias("found"))

    found_ = F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), start, step)["found"]
    kept = F.filter(found_, lambda x: F.octet_length(x["citation"]) >= 10) if kind == "legislation" else found_
    may = reduce(or_, map(text.contains, words))
    return F.when(~(may & text.rlike(end) if end else may), F.array().cast(_CITED)).otherwise(kept)


def references(text: str | Column) -> Column:
    """array<struct<kind, citation>> of all citations in order of place, each once; of two that overlap the longer stays.

    Citations of laws have ten bytes or more.
    """
    text = _c(text)
    every = F.array_sort(F.concat(*(_cited(text, p, k, *by) for (p, k), by in zip(REFERENCES, _CITED_BY, strict=True))))

    def step(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        apart = F.coalesce(x["place"] >= last["place"] + F.length(last["citation"]), F.lit(True))
        longer = F.length(x["citation"]) > F.length(last["citation"])
        return F.when(apart, F.concat(kept, F.array(x))).when(longer, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)

    kept = F.aggregate(every, F.array().cast(_CITED), step)
    return F.array_distinct(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["citation"].alias("citation"))))


def cross_references(text: str | Column) -> Column:
    """References to other provisions in order, each once whatever its case."""
    every = F.regexp_extract_all(_c(text), F.lit("(?i)" + CROSS_REFERENCE), F.lit(0))
    first = lambda x, i: F.array_position(F.transform(every, lambda y: F.lower(y)), F.lower(x)) == i + 1
    return F.filter(every, first)


def modal_features(text: str | Column) -> Column:
    """Thirteen indicators of modal and legal words."""
    low = F.lower(_c(text))

    def any_of(words: tuple[str, ...]) -> Column:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        return F.when(hit, 1.0).otherwise(0.0)

    return F.array(*(any_of(w) for w in MODAL_FEATURES))


def softmax_class(features: str | Column, weights: list[list[float]], bias: list[float], labels: list[str]) -> Column:
    """struct<label, confidence> of a linear classifier; the weights are a model's few rows, one for each class."""
    x = _c(features)
    scores = F.array(*(F.aggregate(F.zip_with(x, F.lit(w), lambda a, b: a.cast("double") * b), F.lit(float(b)), lambda s, v: s + v) for w, b in zip(weights, bias, strict=True)))
    top = F.array_max(scores)
    share = 1 / F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.struct(F.element_at(F.lit(labels), F.array_position(scores, top).cast("int")).alias("label"), share.alias("confidence"))


DEONTIC = ("shall", "must", "should", "required to")
PAPERWORK = ("document exists", "record is maintained", "form is completed", "certificate is on file", "log is kept")
CONTROL = "title string, description string, what_it_checks string, evidence_hint string, linked_provisions array<string>, control_type string, nature string"


def control_flags(json: str | Column, provisions: str | Column, enums: dict[str, tuple[str, ...]]) -> Column:
    """Flags of a generated control: words of duty in its title, paperwork for a description, links and kinds that do not exist, empty fields."""
    c = F.from_json(_c(json), CONTROL)
    text = lambda f: F.coalesce(F.lower(c[f]), F.lit(""))
    out = [F.when(text("title").contains(w), f"DEONTIC: {w}") for w in DEONTIC]
    out += [F.when(text("description").contains(p), f"PAPERWORK: {p}") for p in PAPERWORK]
    links = F.coalesce(c["linked_provisions"], F.array().cast("array<string>"))
    out.append(F.when(F.size(links) == 0, "NO_PROVISIONS"))
    out += [F.when(~F.coalesce(c[f].isin(*values), F.lit(False)), f"INVALID_ENUM: {f}") for f, values in enums.items()]
    out += [F.when(text(f) == "", f"MISSING_FIELD: {f}") for f in ("title", "description", "what_it_checks", "evidence_hint")]
    bad = F.transform(F.array_except(links, _c(provisions)), lambda x: F.concat(F.lit("INVALID_REF: "), x))
    return F.concat(F.filter(F.array(*out), lambda x: x.isNotNull()), bad)


def self_reference(text: str | Column) -> Column:
    """Whether a law speaks of itself or of a numbered provision."""
    nouns = r"(?:this|these|the|that|such)\s+(?:Act|Part|section|subsection|regulation|paragraph|sub-paragraph|article|Schedule|Order|Rules?|Directive|provisions?|Chapter|enactment|requirement|prohibition|duty|restriction)"
    numbers = r"(?:regulations?|sections?|subsections?|paragraphs?|sub-paragraphs?|articles?|parts?)\s+[\d(]"
    return found(text, nouns) | found(text, numbers) | found(text, r"\bnothing\s+in\s+(?:this|these|the)\s+")
