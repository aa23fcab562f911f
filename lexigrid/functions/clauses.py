"""Clauses of duty: a readable clause around a modal, and its parts, by native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions.taxa import found

# Modals of a clause, its conditions, and the phrases that qualify it, longer before shorter.
MODAL = r"\b(?:shall\s+not|must\s+not|may\s+not|shall|must|may|(?:is|are)\s+required\s+to|has\s+a\s+duty\s+to)\b"
REVERSED = r"\bit\s+shall\s+be\s+the\s+duty\s+of\s+(.+?)\s+to\s+(.+)"
CONDITION = r"^(?:Where|When|If|Subject to)\b"
NAMES = (
    ("shall not", "ShallNot"),
    ("must not", "MustNot"),
    ("may not", "MayNot"),
    ("shall", "Shall"),
    ("must", "Must"),
    ("may", "May"),
    ("is required to", "IsRequiredTo"),
    ("are required to", "IsRequiredTo"),
    ("has a duty to", "HasDutyTo"),
)
QUALIFIERS = (
    (r"so far as is reasonably practicable", "Sfairp"),
    (r"so far as is practicable", "Sfaip"),
    (r"suitable and sufficient", "SuitableAndSufficient"),
    (r"adequate and appropriate", "AdequateAndAppropriate"),
    (r"as soon as (?:is )?reasonably practicable", "AsSoonAsReasonablyPracticable"),
    (r"as soon as (?:is )?practicable", "AsSoonAsPracticable"),
    (r"\bimmediately\b", "Immediately"),
    (r"without (?:undue |unreasonable )?delay", "WithoutDelay"),
    (r"\bwhere necessary\b", "WhereNecessary"),
    (r"\bwhere appropriate\b", "WhereAppropriate"),
    (r"\bin writing\b", "InWriting"),
    (r"(?:in )?so far as(?: is necessary)?", "InSoFarAs"),
)
LAST_MODAL = r"(?is)^(.*)\b(shall|must|may(?:\s+(?:not|only))?)\b(.*)$"
#: An action up to a full stop, an empty line, or a semicolon that no lettered item follows.
SENTENCE = r"(?s)^(.(?:[^.;\n]|\n(?!\n)|;(?=\s*\()|;(?=\s*(?:and|or)\s+\())*(?:[.;]|\n(?=\n)))"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def refine(clause: str | Column) -> Column:
    """Subject, last modal and action: from the last sentence's start to the end of its sentence; as it is without a modal."""
    raw = _c(clause)
    before, modal, after = (F.regexp_extract(raw, LAST_MODAL, k) for k in (1, 2, 3))
    started = F.regexp_extract(before, r"(?s)^.*[.;]\s+([A-Z].*)$", 1)
    left = F.ltrim(before)
    subject = F.when(started != "", started).when(left.rlike(r"^[A-Z]"), left).otherwise(F.regexp_replace(left, r"^[,;:\s]+", ""))
    ended = F.regexp_extract(after, SENTENCE, 1)
    whole = F.rtrim(after)
    short = F.when(whole.rlike(r"\s"), F.rtrim(F.regexp_extract(whole, r"(?s)^(.*)\s", 1))).otherwise(whole)
    action = F.when(F.trim(after) == "", "").when(ended != "", ended).otherwise(short)
    parts = F.filter(F.array(F.trim(subject), F.trim(modal), F.trim(action)), lambda p: p != "")
    return F.when(modal == "", F.trim(raw)).otherwise(F.regexp_replace(F.array_join(parts, " "), " {2,}", " "))


def decompose(clause: str | Column) -> Column:
    """struct<applicability, modal, qualifiers, action>, or null without a modal or an action.

    "It shall be the duty of A to B" has the modal HasDutyTo and the action B.
    """
    text = F.trim(_c(clause))
    tidy = lambda a: F.rtrim(F.regexp_replace(a, r"^[,;\s]+", ""))
    reversed_ = tidy(F.regexp_extract(text, "(?i)" + REVERSED, 2))
    word = F.regexp_extract(text, "(?i)" + MODAL, 0)
    at = F.regexp_instr(text, F.lit("(?i)" + MODAL))
    name = F.regexp_replace(F.lower(word), r"\s+", " ")
    modal = F.coalesce(*(F.when(name == n, label) for n, label in NAMES))
    action = tidy(F.substring(text, at + F.length(word), F.length(text)))
    before = F.substring(text, F.lit(1), at - 1)
    condition = F.trim(F.regexp_extract(before, r"(?s)^(.*),", 1))
    applies = F.when(found(text, CONDITION) & (condition != ""), condition)
    marks = F.filter(F.array(*(F.when(found(text, p), q) for p, q in QUALIFIERS)), lambda q: q.isNotNull())
    kind = "struct<applicability:string,modal:string,qualifiers:array<string>,action:string>"
    pack = lambda a, m, x: F.struct(a.alias("applicability"), m.alias("modal"), marks.alias("qualifiers"), x.alias("action")).cast(kind)
    return F.when(reversed_ != "", pack(F.lit(None).cast("string"), F.lit("HasDutyTo"), reversed_)).when((word != "") & (action != ""), pack(applies, modal, action))
