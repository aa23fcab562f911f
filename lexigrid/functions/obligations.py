"""Obligations, roles, competence and terms of policy text; parts depend on each other's place, so they run in Arrow batches."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions import screens
from lexigrid.functions.actors import DICTIONARY, compiled, extract
from lexigrid.functions.taxa import MODALS

# List markers, words of competence, and phrases that assign a role: accountable, consulted, informed.
MARK = r"(?:([a-z])\.\s|\(([a-z0-9]+)\)\s)"
MARKER = rf"(?:^|\.\s+){MARK}"
COMPETENCE = r"(?i)(?:competent\s+person|competence|competent|qualified|trained|training\s+course|certification|certified)"
ROLES = (
    ("A", False, r"(?:is\s+accountable\s+for|accountable\s+for|has\s+overall\s+responsibility)"),
    ("C", False, r"(?:in\s+consultation\s+with|consult(?:ed)?\s+with|seek(?:ing)?\s+advice\s+from)"),
    ("I", True, r"(?:shall\s+be\s+(?:informed|notified|advised)|must\s+be\s+(?:informed|notified)|report(?:ed|ing)?\s+to)"),
)
ACRONYM = r"\(([A-Z][A-Z0-9a-z-]{1,15})\)"
DEFINED = r"""['"]([^'"]{3,60})['"][\s]+(?:means|is defined as|refers to)"""
NOT_TERMS = ("Chapter ", "Vol ", "Volume")

OBLIGATION = "array<struct<index:int,text:string,modal:string,strength:string,roles:array<struct<label:string,role:string,source:string>>,competence:array<string>>>"
TERM = "array<struct<term:string,acronym:string,normalised:string,offset:int>>"


def segments(text: str) -> list[str]:
    """The list items of a provision and what stands before them; the whole where there are fewer than two markers."""
    # MARKER in two parts, for a pattern that may stand at the start has no letter to look for.
    first = regex.match(MARK, text)
    starts = [0] * bool(first) + [m.start() for m in regex.finditer(rf"\.\s+{MARK}", text, pos=first.end() if first else 0)]
    if len(starts) < 2:
        return [text]
    cuts = [0, *starts, len(text)] if starts[0] else [*starts, len(text)]
    return [s for a, b in zip(cuts, cuts[1:], strict=False) if (s := text[a:b].strip())]


def modal(text: str) -> tuple[str | None, str | None]:
    low = text.lower()
    there = lambda p, name: ("not" not in name or "not" in low) and screens.holds(p, low)
    return next(((name, strength) for pattern, name, strength, _ in MODALS if there(pattern, name) and regex.search(pattern, low)), (None, None))


def roles(text: str, strength: str | None, words) -> list[dict]:
    """The first phrase that assigns a role decides for all governed actors; else they are responsible under a modal, and government is informed."""
    found = extract(text, None, words)
    governed, government = ([a["label"] for a in found[k]] for k in ("governed", "government"))
    low = text.lower()
    for role, both, pattern in ROLES:
        if screens.holds(pattern, low) and regex.search(pattern, low):
            return [{"label": x, "role": role, "source": "narrative"} for x in governed + government * both]
    out = [{"label": x, "role": "R", "source": "narrative"} for x in governed if strength in ("Mandatory", "Recommended")]
    return out + [{"label": x, "role": "I", "source": "inferred"} for x in government]


def of_text(text: str | None, words) -> list[dict]:
    """Segments with a modal or a role."""
    out = []
    able = screens.holds(COMPETENCE, screens.folded(text or ""))
    for i, s in enumerate(segments(text or "")):
        name, strength = modal(s)
        own = roles(s, strength, words)
        if name or own:
            out.append({"index": i, "text": s, "modal": name, "strength": strength, "roles": own, "competence": [m[0] for m in regex.finditer(COMPETENCE, s)] if able else []})
    return out


def obligations(text: str | Column, dictionary=DICTIONARY) -> Column:
    made: list = []  # in the task

    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(compiled(dictionary))
        return pd.Series([of_text(t, made[0]) for t in texts])

    return F.pandas_udf(run, OBLIGATION)(text)


def terms_of(text: str | None) -> list[dict]:
    """Acronyms in brackets with the capitalised words before them, and defined words; each once, in order of place."""
    text, out, seen, last = text or "", [], set(), 0
    for m in regex.finditer(ACRONYM, text):
        # What stands before the last bracket is of no account.
        region = regex.split(r"[.);:]", text[last : m.start()].rstrip())[-1].split()
        last = m.end()
        near = region[-(len(m[1]) + 3) :] if region else []
        first = next((i for i, w in enumerate(near) if "A" <= w[0] <= "Z"), None)
        term = " ".join(near[first:]) if first is not None else ""
        if len(term) < 5 or any(x in term for x in NOT_TERMS) or term.startswith("UN ") or m[1].lower() in seen:
            continue
        seen.add(m[1].lower())
        out.append({"term": term, "acronym": m[1], "normalised": m[1].lower(), "offset": len(text[: m.start()].encode())})
    for m in regex.finditer(DEFINED, text):
        term = m[1].strip()
        if term.lower() not in seen:
            seen.add(term.lower())
            out.append({"term": term, "acronym": None, "normalised": term.lower(), "offset": len(text[: m.start()].encode())})
    return sorted(out, key=lambda t: t["offset"])


def terms(text: str | Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([terms_of(t) for t in texts])

    return F.pandas_udf(run, TERM)(text)
