"""Where a clause stands in its source, the qualifier nearest to it, and silver labels made of both."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Qualifying phrases.
QUALIFIERS = (
    r"\bso far as is reasonably practicable\b",
    r"\bso far as is practicable\b",
    r"\bwhere reasonably practicable\b",
    r"\bas far as possible\b",
    r"\bto the extent that\b",
    r"\bsubject to\b",
    r"\bprovided that\b",
    r"\bunless\b",
    r"\bexcept where\b",
    r"\bexcept in so far as\b",
)
LABEL = "struct<start:int,end:int,matched:string,ratio:float,qualifier:string,quality:string>"


def longest_shared(a: str, b: str) -> tuple[int, int]:
    """(place in b, length) of the longest string that both hold, the first of several; one row of lengths at a time."""
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    lengths, best = np.zeros(len(codes) + 1, np.int32), (0, 0)
    for c in np.frombuffer(a.encode("utf-32-le"), np.uint32):
        lengths[1:] = np.where(codes == c, lengths[:-1] + 1, 0)
        at = int(lengths.argmax())
        if lengths[at] > best[1]:
            best = (at - int(lengths[at]), int(lengths[at]))
    return best


def clause_span(clause: str | None, source: str | None) -> tuple[int, int, str, float] | None:
    """Start, end, text and share of the clause; none if fewer than ten characters, or a fifth of the clause, are shared (three at least)."""
    if not clause or not source:
        return None
    start, n = longest_shared(clause.lower(), source.lower())
    if n < max(3, min(10, len(clause) // 5)) or not n:
        return None
    return start, start + n, source[start : start + n], n / len(clause)


def nearest_qualifier(source: str, start: int, end: int) -> str | None:
    """The qualifying phrase nearest to a span; the earlier pattern of several as near."""
    found = [(start - m.end() if m.end() <= start else max(0, m.start() - end), i, m.start(), m[0]) for i, p in enumerate(QUALIFIERS) for m in regex.finditer("(?i)" + p, source)]
    return min(found)[3] if found else None


def silver_label(clause: str | Column, source: str | Column) -> Column:
    """Span, qualifier and quality (high from 0.8, medium from 0.5) of each clause in its source; null without a match."""

    def run(clauses: pd.Series, sources: pd.Series) -> pd.DataFrame:
        rows = []
        for c, s in zip(clauses, sources, strict=True):
            got = clause_span(c, s)
            quality = None if got is None else "high" if got[3] >= 0.8 else "medium" if got[3] >= 0.5 else "low"
            rows.append((None,) * 6 if got is None else (*got, nearest_qualifier(s, got[0], got[1]), quality))
        return pd.DataFrame(rows, columns=["start", "end", "matched", "ratio", "qualifier", "quality"]).astype({"start": "Int32", "end": "Int32", "ratio": "Float32"})

    return F.pandas_udf(run, LABEL)(clause, source)
