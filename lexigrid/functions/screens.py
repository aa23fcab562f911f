"""Fast tests for patterns of whole texts: what a pattern cannot do without is looked for first, and gaps are crossed once.

A pattern's alternatives are told apart. For each, the literals that every match must hold are read off the pattern, and whether
its regular expression runs at all is decided by a search for them: a native one where there are few patterns, and for tables of
patterns one walk of an automaton over the text (Aho-Corasick, in Arrow batches), whose cost does not grow with the table. Where an alternative has gaps (``A.*?B``), a match exists on a
line if and only if B stands after the A that ends first; so each part is taken at its first place and never given up, which
makes the search linear in the line, however often A occurs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce
from operator import and_, or_
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ignoring case by Unicode's rules, these letters are like s, i, i and k, though ``lower`` leaves them or makes two of them.
_LIKE = {"ſ": "s", "ı": "i", "İ": "i", "K": "k"}
_QUANTIFIER = re.compile(r"(?:[*+?]|\{(\d+)(?:,\d*)?\})[?+]?")
_GAP = re.compile(r"\.\*\??")
#: What may follow a part of a gap without a letter of it being needed: the gap takes it.
_TAIL = re.compile(r"(?:(?<![\\\])])[A-Za-z]|\(\?:[^()|]*\))\?(?=[|)]|$)")


class Branch(NamedTuple):
    """One alternative: of each tuple of literals one must be there, in lower case, for the pattern to match."""

    needs: tuple[tuple[str, ...], ...]
    pattern: str


def fold(text: Column) -> Column:
    """The text in lower case, with all letters that ignoring case makes equal to an ASCII one written as that."""
    odd = reduce(or_, (text.contains(c) for c in _LIKE))
    plain = F.when(odd, F.translate(text, "".join(_LIKE), "".join(_LIKE.values()))).otherwise(text)
    return F.lower(plain)


def literals(patterns: Iterable[str]) -> dict[str, int]:
    """A number for each literal that alternatives of the patterns need."""
    every = dict.fromkeys(w for p in patterns for b in branches(p) for n in b.needs for w in n)
    return {w: i for i, w in enumerate(every)}


def present(text: Column, numbers: dict[str, int]) -> Column:
    """The numbers of the literals that the text holds, ignoring case; none for a null text."""

    made: list = []  # in the task

    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(ahocorasick.Automaton())
            for w, i in numbers.items():
                made[0].add_word(w, i)
            made[0].make_automaton()
        return pd.Series([sorted({i for _, i in made[0].iter(folded(t))}) if t else [] for t in texts])

    return F.pandas_udf(run, "array<int>")(text)


def folded(text: str) -> str:
    """``fold`` of one text."""
    if not text.isascii():
        for c, like in _LIKE.items():
            text = text.replace(c, like)
    return text.lower()


def _group_end(p: str, i: int) -> int:
    """The place after the group or class that opens at ``i``."""
    if p[i] == "[":
        j = i + 2 if p[i + 1] == "^" else i + 1
        j += p[j] == "]"
        while p[j] != "]":
            j += 2 if p[j] == "\\" else 1
        return j + 1
    depth, j = 0, i
    while True:
        if p[j] == "\\":
            j += 1
        elif p[j] == "[":
            j = _group_end(p, j) - 1
        elif p[j] in "()":
            depth += 1 if p[j] == "(" else -1
            if not depth:
                return j + 1
        j += 1


def _pieces(p: str) -> list[str]:
    """A pattern's elements: characters, escapes, classes, groups and quantifiers."""
    out, i = [], 0
    while i < len(p):
        m = _QUANTIFIER.match(p, i)
        j = i + 2 if p[i] == "\\" else _group_end(p, i) if p[i] in "([" else m.end() if m else i + 1
        if p[i : i + 3] in (r"\x{", r"\p{", r"\P{"):
            j = p.index("}", i) + 1
        out.append(p[i:j])
        i = j
    return out


def alternatives(p: str) -> list[str]:
    """The pattern's alternatives, also inside one group around the whole."""
    out = [""]
    for x in _pieces(p):
        if x == "|":
            out.append("")
        else:
            out[-1] += x
    if len(out) == 1 and p.startswith("(?:") and _group_end(p, 0) == len(p):
        return alternatives(p[3:-1])
    return out


def _letters(element: str) -> str | None:
    """The one character that an element matches but for case; else none."""
    if len(element) == 1 and element not in ".^$|":
        return element.lower()
    if len(element) == 2 and element[0] == "\\" and not element[1].isalnum():
        return element[1]
    if re.fullmatch(r"\[\w\w\]", element) and element[1].lower() == element[2].lower():
        return element[1].lower()
    return None


def _few(element: str) -> tuple[str, ...]:
    """The characters of a class of a few marks; none for other elements."""
    inside = element[1:-1] if element.startswith("[") else ""
    return tuple(dict.fromkeys(inside)) if inside and len(inside) <= 4 and not re.search(r"[\w\\^\s-]", inside) else ()


@lru_cache(maxsize=4096)
def needs(p: str) -> tuple[tuple[str, ...], ...]:
    """For one alternative, the tuples of literals of each of which a match holds one, the least common (longest) first."""
    found, run, pieces = [], "", _pieces(p)
    for x, after in zip(pieces, [*pieces[1:], ""], strict=False):
        if _QUANTIFIER.fullmatch(x):
            continue
        m = _QUANTIFIER.fullmatch(after)
        optional = bool(m) and (after[0] in "*?" or m[1] == "0")
        c = _letters(x)
        if c is not None and not optional:
            run += c
        if x != r"\b" and (c is None or m):  # the run of letters ends here
            found.append((run,))
            run = ""
        if not optional and (few := _few(x)):
            found.append(few)
        if x.startswith("(?:") and not optional:
            own = [max((n for n in needs(a) if n), key=_worth, default=None) for a in alternatives(x[3:-1])]
            if all(own):
                found.append(tuple(dict.fromkeys(w for n in own for w in n)))
    found.append((run,))
    kept = [n for n in dict.fromkeys(found) if n and all(w.strip() for w in n)]
    telling = [n for n in kept if _worth(n)[0] > 3 or not all(map(str.isalpha, n))]  # short words stand in every text
    return tuple(sorted(telling or kept, key=_worth, reverse=True))


def _worth(n: tuple[str, ...]) -> tuple[int, int]:
    return min(map(len, n)), -len(n)


def linear(p: str) -> str:
    """An alternative with gaps, written so that each part is taken at its first place; others stay as they are."""
    pieces, parts = _pieces(p), [""]
    i = 0
    while i < len(pieces):
        if pieces[i] == "." and i + 1 < len(pieces) and pieces[i + 1] in ("*", "*?"):
            parts.append("")
            i += 2
        else:
            parts[-1] += pieces[i]
            i += 1
    if len(parts) == 1 or not all(parts) or "^" in parts[0] or "$" in p or re.search(r"\\s|\\W|\[\^|\(\?s", "".join(parts[:-1])):
        return p
    first = [_shortest(x) for x in parts[:-1]]
    return "(?m)^" + "".join(f"(?>.*?(?:{x}))" for x in first) + f".*(?:{parts[-1]})"


def _shortest(part: str) -> str:
    """The part less optional ends, which the gap after it takes."""
    while (cut := _TAIL.sub("", part)) != part:
        part = cut
    return part


@lru_cache(maxsize=1024)
def branches(pattern: str) -> tuple[Branch, ...]:
    """The pattern's alternatives; those of which no literal is needed, and those that are their literal, come as they are."""
    return tuple(Branch(needs(a), linear(a)) for a in alternatives(pattern))


def may_match(pattern: str, has: Callable[[str], Column]) -> Column:
    """``holds`` as an expression; ``has`` tells of a literal whether the folded text holds it."""
    return reduce(or_, (reduce(and_, (reduce(or_, map(has, n)) for n in b.needs), F.lit(True)) for b in branches(pattern)))


def holds(pattern: str, low: str) -> bool:
    """Whether a folded text has the literals that one of the pattern's alternatives needs; the pattern may still not match."""
    return any(all(any(w in low for w in n) for n in b.needs) for b in branches(pattern.removeprefix("(?i)")))


def own_words(pattern: str) -> tuple[str, ...]:
    """The longest text of each alternative that its matches hold in its own case; nothing if an alternative has none of two letters."""
    if "(?i" in pattern:
        return ()
    out = []
    for a in alternatives(pattern):
        runs, pieces = [""], _pieces(a)
        for x, after in zip(pieces, [*pieces[1:], ""], strict=True):
            plain = x if len(x) == 1 and x not in ".^$|" else x[1:] if len(x) == 2 and x[0] == "\\" and not x[1].isalnum() else None
            if plain is None or _QUANTIFIER.fullmatch(x) or _QUANTIFIER.fullmatch(after):
                runs += [""] if x != r"\b" else []
            else:
                runs[-1] += plain
        out.append(max(runs, key=len))
    return tuple(dict.fromkeys(out)) if min(map(len, out)) > 1 else ()


def literal(pattern: str) -> str | None:
    """The text that a pattern of letters, spaces and word boundaries stands for, in its own case; none for other patterns."""
    plain = pattern.replace(r"\b", "")
    return plain if re.fullmatch(r"[A-Za-z0-9 ]+", plain) else None


def _is_literal(b: Branch) -> bool:
    """Whether the alternative is a literal, so that it needs no regular expression."""
    return b.needs == (("".join(_letters(x) or "\0" for x in _pieces(b.pattern)),),)


def found(text: Column, pattern: str, has: Callable[[str], Column] | None = None) -> Column:
    """Whether the pattern matches, ignoring case by Unicode's rules; ``has`` tells of a literal whether the folded text holds it."""
    if has is None:  # the text and its folded form are bound, so that neither is made for each literal
        bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
        return bind(text, lambda t: bind(fold(t), lambda low: found(t, pattern, low.contains)))

    def test(b: Branch) -> Column:
        there = [reduce(or_, map(has, n)) for n in b.needs]
        return reduce(and_, there if _is_literal(b) else [*there, text.rlike("(?iU)" + b.pattern)])

    return reduce(or_, map(test, branches(pattern)))


def each_found(text: Column, patterns: list[str], use: Callable[[list[Column]], Column]) -> Column:
    """``use`` of whether each pattern of a table matches, with one walk over the text for all literals."""
    numbers = literals(patterns)
    own = F.transform(F.array(present(text, numbers)), lambda p: use([found(text, x, lambda w: F.array_contains(p, F.lit(numbers[w]))) for x in patterns]))
    return F.get(own, F.lit(0))


def each_found_in_parts(parts: Column, patterns: list[str], use: Callable[[Column, list[Column]], Column]) -> Column:
    """For each text of an array, ``use`` of it and of whether each pattern matches it, by native searches for literals."""
    bound = F.transform(parts, lambda t: F.struct(t.alias("text"), fold(t).alias("low")))
    return F.transform(bound, lambda t: use(t["text"], [found(t["text"], x, t["low"].contains) for x in patterns]))
