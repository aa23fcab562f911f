"""Actors named in a provision: an ordered dictionary in which each pattern takes its words out of the text before the next."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions import screens
from lexigrid.functions.dictionary import LAWS, POLICIES
from lexigrid.functions.taxa import let

# Phrases that name no actor.
BLACKLIST = (
    r"local authority collected municipal waste",
    r"[Pp]ublic (?:nature|sewer|importance|functions?|interest|[Ss]ervices)",
    r"[Rr]epresentatives? of",
    r"(?i)agency workers?",
    r"(?i)temporary work agency",
)
DICTIONARY = LAWS
#: White space or punctuation, which parts a word from the next; characters on each side of a gap, more than any literal has.
EDGE, NEARBY = r"[\s!-/:-@\[-`{-~]", 200
KIND = "struct<governed:array<struct<label:string,keyword:string,offset:int>>,government:array<struct<label:string,keyword:string,offset:int>>>"


class Words(NamedTuple):
    """A pattern of a label, the literals (by number) of each set of which a text must hold one for it to match, and the same in their own case.

    Matches of a ``bounded`` pattern are no longer than ``NEARBY``, so none starts further before a literal.
    """

    label: str
    pattern: regex.Pattern
    needs: tuple[frozenset[int], ...]
    own: tuple[str, ...]
    bounded: bool


@dataclass
class Compiled:
    core: dict[str, list[Words]]
    families: dict[str, list[Words]]
    literals: dict[str, int]
    automaton: ahocorasick.Automaton

    def there(self, text: str) -> dict[int, int]:
        """The numbers of all literals in a text, with the place where each ends first."""
        out: dict[int, int] = {}
        for end, i in self.automaton.iter(screens.folded(text)) if self.literals else ():
            out.setdefault(i, end)
        return out


def compiled(dictionary) -> Compiled:
    """Patterns between white space or punctuation, in the dictionary's order, by kind and by family, and one automaton of what they need."""
    out = Compiled({"governed": [], "government": []}, {}, {}, ahocorasick.Automaton())
    for label, kind, families, patterns in dictionary:
        for p in patterns:
            needs = screens.needs(f"(?:{p.removeprefix('(?i)')})")
            numbers = tuple(frozenset(out.literals.setdefault(w, len(out.literals)) for w in n) for n in needs)
            # Without these marks a match is no longer than its alternative.
            bounded = not set("*+{.") & set(p) and max(map(len, screens.alternatives(p))) < NEARBY - 2
            words = Words(label, regex.compile(f"{EDGE}(?:{p}){EDGE}"), numbers, screens.own_words(p), bounded)
            for where in [out.families.setdefault(f, []) for f in families] if families else [out.core[kind]]:
                where.append(words)
    for w, i in out.literals.items():
        out.automaton.add_word(w, i)
    if out.literals:
        out.automaton.make_automaton()
    return out


def matched(text: str, patterns: list[Words], words: Compiled, present: dict[int, int] | None = None) -> list[tuple[str, str, int]]:
    """(label, keyword, byte offset in the text with one space before it), one for each label, by label.

    What a pattern finds is gone for those after it, so only what stands around the gap can be new to them: the automaton walks
    over the text once (``present`` is what it found there before), and then over the surroundings of each gap. No match starts
    much before the first place of a literal it needs, which gaps move to the left by what is gone.
    """
    whole = left = f" {text} "
    there, gone = dict(words.there(whole) if present is None else present), 0
    found: dict[str, tuple[str, str, int]] = {}
    for label, pattern, needs, own, bounded in patterns:
        ends = [min((there[i] for i in n if i in there), default=None) for n in needs]
        if None in ends or own and not any(w in left for w in own):
            continue
        m = pattern.search(left, max(0, max(ends) - NEARBY - gone) if bounded and ends else 0)
        if m is None:
            continue
        a, b = m.span()
        word = m[0].strip().strip(string.punctuation)
        place = whole.find(word)
        found.setdefault(label, (label, word.lower(), len(whole[: place if place >= 0 else a].encode())))
        left, gone, start = left[:a] + left[b:], gone + b - a, max(0, a - NEARBY)
        for i, end in words.there(left[start : a + NEARBY]).items():
            there[i] = min(there.get(i, len(whole)), start + end + gone)
    return sorted(found.values())


def extract(text: str | None, family: str | None, words: Compiled) -> dict | None:
    """Governed and governmental actors; families whose name starts with a key of the dictionary add theirs."""
    if text is None:
        return None
    for p in _blacklist():
        text = p.sub("", text)
    present = words.there(f" {text} ")
    governed = matched(text, words.core["governed"], words, present)
    for key, patterns in words.families.items():
        if family and family.startswith(key):
            governed += matched(text, patterns, words, present)
    unique = {label: (label, word, at) for label, word, at in reversed(governed)}
    rows = lambda each: [dict(zip(("label", "keyword", "offset"), x, strict=True)) for x in each]
    return {"governed": rows(unique[k] for k in sorted(unique)), "government": rows(matched(text, words.core["government"], words, present))}


_CACHE: dict = {}


def _blacklist() -> list[regex.Pattern]:
    return _CACHE.setdefault("blacklist", [regex.compile(p) for p in BLACKLIST])


def actors(text: str | Column, family: str | Column, dictionary=DICTIONARY) -> Column:
    """A struct of governed and governmental actors for each row. Taking words out makes patterns depend on each other, so this runs in Arrow batches."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words = compiled(dictionary)
        for texts, families in batches:
            got = [extract(t, f, words) or {"governed": [], "government": []} for t, f in zip(texts, families, strict=True)]
            yield pd.DataFrame({"governed": [x["governed"] for x in got], "government": [x["government"] for x in got]})

    return F.pandas_udf(run, KIND)(text, family)


def surroundings(text: Column, any_case: dict[str, int], own_case: dict[str, int]) -> Column:
    """struct<present, near>: the numbers of the literals that a text with a space at each end holds, and what stands around them.

    Pieces reach ``NEARBY`` characters past a literal's end, are in order and parted by a null character, which is no edge; so the
    matches in them are those in the text, if they hold a literal and are shorter. Where white space runs on, the piece is the whole.
    """

    automata: list = []  # made in the task: of one kind of function, Spark runs all of a text in one Python process

    def run(texts: pd.Series) -> pd.DataFrame:
        for words, form in ((any_case, screens.folded), (own_case, str)) if not automata else ():
            automaton = ahocorasick.Automaton()
            for w, i in words.items():
                automaton.add_word(w, i)
            if words:
                automaton.make_automaton()
                automata.append((automaton, form))
        blank = regex.compile(r"\s{50}")

        def one(text: str | None) -> tuple[list[int], str]:
            if text is None:
                return [], ""
            whole = f" {text} "
            hits = sorted(hit for automaton, form in automata for hit in automaton.iter(form(whole)))
            spans: list[list[int]] = []
            for end, _ in hits:
                if spans and end - NEARBY <= spans[-1][1]:
                    spans[-1][1] = end + NEARBY
                else:
                    spans.append([max(0, end - NEARBY), end + NEARBY])
            pieces = [whole[a:b] for a, b in spans]
            return sorted({i for _, i in hits}), whole if any(map(blank.search, pieces)) else "\0".join(pieces)

        return pd.DataFrame(list(map(one, texts)), columns=["present", "near"])

    return F.pandas_udf(run, "present array<int>, near string")(text)


def _keyword_of(label: str):
    return lambda w: F.when(w.isNotNull(), F.struct(F.lit(label).alias("label"), F.lower(F.trim(w)).alias("keyword")))


def policy_actors(text: str | Column, dictionary=POLICIES) -> Column:
    """struct of governed and governmental roles in a policy document: each label once, by the first of its patterns that occurs, in the dictionary's order.

    Unlike those of laws these patterns do not depend on each other, so they are native expressions. They run only where literals
    that they need stand, and on what stands around those; their matches are shorter than ``NEARBY`` but for white space.
    """
    text = F.col(text) if isinstance(text, str) else text
    any_case: dict[str, int] = {}
    own_case: dict[str, int] = {}
    # Of each alternative the literal that is least common; of a pattern that is a literal, itself in its own case.
    wanted: dict[str, list[int] | None] = {}
    for p in dict.fromkeys(x for *_, patterns in dictionary for x in patterns):
        needs = [b.needs for b in screens.branches(p)]
        if (word := screens.literal(p)) is not None:
            wanted[p] = [own_case.setdefault(word, len(any_case) + len(own_case))]
        else:
            wanted[p] = [any_case.setdefault(w, len(any_case) + len(own_case)) for n in needs for w in n[0]] if all(needs) else None

    def keyword(pattern: str, found: Column) -> Column:
        extract = lambda t: F.nullif(F.regexp_extract(t, f"{EDGE}(?:{pattern}){EDGE}", 0), F.lit(""))
        numbers = wanted[pattern]
        if numbers is None:
            return extract(F.concat(F.lit(" "), text, F.lit(" ")))
        return F.when(F.arrays_overlap(found["present"], F.lit(numbers)), extract(found["near"]))

    def of(kind: str, found: Column) -> Column:
        each = [let(F.coalesce(*(keyword(x, found) for x in patterns)), _keyword_of(label)) for label, own, _, patterns in dictionary if own == kind and patterns]
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    return let(surroundings(text, any_case, own_case), lambda x: F.struct(of("governed", x).alias("governed"), of("government", x).alias("government")))
