import random
import re

from pyspark.sql import functions as F

from lexigrid.functions import decisions, fitness, patterns, screens, taxa
from lexigrid.plans import applicability

EVERY = [p for _, p in patterns.PURPOSES + patterns.CATEGORIES] + [p for *_, p in decisions.FIRST + decisions.SECOND] + [p for _, p in decisions.OFFENCES]
EVERY += [decisions.PENALTY_FIRST, decisions.PENALTY, taxa.FICTION, taxa.IMMUNITY, taxa.SUMMARY, taxa.OBLIGATION, taxa.ENABLING, taxa.PROHIBITION]
EVERY += [applicability.APPLIES, applicability.DISAPPLIES, applicability.EXTENDS, applicability.SUBJECT_TO, applicability.ACTIVITY, applicability.COMMENCES]
EVERY += [rf"\b{p}\b" for _, _, p, _ in fitness.DICTIONARY]


def texts(seed, n):
    """Texts out of the patterns' own words and letters, in any order and case, with line ends and letters like ASCII ones."""
    rng = random.Random(seed)
    words = sorted({w for p in EVERY for w in re.findall(r"[A-Za-z]+(?: [a-z]+)*", re.sub(r"\\[A-Za-z]|\[(\w)\w\]", r"\1", p))})
    whole = [x for p in EVERY for x in screens.alternatives(p)]
    plain = lambda p: re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\[(\w)\w\]", r"\1", re.sub(r"\\b|\\s[*+]?|\.\*\??|\.\{\d+,\d+\}", " ", p))).replace("?", "")
    for _ in range(n):
        parts = [rng.choice([plain(rng.choice(whole)), rng.choice(words), rng.choice(words)]) for _ in range(rng.randrange(1, 14))]
        text = rng.choice([" ", " ", "  ", ". "]).join(x + rng.choice(["", "", "", "\n", "\r\n", "\u2028", ",", ".", "s", '"', "“x”", " 7("]) for x in parts)
        text = rng.choice([str, str, str.lower, str.upper, str.title])(text)
        yield rng.choice([lambda t: t, lambda t: t, lambda t: t.replace("s", "ſ"), lambda t: t.replace("i", "İ").replace("k", "K"), lambda t: t.replace("i", "ı")])(text)


def test_screened_patterns_match_what_they_match_in_full(spark):
    rows = [(t,) for t in [*texts(1, 1500), "", "\n", "ss", "Regulationshall have effect", "Regulations shall have effect", "Regulationsshall have effect"]]
    df = spark.createDataFrame(rows, "t string").repartition(4).cache()
    hits = 0
    for i in range(0, len(EVERY), 12):
        part = EVERY[i : i + 12]
        together = screens.each_found(F.col("t"), part, lambda hits: F.array(*hits))
        alone, full = F.array(*(screens.found(F.col("t"), p) for p in part)), F.array(*(F.col("t").rlike("(?iU)" + p) for p in part))
        for r in df.select("t", together.alias("together"), alone.alias("alone"), full.alias("full")).collect():
            for p, a, b, c in zip(part, r.together, r.alone, r.full, strict=True):
                assert a == b == c, (p, r.t)
                hits += c
    assert hits > 5000


def test_what_is_read_off_a_pattern():
    assert screens.needs(r"comes? into force") == ((" into force",), ("come",))
    assert screens.needs(r"a+b[xyz]c{0,3}d") == (("a",), ("d",), ("b",)) or set(screens.needs(r"a+b[xyz]c{0,3}d")) == {("a",), ("b",), ("d",)}
    assert screens.needs(r"(?:ab|c)?x") == (("x",),)
    assert screens.needs(r"\d+[^a]") == ()
    assert screens.alternatives("(?:a|(?:b|c)|[|])") == ["a", "(?:b|c)", "[|]"]
    assert screens.linear("fees?.*?paid") == "(?m)^(?>.*?(?:fee)).*(?:paid)"
    assert screens.linear(r"\ba\b.*b.*?c") == r"(?m)^(?>.*?(?:\ba\b))(?>.*?(?:b)).*(?:c)"
    assert screens.linear(r"x\s.*y") == r"x\s.*y"


def test_gaps_are_crossed_once(spark):
    import time

    text = "for x " * 100_000  # a plain search would cross the gap from each of the words
    start = time.perf_counter()
    assert not spark.createDataFrame([("substitute " + text,)], "t string").select(screens.found(F.col("t"), "for.*?substitute")).first()[0]
    assert time.perf_counter() - start < 10
