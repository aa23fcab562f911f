"""Fill-in-the-middle transformation: texts are cut into units at zero-width boundaries, and the parts stand in another order.

A grammar of units is stated by the pairs of neighbouring character classes between which a unit ends. Each pair becomes a
lookbehind and a lookahead, so ``split`` consumes nothing and its pieces put together are the text again. All is native: one
scan, no shuffle, and no more memory than a text and its pieces.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, WORD, ANY = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[\x00-\x{10FFFF}]"
#: What stands before and after the end of a unit. ``token``: white space belongs to the word that follows it; ``run``: words and
#: white space are units of their own; ``line``: a line with its end.
UNITS = {
    "token": ((WORD, SPACE),),
    "run": ((WORD, SPACE), (SPACE, WORD)),
    "line": ((r"\n", ANY),),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and of those, that have the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
ADDED = ("n_units", "form", "prefix", "middle", "suffix", "output")


def boundary(unit: str) -> str:
    """The regular expression of a unit's ends."""
    return "|".join(f"(?<={before})(?={after})" for before, after in UNITS[unit])


def units(text: Column, unit: str = "token") -> Column:
    """The text's units in order, none for an empty text (which ``split`` would give back as one empty piece)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


class Draws(NamedTuple):
    """Four unsigned 32-bit integers that depend on the seed and the document's key only."""

    first: Column
    second: Column
    whether: Column
    order: Column


def draws(key: Column, seed: int) -> Draws:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return Draws(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def restore(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made from: sentinels are marks of order in all forms but plain."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # the first is empty: an output starts with a sentinel
    at = lambda *order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "token", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """All columns of the documents (doc_id, text, ...) and n_units, form, prefix, middle, suffix and output.

    Two draws name the ends of prefix and middle among the n + 1 boundaries of a text's n units, so each part may be empty.
    ``rate`` percent of the documents are transformed, ``suffix_first`` percent of those to ``spm``, the rest to ``psm``; all
    others are ``plain``: the output is the text, and the parts are null. A text is plain, too, if it is empty or holds a
    sentinel, for then the output could not be undone. A null text counts as empty; a null doc_id draws like an empty one, and
    rows with one doc_id draw alike. Columns named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce("text", F.lit("")).alias("body"), F.struct(*(x.alias(n) for n, x in zip(Draws._fields, draws(F.col("doc_id"), seed), strict=True))).alias("draw"))
    plain = (F.col("body") == "") | F.col("body").contains(PREFIX) | F.col("body").contains(SUFFIX) | F.col("body").contains(MIDDLE) | (F.col("draw.whether") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("draw.order") % 100 < suffix_first, "spm").otherwise("psm")
    cut = rows.select("row", "body", "draw", form.alias("form"), units(F.col("body"), unit).alias("units")).withColumn("n", F.size("units"))
    ends = [F.col(f"draw.{x}") % (F.col("n") + 1) for x in ("first", "second")]
    placed = cut.select("row", "body", "form", "units", "n", F.least(*ends).cast("int").alias("a"), F.greatest(*ends).cast("int").alias("b"))
    joined = lambda start, length: F.when(F.col("form") != "plain", F.concat_ws("", F.slice("units", start, length)))
    parts = placed.select(
        "row", "body", "form", "n",
        joined(F.lit(1), F.col("a")).alias("prefix"), joined(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), joined(F.col("b") + 1, F.col("n") - F.col("b")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("body"))
    return parts.select(*(F.col("row")[c].alias(c) for c in kept), F.col("n").cast("long").alias("n_units"), "form", "prefix", "middle", "suffix", output.alias("output"))
