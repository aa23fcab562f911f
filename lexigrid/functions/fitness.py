"""Rules on whom and what a provision applies to: polarity, tags of what it names, and references; native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import screens
from lexigrid.functions.policy import cross_references
from lexigrid.functions.taxa import found
from lexigrid.plans.applicability import ACTIVITY, APPLIES, COMMENCES, DISAPPLIES, EXTENDS, SUBJECT_TO

# Where a provision turns from what applies to what does not.
TURNS = r"\b(?:but\s+(?:they\s+)?shall|except\s+that|save\s+that)"
# Fixed values: (dimension, family prefix or empty for all, pattern, term) of the cross-domain and health-and-safety dictionaries, and of places.
DICTIONARY = (
    ("Place", "", r"outside\s+Great\s+Britain", "outside Great Britain"),
    ("Place", "", r"Great\s+Britain", "Great Britain"),
    ("Place", "", r"Northern\s+Ireland", "Northern Ireland"),
    ("Place", "", r"United\s+Kingdom", "United Kingdom"),
    ("Place", "", r"offshore\s+installation", "offshore installation"),
    ("Place", "", r"territorial\s+(?:sea|waters?)", "territorial sea"),
    ("Place", "", r"construction\s+site", "construction site"),
    ("Place", "", r"England(?:\s+and\s+Wales)?", "England"),
    ("Place", "", r"Wales", "Wales"),
    ("Place", "", r"Scotland", "Scotland"),
    ("Place", "", r"premises", "premises"),
    ("Place", "", r"workplace(?:s)?", "workplace"),
    ("Place", "", r"ship(?:s)?", "ship"),
    ("Place", "", r"establishment(?:s)?", "establishment"),
    ("Person", "", r"body\s+corporate", "body corporate"),
    ("Person", "", r"limited\s+(?:liability\s+)?partner(?:ship)?(?:s)?", "LLP"),
    ("Process", "", r"building\s+work(?:s)?", "building work"),
    ("Process", "", r"development\s+(?:of\s+)?land", "development of land"),
    ("Place", "", r"(?:the\s+)?land\b", "land"),
    ("Place", "", r"dwelling(?:s)?", "dwelling"),
    ("Place", "", r"building(?:s)?", "building"),
    ("Plant", "", r"vehicle(?:s)?", "vehicle"),
    ("Plant", "", r"motor\s+vehicle(?:s)?", "motor vehicle"),
    ("Plant", "", r"goods\s+vehicle(?:s)?", "goods vehicle"),
    ("Plant", "", r"licen[cs]e(?:s)?", "licence"),
    ("Person", "OH&S", r"young\s+person(?:s)?", "young person"),
    ("Person", "OH&S", r"new\s+or\s+expectant\s+moth", "new or expectant mother"),
    ("Person", "OH&S", r"principal\s+contractor", "principal contractor"),
    ("Person", "OH&S", r"principal\s+designer", "principal designer"),
    ("Person", "OH&S", r"domestic\s+client(?:s)?", "domestic client"),
    ("Person", "OH&S", r"client(?:s)?", "client"),
    ("Process", "OH&S", r"lifting\s+operation(?:s)?", "lifting operations"),
    ("Process", "OH&S", r"confined\s+space(?:s)?", "confined spaces"),
    ("Process", "OH&S", r"provision\s+and\s+use", "provision and use"),
    ("Process", "OH&S", r"working\s+at\s+height", "work at height"),
    ("Process", "OH&S", r"work(?:ing)?\s+near\s+voltage", "work near voltage"),
    ("Process", "OH&S", r"fumigat(?:ions?|ants?|ing)", "fumigation"),
    ("Process", "OH&S", r"relevant\s+project", "construction project"),
    ("Plant", "OH&S", r"pressure\s+equipment", "pressure equipment"),
    ("Plant", "OH&S", r"lifting\s+equipment", "lifting equipment"),
    ("Plant", "OH&S", r"machiner(?:y|ies)", "machinery"),
    ("Plant", "OH&S", r"electrical\s+equipment", "electrical equipment"),
    ("Plant", "OH&S", r"scaffold(?:s|ing)?", "scaffolding"),
    ("Plant", "OH&S", r"safety\s+sign(?:s)?", "safety signs"),
)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def polarity(text: str | Column) -> Column:
    """The one polarity of a part of a provision: what it does not apply to before what it extends and applies to; null without any."""
    text = _c(text)
    applies = found(text, APPLIES) | found(text, SUBJECT_TO) | found(text, ACTIVITY) | found(text, COMMENCES)
    return F.when(found(text, DISAPPLIES), "DisappliesTo").when(found(text, EXTENDS), "ExtendsTo").when(applies, "AppliesTo")


def tags(text: str | Column, family: str | Column | None = None, dictionary=DICTIONARY) -> Column:
    """array<struct<dimension, term>> of what a text names: each term once, in the dictionary's order.

    ``dictionary`` rows with a family prefix count in laws of such a family only. Terms are looked for by one walk of an
    automaton, so a larger dictionary costs no more; a term's regular expression runs where its words occur.
    """
    return screens.each_found(_c(text), _patterns(dictionary), lambda hits: _named(hits, family, dictionary))


def _patterns(dictionary) -> list[str]:
    return [rf"\b{p}\b" for _, _, p, _ in dictionary]


def _named(hits: list[Column], family: str | Column | None, dictionary) -> Column:
    family = F.lit("") if family is None else F.coalesce(_c(family), F.lit(""))
    one = lambda hit, dim, fam, term: F.when(hit & (F.lit(True) if not fam else family.startswith(fam)), F.struct(F.lit(dim).alias("dimension"), F.lit(term).alias("term")))
    return F.array_distinct(F.filter(F.array(*(one(hit, dim, fam, term) for hit, (dim, fam, _, term) in zip(hits, dictionary, strict=True))), lambda x: x.isNotNull()))


def rules(text: str | Column, family: str | Column | None = None, dictionary=DICTIONARY) -> Column:
    """array<struct<polarity, tags, text, references>>: two rules where a provision turns from one polarity to another, else one, or none."""
    text = F.trim(_c(text))
    at = F.regexp_instr(text, F.lit("(?i)" + TURNS))
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    turned = found(text, DISAPPLIES) & found(text, APPLIES) & (at > 0) & (polarity(before) != polarity(after))
    parts = F.when(F.coalesce(turned, F.lit(False)), F.array(before, after)).when(polarity(text).isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))
    rule = lambda t, hits: F.struct(polarity(t).alias("polarity"), _named(hits, family, dictionary).alias("tags"), F.trim(t).alias("text"), cross_references(t).alias("references"))
    return screens.each_found_in_parts(parts, _patterns(dictionary), rule)


def terms(spark: SparkSession, family: str | None = None, dictionary=DICTIONARY) -> DataFrame:
    """(dimension, term, place): the dictionary's terms, each once in its dimension; with a family, its own ones, too."""
    rows = dict.fromkeys((dim, term) for dim, fam, _, term in dictionary if not fam or (family or "").startswith(fam))
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "dimension string, term string, place int")
