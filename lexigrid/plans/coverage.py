"""How much of a corpus is covered: triage of laws by their provisions, audits of rules and terms, and counts by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import taxa


def triage(provisions: DataFrame, law: str, text: str, purposes: str, actor: str) -> DataFrame:
    """Eight counts of each law's provisions with text: all, by purpose, with an actor, with modals; what ``making.detect`` takes."""
    own = F.col(purposes)
    count = lambda when, name: F.count_if(when).alias(name)
    return (
        provisions.where(F.coalesce(F.col(text), F.lit("")) != "")
        .groupBy(law)
        .agg(
            F.count("*").alias("n_total"),
            count(F.get(own, F.lit(0)) == taxa.PROCESS, "n_process_rule"),
            count(F.array_contains(own, taxa.AMENDMENT), "n_amendment"),
            count(F.array_contains(own, taxa.ENACTMENT), "n_enactment"),
            count(F.array_contains(own, taxa.INTERPRETATION), "n_interpretation"),
            count(F.col(actor), "n_actor"),
            count(taxa.found(text, taxa.OBLIGATION), "n_obligation"),
            count(taxa.found(text, taxa.ENABLING), "n_enabling"),
        )
    )


def rule_audit(rules: DataFrame, by: str) -> DataFrame:
    """Rules of each group, those without a tag, those that refer to others, and the polarities they have."""
    return rules.groupBy(by).agg(F.count("*").alias("n_rules"), F.count_if(F.size("tags") == 0).alias("n_gaps"), F.count_if(F.size("references") > 0).alias("n_with_references"), F.countDistinct("polarity").alias("n_polarities"))


def term_hits(terms: DataFrame, tags: DataFrame) -> DataFrame:
    """The dictionary's terms (dimension, term) and how often a rule has each; nought for those that none has."""
    n = tags.groupBy("dimension", "term").agg(F.count("*").alias("n"))
    return terms.select("dimension", "term").distinct().join(n, ["dimension", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mention_status(mentions: DataFrame, most: int = 30) -> DataFrame:
    """(law_name, n_mentions, n_with_entities, n_polarities) of the laws with most mentions, by section_id ``law:section``."""
    law = F.split_part("section_id", F.lit(":"), F.lit(1)).alias("law_name")
    n = mentions.groupBy(law).agg(F.count("*").alias("n_mentions"), F.count_if(F.size("entities") > 0).alias("n_with_entities"), F.countDistinct("polarity").alias("n_polarities"))
    return n.orderBy(F.desc("n_mentions"), "law_name").limit(most)


def by_tier(provisions: DataFrame, actors: DataFrame, section: str = "section_id") -> DataFrame:
    """One row of counts over provisions (scope, embedding) and their actors: in scope, embedded, with actors, and positions of each source."""
    p = provisions.agg(F.count("*").alias("n_provisions"), *(F.count_if(F.col("scope") == s).alias(f"n_{s}") for s in ("out", "structural", "substantive")), F.count_if((F.col("scope") == "substantive") & F.col("embedding").isNull()).alias("n_unembedded"))
    of = actors.join(provisions.select(section, "scope"), section)
    there = lambda c: F.count_if((F.col("scope") == "substantive") & F.col(c).isNotNull()).alias(f"n_{c}")
    a = of.agg(F.count_if(F.col("scope") == "out").alias("n_orphans"), F.count_if(F.col("scope") == "substantive").alias("n_actors"), *(there(c) for c in ("regex_pos", "cls_pos", "slm_pos", "llm_pos")))
    return p.join(F.broadcast(a))  # one row each
