"""Which of several sources decides an actor's position or a provision's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How sure a source must be, as single-precision numbers.
CLASSIFIER_LEAST, SLM_LEAST, GAP_LEAST, DISAGREE_LEAST = 0.70, 0.90, 0.70, 0.75
# Actor and position that trigger an inferred actor: (actor, position, type, inferred actor, category, position, type).
CORRELATIVES = "trigger_actor string, trigger_position string, trigger_drrp string, inferred_actor string, inferred_category string, inferred_position string, inferred_drrp string"


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def position(regex: str = "regex_pos", classifier: str = "cls_pos", classifier_confidence: str = "cls_conf", inferred: str = "inferred_pos", slm: str = "slm_pos", slm_confidence: str = "slm_conf", llm: str = "llm_pos") -> Column:
    """struct<position, method>: the language model, then inference, a sure small model, agreement, a sure classifier, what waits, the pattern."""
    c = F.col
    sure_slm = c(slm).isNotNull() & (F.coalesce(c(slm_confidence), _f(0.0)) >= _f(SLM_LEAST))
    sure_cls = c(classifier).isNotNull() & (F.coalesce(c(classifier_confidence), _f(0.0)) >= _f(CLASSIFIER_LEAST))
    pick = lambda value, method: F.struct(value.alias("position"), F.lit(method).alias("method"))
    return (
        F.when(c(llm).isNotNull(), pick(c(llm), "llm"))
        .when(c(inferred).isNotNull(), pick(c(inferred), "inferred"))
        .when(sure_slm, pick(c(slm), "slm"))
        .when(c(regex).isNotNull() & (c(regex) == c(classifier)), pick(c(regex), "agree"))
        .when(sure_cls, pick(c(classifier), "classifier"))
        .when(c(classifier).isNotNull() & c(regex).isNotNull(), pick(c(regex), "pending_slm"))
        .when(c(regex).isNotNull(), pick(c(regex), "regex"))
    )


def drrp(llm: str, slm: str, regex: str) -> Column:
    return F.coalesce(llm, slm, regex)


def reconciled(actors: DataFrame) -> DataFrame:
    """The actors that any source but the classifier alone speaks for, with position and method."""
    return actors.withColumn("_r", position()).where(F.coalesce("llm_pos", "inferred_pos", "slm_pos", "regex_pos").isNotNull()).select(*actors.columns, "_r.position", "_r.method")


def infer(actors: DataFrame, rules: DataFrame) -> DataFrame:
    """Actors that rules infer from those there are; not from inferred ones, and none whose label the section has already."""
    met = actors.join(F.broadcast(rules), (actors["actor_label"] == rules["trigger_actor"]) & (actors["position"] == rules["trigger_position"]) & (rules["trigger_drrp"].isNull() | (actors["drrp"] == rules["trigger_drrp"])))
    new = met.select("section_id", F.col("inferred_actor").alias("actor_label"), F.col("inferred_category").alias("category"), F.col("inferred_position").alias("inferred_pos"), F.col("inferred_drrp").alias("inferred_drrp")).distinct()
    return new.join(actors.select("section_id", "actor_label"), ["section_id", "actor_label"], "left_anti")


def transition(has_drrp: str, drrp_type: str, predicted: str, confidence: str) -> Column:
    """struct<action, drrp, method> of a classifier's word on a provision: agreement, filled or weak gap, disagreement, or kept."""
    c = F.col
    out = lambda action, value, method: F.struct(F.lit(action).alias("action"), value.alias("drrp"), F.lit(method).alias("method"))
    none = F.lit(None).cast("string")
    return (
        F.when(~c(has_drrp) & (c(predicted) == "none"), out("agree_none", none, "regex"))
        .when(~c(has_drrp) & (c(confidence) >= _f(GAP_LEAST)), out("gap_fill", c(predicted), "classifier"))
        .when(~c(has_drrp), out("weak_gap", none, "pending_llm"))
        .when(c(drrp_type) == c(predicted), out("agree", c(drrp_type), "regex"))
        .when((c(predicted) != "none") & (c(confidence) >= _f(DISAGREE_LEAST)), out("disagree", c(predicted), "pending_llm"))
        .otherwise(out("keep", c(drrp_type), "regex"))
    )


def stage(published: str = "published_hash", taxa: str = "taxa_hash", provisions: str = "n_provisions") -> Column:
    """How far a law has come: published, enriched, has text, or needs it."""
    c = F.col
    return (
        F.when(c(published).isNotNull() & (c(published) == c(taxa)), "published")
        .when(c(published).isNotNull() & c(taxa).isNotNull(), "republish")
        .when(c(taxa).isNotNull(), "enriched")
        .when(F.coalesce(c(provisions), F.lit(0)) > 0, "needs_taxa")
        .otherwise("needs_lat")
    )


# The rules that infer an actor from another's position.
RULES = (
    ("Ind: Employee", "active", "Obligation", "Org: Employer", "Org", "counterparty", "Obligation"),
    ("EU: Member State", "active", None, "Org: Responsible Undertaking", "Org", "counterparty", None),
    ("Gvt: Authority: Enforcement", "active", None, "Ind: Public", "Ind", "beneficiary", None),
)


def rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), CORRELATIVES)
