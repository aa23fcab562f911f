"""The full record of a provision: purposes, actors and their positions, duty, clause, categories and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import actors, clauses, decisions, duties, fitness, scalars, taxa

# Things that are the subject of a rule, and persons whose duty it is none of.
THINGS = ("arrangements", "routes", "exits", "equipment", "systems", "measures", "rooms", "facilities", "site", "steps", "structure", "vessel", "cofferdam", "caisson", "lighting", "precautions", "notice", "procedures", "timber", "material", "workplace", "premises", "device", "platform", "scaffolding", "scaffold", "plant", "machinery", "guard", "barrier", "fence", "ventilation", "temperature", "door", "gate", "floor", "surface", "place of work", "work equipment", "personal protective equipment", "excavation", "vehicle", "means of access", "means of egress", "welfare facilities")
PERSONS = ("employer", "employee", "person", "contractor", "worker", "occupier", "owner", "operator", "master", "manager", "duty holder", "responsible person", "competent person", "self-employed", "designer", "manufacturer", "supplier", "installer", "principal contractor", "client", "secretary of state", "minister", "authority", "commission", "commissioner", "inspector", "executive", "tribunal", "court")
RULE_MODAL, RULE_WINDOW, RULE_CONFIDENCE, NEAR = r"\b(?:shall|must|is required to|may|entitled)\b", 80, 0.55, 3


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rules_of_things(text: str | Column) -> Column:
    """The signal of the first modal that a thing stands before, within 80 characters and with no person in between; else none.

    Texts are walked modal by modal, with what stands before each carried along.
    """
    low = F.lower(_c(text))
    words = F.regexp_extract_all(low, F.lit(RULE_MODAL), F.lit(0))
    parts = F.slice(F.split(low, RULE_MODAL), 1, F.size(words))
    thing = r"(?s)^.*((?:" + "|".join(THINGS) + r").*)$"
    start = F.struct(F.lit("").alias("before"), F.lit(None).cast("string").alias("modal"))

    def step(s: Column, x: Column) -> Column:
        before = F.right(F.concat(s["before"], x["part"]), F.lit(RULE_WINDOW))
        between = F.regexp_extract(before, thing, 1)
        hit = (between != "") & ~between.rlike("|".join(PERSONS))
        return F.struct(F.concat(before, x["word"]).alias("before"), F.coalesce(s["modal"], F.when(hit, x["word"])).alias("modal"))

    pairs = F.zip_with(parts, words, lambda p, w: F.struct(p.alias("part"), w.alias("word")))
    modal = F.aggregate(pairs, start, step)["modal"]
    kind = F.when(modal.rlike("may|entitled"), "Enabling").otherwise("ThingObligation")
    signal = F.array(F.struct(F.lit("rule").alias("tier"), kind.alias("kind"), F.lit(RULE_CONFIDENCE).alias("confidence")))
    return F.when(modal.isNotNull(), signal).otherwise(F.slice(signal, 1, 0))


def positions(found: str | Column, duty: str | Column) -> Column:
    """array<struct<label, position>> of all actors, governed first: active where the duty's words start, else counterparty.

    With none so near the first actor is active. Null where the duty has no place.
    """
    found, duty = _c(found), _c(duty)
    every = F.concat(found["governed"], found["government"])
    near = lambda a: (a["offset"] <= duty["actor_start"] + NEAR) & (a["offset"] + F.octet_length(a["keyword"]) + NEAR >= duty["actor_start"])
    some = F.exists(every, near)
    named = F.transform(every, lambda a, i: F.struct(a["label"].alias("label"), F.when(near(a) | (~some & (i == 0)), "active").otherwise("counterparty").alias("position")))
    return F.when(duty["modal_start"].isNotNull(), named)


def settled(df: DataFrame) -> DataFrame:
    """The same rows; the optimiser does not write expressions on one side of this step into those on the other, which name them many times."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def record(df: DataFrame, text: str, family: str | Column | None = None) -> DataFrame:
    """The table with clean_text, purposes, actors, duty, decision, categories, clause, clause_parts, clause_confidence, fitness and positions.

    A provision that its purposes or an introductory phrase gate has no duty, clause, categories or positions; rules on
    application are those of provisions whose purpose it is. An empty text has none of all, and the reason empty_text.
    """
    family = None if family is None else _c(family)
    if family is not None:
        df = df.withColumn("_family", family)
    df = settled(df.withColumn("clean_text", scalars.clean(text)))
    family = F.lit(None).cast("string") if family is None else F.col("_family")
    # All that Arrow batches tell comes from the one column, so that a single step makes it; gates apply to it afterwards.
    df = df.withColumns({"purposes": taxa.purposes("clean_text"), "actors": actors.actors(F.col("clean_text"), family), "duty": duties.duties("clean_text"), "_government": decisions.names_government("clean_text")})
    df = settled(df)
    df = df.withColumn("_gated", F.coalesce(taxa.skip_types("purposes", F.size("actors.government") > 0), F.lit(False)))
    shut = F.col("_gated") | taxa.descriptive_summary("clean_text") | (F.col("clean_text") == "")
    # Columns, not expressions: what follows names each of them many times.
    df = settled(df.withColumn("_open", F.when(~F.coalesce(shut, F.lit(True)), F.col("clean_text"))))
    df = df.withColumns({"duty": F.when(F.col("_open").isNotNull(), F.col("duty")), "_offence": decisions.offences_and_rejections("_open")})
    none = lambda kind: F.array().cast(kind)
    every = F.concat(F.coalesce("duty.signals", none(decisions.SIGNAL)), decisions.government("_open", "_government"), F.col("_offence.signals"), rules_of_things("_open"))
    rejected = F.concat(F.coalesce("duty.rejected", none(decisions.REJECTED)), F.col("_offence.rejected"))
    df = settled(df.withColumns({"_signals": every, "_rejected": rejected}))
    df = settled(df.withColumn("decision", decisions.decide("clean_text", "_signals", "_gated", "_rejected")))
    won = F.col("decision.reason") == "tier_priority"
    ours = won & (F.col("decision.tier") == "governed")
    refined = taxa.let(clauses.refine("clean_text"), lambda c: F.when(c != "", c))
    clause = F.when(ours & F.col("duty.clause").isNotNull(), F.col("duty.clause")).when(won, refined)
    df = settled(df.withColumn("clause", clause).withColumn("duty", F.when(ours, F.col("duty"))))
    types = F.when(won, F.array("decision.duty_type")).otherwise(F.array().cast("array<string>"))
    categories = F.when(F.col("decision.reason").isin("tier_priority", "no_signals", "legal_fiction"), taxa.categories("clean_text", types))
    fit = F.when(F.array_contains("purposes", taxa.APPLICATION), fitness.rules("clean_text", family))
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    df = df.withColumns(
        {
            "categories": categories,
            "clause_parts": clauses.decompose("clause"),
            "clause_confidence": F.coalesce(taxa.clause_confidence("clause", F.coalesce(F.col("duty.modal_start").isNotNull(), F.lit(False))), F.lit(0.0)),
            "fitness": fit,
            "positions": positions("actors", "duty"),
            "decision": F.when(empty, F.col("decision").withField("reason", F.lit("empty_text"))).otherwise(F.col("decision")),
        }
    )
    return df.drop("_family", "_gated", "_open", "_government", "_offence", "_signals", "_rejected")


def trail(decision: str | Column = "decision") -> Column:
    """The decision on a provision as JSON: reason, winner, how many signals and rejections there were, and each rejection with its reason."""
    d = _c(decision)
    winner = F.when(d["tier"].isNotNull(), F.struct(d["tier"].alias("tier"), d["kind"].alias("kind"), d["confidence"].alias("confidence")))
    return F.to_json(F.struct(d["reason"].alias("reason"), d["n_candidates"].alias("candidates"), F.size(d["rejected"]).alias("rejections"), winner.alias("winner"), d["rejected"].alias("rejected")))
