"""Does a law make duties of its own? Signals of five tiers, folded into one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.taxa import let

# Base rate, thresholds, the weight of each tier, and the signals (text, name, confidence).
BASE, MAKING, NOT_MAKING = 0.173, 0.70, 0.30
WEIGHTS = {1: 0.95, 2: 0.75, 3: 0.50, 4: 0.65, 5: 0.85}
TITLES = (
    (2, "(Revocation", "title_revocation", 0.98),
    (2, "(Consequential", "title_consequential", 0.90),
    (2, "(Repeal", "title_repeal", 0.92),
    (2, "(Amendment", "title_amendment", 0.80),
    (2, "(Transitional", "title_transitional", 0.75),
)
MAKES = (
    ("to make further provision for securing", "provision_securing", 0.90),
    ("to make provision for securing", "provision_securing", 0.90),
    ("to make further provision for", "provision_for", 0.70),
    ("to make provision for", "provision_for", 0.70),
    ("to require", "to_require", 0.80),
    ("to prohibit", "to_prohibit", 0.80),
    ("to regulate", "to_regulate", 0.75),
    ("to impose", "to_impose", 0.80),
    ("to establish", "to_establish", 0.70),
    ("to create", "to_create", 0.70),
)
MAKES_NOT = (
    ("to amend the", "desc_to_amend", 0.75),
    ("to give effect to", "desc_give_effect", 0.65),
    ("in exercise of the powers conferred by", "desc_powers_conferred", 0.55),
)
_KIND = "struct<making:boolean,tier:int,name:string,confidence:double>"


def _signal(when: Column, making: bool, tier: int, name: str, confidence: Column | float) -> Column:
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(when, F.struct(F.lit(making).alias("making"), F.lit(tier).alias("tier"), F.lit(name).alias("name"), confidence.cast("double").alias("confidence")))


def signals(counts: bool = False) -> Column:
    """The signals of title, description, body_paras and schedule_paras (and of triage counts), not making first, then by tier."""
    title, body, schedule, low = F.col("title"), F.col("body_paras"), F.col("schedule_paras"), F.lower("description")
    appointed = title.contains("(Appointed Day")
    found = [_signal(appointed, False, 1, "title_appointed_day", 1.0), _signal(~appointed & title.contains("(Commencement"), False, 1, "title_commencement", 0.99)]
    found += [_signal(title.contains(text), False, tier, name, c) for tier, text, name, c in TITLES]
    found += [
        _signal((body <= 3) & (schedule > 50), False, 3, "low_body_high_schedule", 0.90),
        _signal(body > 50, True, 3, "high_body_paras", F.round(F.least(F.lit(0.85), 0.50 + body / 500.0), 2)),
        _signal(body <= 5, False, 3, "very_low_body_paras", 0.60),
    ]
    found += [_signal(low.contains(text), True, 4, name, c) for text, name, c in MAKES]
    found += [_signal(low.contains(text), False, 4, name, c) for text, name, c in MAKES_NOT]
    if counts:
        total, owed = F.col("n_total"), F.col("n_obligation")
        share = lambda c: F.when(total > 0, F.col(c) / total)
        found += [
            _signal((owed >= 3) & (share("n_obligation") > 0.10) & (share("n_actor") > 0.05), True, 5, "provisions_with_obligations", F.round(F.least(F.lit(0.95), 0.60 + share("n_obligation") * 0.4), 2)),
            _signal((share("n_amendment") > 0.60) & (owed < 3), False, 5, "mostly_amendment", F.least(F.lit(0.95), 0.70 + share("n_amendment") * 0.25)),
            _signal((total >= 10) & (owed == 0), False, 5, "no_obligations_found", 0.85),
            _signal((share("n_process_rule") > 0.40) & (share("n_amendment") < 0.10) & (total >= 5), True, 5, "high_process_rule", F.least(F.lit(0.85), 0.50 + share("n_process_rule") * 0.3)),
        ]
    kept = F.filter(F.array(*found).cast(f"array<{_KIND}>"), lambda s: s.isNotNull())
    # The list is made once and then taken apart; each signal's test is a search in the title or the description.
    return let(kept, lambda every: F.flatten(F.array(*(F.filter(every, _of(m, t)) for m in (False, True) for t in WEIGHTS))))


def _of(making: bool, tier: int):
    return lambda s: (s["making"] == F.lit(making)) & (s["tier"] == tier)


def fold(found: str = "signals") -> Column:
    """The composite score: each signal draws it towards one or nought by its confidence and its tier's weight."""
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    step = lambda a, s: F.when(s["making"], a + (1 - a) * s["confidence"] * weight[s["tier"]]).otherwise(a * (1 - s["confidence"] * weight[s["tier"]]))
    return F.round(F.aggregate(found, F.lit(BASE), step), 4)


def detect(laws: DataFrame, counts: bool = False) -> DataFrame:
    """The laws with signals, score, tier (of the highest signal) and class: making, not_making or uncertain."""
    out = laws.withColumn("signals", signals(counts)).withColumn("score", fold())
    kind = F.when(F.col("score") >= MAKING, "making").when(F.col("score") <= NOT_MAKING, "not_making").otherwise("uncertain")
    return out.withColumn("tier", F.coalesce(F.array_max(F.transform("signals", lambda s: s["tier"])), F.lit(0))).withColumn("class", kind)
