"""Serious-injury scoring: the chance that a calibrated severity passes a threshold, bands by magnitude, and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions import metalog

THRESHOLD, SIF, ELEVATED, HALVINGS, LEAST, MOST = 0.10, 0.5, 0.1, 50, 0.001, 0.999


def p_sif(p10: str, p50: str, p90: str, threshold: float = THRESHOLD) -> Column:
    """The chance of at least the threshold under a metalog on (0, 1); equal percentiles are a point."""
    goal = math.log(threshold / (1 - threshold))
    line = lambda p: F.ln(F.col(p) / (1 - F.col(p)))
    fitted = {"m": line(p50), "s": (line(p90) - line(p10)) / (2 * metalog.LOGIT_90), "k": (line(p90) + line(p10) - 2 * line(p50)) / (0.8 * metalog.LOGIT_90)}
    rise = lambda y, c: c["m"] + (c["s"] + c["k"] * (y - 0.5)) * F.ln(y / (1 - y))
    z = lambda y: rise(y, fitted)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        below = rise(mid, s) < goal
        return F.struct(F.when(below, mid).otherwise(s["a"]).alias("a"), F.when(below, s["b"]).otherwise(mid).alias("b"), s["m"].alias("m"), s["s"].alias("s"), s["k"].alias("k"))

    # The fit goes along in the state, so that it is made once for a row and not once for a step.
    start = F.struct(F.lit(LEAST).alias("a"), F.lit(MOST).alias("b"), *(c.alias(n) for n, c in fitted.items()))
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: 1 - (s["a"] + s["b"]) / 2)
    point = F.abs(F.col(p10) - F.col(p90)) < 1e-6
    return F.when(point, F.when(F.col(p50) >= threshold, 1.0).otherwise(0.0)).when(z(F.lit(MOST)) < goal, 0.0).when(z(F.lit(LEAST)) >= goal, 1.0).otherwise(inner)


def label(p: Column) -> Column:
    return F.when(p >= SIF, "SIF").when(p >= ELEVATED, "ELEVATED").otherwise("LOW")


def bands(events: DataFrame, calibration: DataFrame, mechanism: str = "mechanism", magnitude: str = "magnitude") -> DataFrame:
    """Events with the band of their mechanism that holds their magnitude, or that mechanism's default band.

    ``calibration``: (mechanism, band, low, high, is_default, p10, p50, p90), a null ``high`` being open; a few rows for each mechanism.
    """
    inside = (F.col(magnitude) >= F.col("low")) & (F.col("high").isNull() | (F.col(magnitude) < F.col("high")))
    rows = events.withColumn("_row", F.monotonically_increasing_id())
    met = rows.join(F.broadcast(calibration), mechanism).withColumn("_fit", F.when(F.coalesce(inside, F.lit(False)), 0).when(F.col("is_default"), 1))
    best = Window.partitionBy("_row").orderBy("_fit", "low")
    return met.where(F.col("_fit").isNotNull()).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_fit", "_row", "is_default")


def evaluation(df: DataFrame, truth: str, predicted: str, positive: str = "SIF") -> DataFrame:
    """Counts of right and wrong, precision and recall of one label."""
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    n = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return n.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


# Names of mechanisms as they are reported, and the mechanism that each stands for.
MECHANISMS = {
    **{m: m for m in ("transport", "fall", "struck", "caught_in", "explosion", "fire", "electrical", "thermal", "chemical", "breathing", "pressure", "structural_collapse", "assault", "overexertion", "slip_no_fall", "abrasion", "radiation_noise", "animal_insect")},
    "collision": "transport",
    "cut": "struck",
    "cutting": "struck",
    "mechanical": "caught_in",
    "contact": "struck",
    "impact": "struck",
    "biological": "animal_insect",
    "respiratory": "breathing",
    "inhalation": "breathing",
    "exposure": "chemical",
}


def mechanism(name: str | Column) -> Column:
    """The mechanism that a reported name stands for; null for unknown ones."""
    name = F.col(name) if isinstance(name, str) else name
    return F.create_map(*(F.lit(x) for pair in MECHANISMS.items() for x in pair))[F.lower(F.trim(name))]


def quantity(text: str | Column) -> Column:
    """The first number of a magnitude told in words, as a double; null without one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def export(events: DataFrame, sources: dict[str, DataFrame], key: str = "event_id") -> DataFrame:
    """Events with the columns of each source (name: table with one row for each key) before which its name stands; null where it has none."""
    for name, table in sources.items():
        events = events.join(table.select(key, *(F.col(c).alias(f"{name}_{c}") for c in table.columns if c != key)), key, "left")
    return events


def reference_hazards(hazards: DataFrame, least: float = SIF) -> DataFrame:
    """Reference hazards (name, p10, p50, p90) with their chance of serious injury, and whether it is as high as it must be."""
    return hazards.withColumn("p", F.round(p_sif("p10", "p50", "p90"), 6)).withColumn("passed", F.col("p") >= least)


def mitigated_hazards(hazards: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """(name, before, after): chances of at least the threshold among n seeded trials, without and with a control that works in part.

    ``hazards``: (name, entity, p10, p50, p90, effect). Probabilities of trials are kept between 0.001 and 0.999; trials of
    one hazard are numbered, so they come out alike however they are dealt to tasks.
    """
    each = hazards.withColumn("trial", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")))).repartition("trial")
    each = each.withColumn("u", F.least(F.greatest(metalog.uniform(F.col("trial"), F.col("entity"), F.lit(1)), F.lit(LEAST)), F.lit(MOST)))
    coeffs = metalog.fit_triplet("p10", "p50", "p90", F.lit(metalog.BOUNDED), 0.0, 1.0)
    each = each.withColumn("c", coeffs).withColumn("x", metalog.quantile("u", "c", F.lit(metalog.BOUNDED), 0.0, 1.0))
    over = lambda x: F.round(F.avg((x >= threshold).cast("int")), 6)
    return each.groupBy("name").agg(over(F.col("x")).alias("before"), over(F.col("x") * (1 - F.col("effect"))).alias("after"))


def taxonomy(rows: DataFrame, order: str = "line") -> DataFrame:
    """Codes (line, depth, code, title) with ``path``: the codes of the nearest rows above of each smaller depth, and its own.

    Rows are those of one classification file, and their order is the file's.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    levels = [F.last(F.when(F.col("depth") == d, F.col("code")), ignorenulls=True).over(w) for d in range(4)]
    return rows.withColumn("path", F.concat_ws("/", *(F.when(F.lit(d) < F.col("depth"), c) for d, c in enumerate(levels)), "code"))


def new_events(incoming: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """Incoming events that are not stored, each once."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
