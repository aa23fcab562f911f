"""Significance ratings of provisions and laws from five dimensions rated HIGH, MEDIUM or LOW."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.joins import preceding
from lexigrid.operators.ranking import quarters, rate_by_rank

DIMENSIONS = ("scope_duty_bearer", "scope_protected_class", "gravity", "strength", "hierarchy")
# Weights and thresholds of the ratings.
WEIGHTS_B = {"gravity": 0.35, "scope_duty_bearer": 0.20, "scope_protected_class": 0.20, "strength": 0.15, "hierarchy": 0.10}
WEIGHTS_F2 = {"gravity": 0.40, "scope_duty_bearer": 0.25, "scope_protected_class": 0.25, "hierarchy": 0.10}
HIGH, MEDIUM = 2.5, 1.75
RATED_PARTS = 50


def points(c: str | Column) -> Column:
    """3, 2 or 1; null for any other value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1)


def rating(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def weighted(weights: dict[str, float], default: int | None = None, required: tuple[str, ...] = ()) -> Column:
    """A weighted sum of points; a missing dimension makes it null, or counts as ``default`` unless it is required."""
    own = lambda d: points(d) if default is None or d in required else F.coalesce(points(d), F.lit(default))
    return F.round(reduce(add, (own(d) * F.lit(w) for d, w in weights.items())), 6)


def mean(dimensions: tuple[str, ...]) -> Column:
    return F.round(reduce(add, (points(d) for d in dimensions)) / len(dimensions), 6)


def stored_score() -> Column:
    """The weighted score as the store backfills it: gravity and hierarchy are required, other missing dimensions count as LOW."""
    return weighted(WEIGHTS_B, 1, ("gravity", "hierarchy"))


def _complete() -> Column:
    return reduce(lambda a, b: a & b, (points(d).isNotNull() for d in DIMENSIONS))


def gravity_first() -> Column:
    others_low = reduce(lambda a, b: a & b, (F.col(d) == "LOW" for d in DIMENSIONS))
    return F.when(_complete(), F.when(F.col("gravity") == "HIGH", "HIGH").when(others_low, "LOW").otherwise("MEDIUM"))


def greatest() -> Column:
    top = F.greatest(*(points(d) for d in DIMENSIONS))
    return F.when(_complete(), F.when(top == 3, "HIGH").when(top == 2, "MEDIUM").otherwise("LOW"))


def scope_gated() -> Column:
    sdb, spc = points("scope_duty_bearer"), points("scope_protected_class")
    high = (F.col("gravity") == "HIGH") & ((sdb >= 2) | (spc >= 2))
    low = (F.col("gravity") == "LOW") & (sdb <= 1) & (spc <= 1)
    return F.when(_complete(), F.when(high, "HIGH").when(low, "LOW").otherwise("MEDIUM"))


#: Ratings of a provision, by the letter of the approach.
PROVISION = {
    "a": lambda: rating(mean(DIMENSIONS)),
    "b": lambda: rating(weighted(WEIGHTS_B)),
    "b_stored": lambda: rating(stored_score()),
    "c": gravity_first,
    "d": greatest,
    "e": scope_gated,
    "f": lambda: rating(mean(("scope_duty_bearer", "scope_protected_class", "gravity", "hierarchy"))),
    "f2": lambda: rating(weighted(WEIGHTS_F2)),
}


def provision_ratings(df: DataFrame) -> DataFrame:
    """The table with one rating column for each approach, ``rating_a`` and so on."""
    return df.withColumns({f"rating_{k}": f() for k, f in PROVISION.items()})


def law_profile(df: DataFrame, law: str = "law_name", overall: str = "rating") -> DataFrame:
    """(law, n_rated, n_high, n_medium, n_low, mean_score) over rated provisions."""
    score = points(overall)
    return (
        df.where(score.isNotNull())
        .groupBy(law)
        .agg(F.count("*").alias("n_rated"), F.count_if(score == 3).alias("n_high"), F.count_if(score == 2).alias("n_medium"), F.count_if(score == 1).alias("n_low"), F.round(F.avg(score), 6).alias("mean_score"))
    )


def law_ratings(profile: DataFrame) -> DataFrame:
    """Ratings of laws from their profile that need no ranking: greatest provision, share of HIGH, mean, and the profile itself."""
    share = F.col("n_high") / F.col("n_rated")
    return profile.select(
        *profile.columns,
        F.when(F.col("n_high") > 0, "HIGH").when(F.col("n_medium") > 0, "MEDIUM").otherwise("LOW").alias("rating_g"),
        F.when(share >= 0.5, "HIGH").when(share >= 0.2, "MEDIUM").otherwise("LOW").alias("rating_i"),
        rating(F.col("mean_score")).alias("rating_j"),
        F.concat_ws("/", "n_high", "n_medium", "n_low").alias("profile_k"),
    )


#: Scores by which laws are ranked.
RANKED = {
    "h": lambda: F.col("n_high").cast("double"),
    "l": lambda: F.round(F.col("mean_score") * F.log2(F.col("n_rated") + 1), 6),
    "l1": lambda: F.round(0.6 * F.col("mean_score") + 0.4 * F.log2(F.col("n_rated") + 1) / 3.3, 6),
    "l2": lambda: F.round(F.col("n_high") * F.col("n_high") / F.col("n_rated"), 6),
}


def ranked_laws(profile: DataFrame, approach: str, law: str = "law_name") -> DataFrame:
    """(law, score, rank, rating): the first 20 % HIGH, from 67 % on LOW."""
    return rate_by_rank(profile.select(law, RANKED[approach]().alias("score")), "score", law)


def parts(df: DataFrame, law: str = "law_name", least: int = RATED_PARTS) -> DataFrame:
    """(law, part, n_rated, n_high, n_medium, n_low) of laws with enough rated provisions.

    A provision belongs to the last row of type ``part`` before it; those before the first part have a null part.
    """
    own = preceding(df, [law], ["sort_key"], F.when(F.col("section_type") == "part", F.col("section_id")), "part")
    rated = own.where((F.col("section_type") != "part") & points("rating").isNotNull())
    large = rated.groupBy(law).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(law)
    return (
        rated.join(large, law, "left_semi")
        .groupBy(law, "part")
        .agg(F.count("*").alias("n_rated"), F.count_if(F.col("rating") == "HIGH").alias("n_high"), F.count_if(F.col("rating") == "MEDIUM").alias("n_medium"), F.count_if(F.col("rating") == "LOW").alias("n_low"))
    )


def quartile_breakdown(df: DataFrame, law: str = "law_name", number: str = "number", least: int = 50) -> DataFrame:
    """(law, quarter, n, n_high): how a large law's ratings lie in the quarters of its section numbers."""
    large = df.groupBy(law).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(law)
    return quarters(df.join(large, law, "left_semi"), law, number).groupBy(law, "quarter").agg(F.count("*").alias("n"), F.count_if(F.col("rating") == "HIGH").alias("n_high"))
