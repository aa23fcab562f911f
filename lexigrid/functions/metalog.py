"""Metalog distributions and seeded trials, as column expressions where they can be."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of bounds: none, a lower one, an upper one, both.
UNBOUNDED, LOWER, UPPER, BOUNDED = "unbounded", "lower", "upper", "bounded"
LOGIT_90 = math.log(9.0)
CHECKS, BISECTIONS = 200, 60


def _c(x: str | float | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def to_line(x, kind, low, high) -> Column:
    """A value on the unbounded scale."""
    x, kind, low, high = map(_c, (x, kind, low, high))
    return F.when(kind == LOWER, F.ln(x - low)).when(kind == UPPER, -F.ln(high - x)).when(kind == BOUNDED, F.ln((x - low) / (high - x))).otherwise(x)


def from_line(z, kind, low, high) -> Column:
    z, kind, low, high = map(_c, (z, kind, low, high))
    return F.when(kind == LOWER, low + F.exp(z)).when(kind == UPPER, high - F.exp(-z)).when(kind == BOUNDED, (low + high * F.exp(z)) / (1 + F.exp(z))).otherwise(z)


def fit_triplet(p10, p50, p90, kind, low, high) -> Column:
    """Three coefficients from the 10th, 50th and 90th percentile, in closed form."""
    z10, z50, z90 = (to_line(p, kind, low, high) for p in (p10, p50, p90))
    return F.array(z50, (z90 - z10) / (2 * LOGIT_90), (z90 + z10 - 2 * z50) / (0.8 * LOGIT_90))


def basis(y: Column, k: int) -> list[Column]:
    """The first k metalog basis functions of a probability."""
    logit, d = F.ln(y / (1 - y)), y - 0.5
    out = [F.lit(1.0), logit, d * logit, d]
    for i in range(5, k + 1):
        power = F.pow(d, F.lit((i - 1) // 2))
        out.append(power if i % 2 else power * logit)
    return out[:k]


def quantile(y, coeffs: str | Column, kind, low, high, k: int = 3) -> Column:
    y, coeffs = _c(y), _c(coeffs)
    z = sum((F.get(coeffs, F.lit(i)) * g for i, g in enumerate(basis(y, k))), F.lit(0.0))
    return from_line(z, kind, low, high)


def slope(y: Column, coeffs: str | Column) -> Column:
    """The derivative of a three-term quantile function on the unbounded scale."""
    coeffs = _c(coeffs)
    rate = 1 / (y * (1 - y))
    return F.get(coeffs, F.lit(1)) * rate + F.get(coeffs, F.lit(2)) * ((y - 0.5) * rate + F.ln(y / (1 - y)))


def feasible(coeffs: str | Column) -> Column:
    """Whether a three-term quantile function rises at all inner points of a grid."""
    return F.forall(F.sequence(F.lit(1), F.lit(CHECKS - 1)), lambda i: slope(i / F.lit(float(CHECKS)), coeffs) > 0)


def cdf(x, coeffs, kind, low, high) -> Column:
    """The probability of at most x, by bisection of a three-term quantile function."""
    x = _c(x)
    least, most = F.lit(1e-15), F.lit(1 - 1e-15)
    start = F.struct(least.alias("a"), most.alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        below = quantile(mid, coeffs, kind, low, high) < x
        return F.struct(F.when(below, mid).otherwise(s["a"]).alias("a"), F.when(below, s["b"]).otherwise(mid).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve, lambda s: (s["a"] + s["b"]) / 2)
    return F.when(quantile(least, coeffs, kind, low, high) >= x, 0.0).when(quantile(most, coeffs, kind, low, high) <= x, 1.0).otherwise(found)


def fit_least_squares(p: np.ndarray, x: np.ndarray, k: int, kind: str = UNBOUNDED, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """k coefficients from pairs of probability and value, by least squares; raises ``ValueError`` on bad input."""
    if k < 2 or len(p) < k:
        raise ValueError("a fit needs two terms and as many points as terms")
    if ((p <= 0) | (p >= 1)).any() or (np.diff(p) <= 0).any():
        raise ValueError("probabilities must rise between nought and one")
    if kind == BOUNDED and low >= high:
        raise ValueError("the lower bound must lie below the upper one")
    z = {LOWER: lambda: np.log(x - low), UPPER: lambda: -np.log(high - x), BOUNDED: lambda: np.log((x - low) / (high - x))}.get(kind, lambda: x)()
    logit, d = np.log(p / (1 - p)), p - 0.5
    columns = [np.ones_like(p), logit, d * logit, d] + [d ** ((i - 1) // 2) * (1 if i % 2 else logit) for i in range(5, k + 1)]
    return np.linalg.lstsq(np.stack(columns[:k], axis=1), z, rcond=None)[0]


def fitted(df: DataFrame, by: str, p: str, x: str, k: int, kind: str = UNBOUNDED, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(by, coeffs) of k terms fitted by least squares to each group's pairs of probability and value; null where a fit can't be made.

    That is with fewer pairs than terms, a probability that repeats or is not between nought and one, or a value beyond its
    bounds. Pairs with a null are left out. A group is summed up to k x (k + 1) numbers before it is shuffled, however large it
    is, and only these are solved in Arrow batches.
    """
    if k < 2 or (kind == BOUNDED and low >= high):
        raise ValueError("a fit needs two terms, and a lower bound below the upper one")
    given = {LOWER: F.col("_x") > low, UPPER: F.col("_x") < high, BOUNDED: (F.col("_x") > low) & (F.col("_x") < high)}.get(kind, F.lit(True))
    right = (F.col("_p") > 0) & (F.col("_p") < 1) & given
    pairs = df.select(F.col(by).alias("_by"), F.col(p).cast("double").alias("_p"), F.col(x).cast("double").alias("_x")).where("_p IS NOT NULL AND _x IS NOT NULL")
    pairs = pairs.withColumn("_bad", ~right).withColumn("_z", F.when(right, to_line("_x", F.lit(kind), low, high)))
    terms = [F.when(right, g) for g in basis(F.col("_p"), k)]
    pairs = pairs.withColumns({f"_g{i}": g for i, g in enumerate(terms)})
    squares = F.array(*(F.sum(F.col(f"_g{i}") * F.col(f"_g{j}")) for i in range(k) for j in range(k)))
    products = F.array(*(F.sum(F.col(f"_g{i}") * F.col("_z")) for i in range(k)))
    bad = (F.count("*") < k) | F.max("_bad") | (F.count_distinct("_p") < F.count("*"))
    sums = pairs.groupBy("_by").agg(squares.alias("squares"), products.alias("products"), bad.alias("bad"))

    def solve(squares: pd.Series, products: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.reshape(s, (k, k)), np.array(z), rcond=None)[0].tolist() for s, z in zip(squares, products)])

    solved = F.pandas_udf(solve, "array<double>")("squares", "products")
    good = sums.where("NOT bad").select(F.col("_by").alias(by), solved.alias("coeffs"))
    return good.unionByName(sums.where("bad").select(F.col("_by").alias(by), F.lit(None).cast("array<double>").alias("coeffs")))


# The increments and multipliers of the seeded generator.
_GOLDEN, _VARIABLE, _THIRD, _FOURTH = 0x9E3779B97F4A7C15, 0x6C62272E07BB0142, 0x94D049BB133111EB, 0x5555555555555555
_MIX_1, _MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _stir(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(_GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX_2)
    return x ^ (x >> np.uint64(31))


def uniforms(counter: np.ndarray, entity, variable, third=0, fourth=0) -> np.ndarray:
    """Numbers in (0, 1) that depend only on the trial's number and four seeds, so that any trial can be drawn alone."""
    u = lambda v, m: np.asarray(v, np.uint64) * np.uint64(m)
    with np.errstate(over="ignore"):
        h = _stir(np.asarray(counter, np.uint64) + u(entity, _GOLDEN))
        h = _stir(h + u(variable, _VARIABLE))
        h = _stir(h + u(third, _THIRD) + u(fourth, _FOURTH))
    return ((h >> np.uint64(11)) | np.uint64(1)).astype(np.float64) / float(1 << 53)


def uniform(counter: Column, entity: Column, variable: Column) -> Column:
    """A column of seeded uniform numbers; wrapping 64-bit arithmetic needs numpy, so it runs in Arrow batches."""

    def draw(c: pd.Series, e: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(uniforms(c.to_numpy(), e.to_numpy(), v.to_numpy()))

    return F.pandas_udf(draw, "double")(counter, entity, variable)


def trials(spark: SparkSession, n: int, entity: int = 1, variable: int = 1) -> DataFrame:
    """(trial, u) of n seeded trials; a trial's number does not depend on how they are dealt to tasks."""
    return spark.range(1, n + 1).select(F.col("id").alias("trial"), uniform(F.col("id"), F.lit(entity), F.lit(variable)).alias("u"))


def mitigated(severity: str, effects: str) -> Column:
    """A severity after a list of effectivenesses, each of which takes its share away."""
    return F.aggregate(effects, F.col(severity), lambda s, e: s * (1 - e))


def gated(u, p_active, effect) -> Column:
    """An effectiveness that counts only where its control is active."""
    return F.when(_c(u) < _c(p_active), _c(effect)).otherwise(0.0)


def exceedance(df: DataFrame, column: str, threshold: float, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(column) >= threshold).cast("int")).alias("p_exceed"))


def summary(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Mean, exact interpolated percentiles, minimum and maximum."""
    p = lambda q: F.percentile(column, q)
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.min(column).alias("least"), F.max(column).alias("greatest"))


LIBRARY = "struct<name:string,coeffs:array<double>,kind:string,low:double,high:double,entity:bigint,variable:bigint>"


def to_library(df: DataFrame) -> DataFrame:
    """One JSON object for each distribution: coefficients, bounds and seeds in place of its trials."""
    return df.select(F.to_json(F.struct("name", "coeffs", "kind", "low", "high", "entity", "variable")).alias("json"))


def from_library(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("json", LIBRARY).alias("d")).select("d.*")
