"""Statistics of cultural edges in safety narratives: composites, standardised ratios, shrinkage, discovery rates and drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.metalog import uniforms
from lexigrid.functions.taxa import let
from lexigrid.operators.ranking import value_ranks

# The edge types of each composite, and the deviations that are flagged.
COMPOSITES = {
    "voice": ("speaks-up-to", "cooperates-with", "shares-information-with"),
    "leadership": ("directs", "monitors"),
    "drift": ("normalises", "adapts-to"),
    "care": ("cares-for", "responds-to-failure-of", "protects"),
    "growth": ("learns-from", "recognises"),
}
LOW, HIGH = 0.7, 1.3
Z, CHI2_TWO_DF = 1.959963984540054, 7.377758908227871  # for a level of 0.05
LEAST_TYPE, LEAST_CELL, DRIFT_Z = 50, 3, 2.0


def composite_counts(edges: DataFrame, by: list[str], composites: dict[str, tuple[str, ...]] = COMPOSITES, kind: str = "edge_type") -> DataFrame:
    """For each group one count for each composite."""
    return edges.groupBy(*by).agg(*(F.count_if(F.col(kind).isin(*types)).alias(name) for name, types in composites.items()))


def standardised(narratives: DataFrame, site: str, kind: str, flag: str, n: str, least: int = LEAST_TYPE) -> DataFrame:
    """(site, prevalence, intensity): means over report types with equal weights, of types with enough narratives overall."""
    large = narratives.groupBy(kind).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(kind)
    cells = narratives.join(large, kind, "left_semi").groupBy(site, kind).agg(F.avg(F.col(flag).cast("double")).alias("p"), F.avg(n).alias("i"))
    return cells.groupBy(site).agg(F.round(F.avg("p"), 6).alias("prevalence"), F.round(F.avg("i"), 6).alias("intensity"))


def ratios(cells: DataFrame, site: str, kind: str) -> DataFrame:
    """(site, observed, expected, smr) by indirect standardisation of cells (site, kind, n, observed): rates of each kind in the corpus."""
    base = cells.groupBy(kind).agg((F.sum("observed") / F.sum("n")).alias("_rate"))
    return cells.join(base, kind).groupBy(site).agg(F.sum("observed").alias("observed"), F.sum(F.col("n") * F.col("_rate")).alias("expected")).withColumn("smr", F.try_divide("observed", "expected"))


def overdispersion(cells: DataFrame, site: str, kind: str, least: int = LEAST_CELL) -> DataFrame:
    """(phi): Pearson's chi-square over its degrees of freedom, 1 without any; cells with enough rows count."""
    own = cells.where(F.col("n") >= least)
    base = own.groupBy(kind).agg((F.sum("observed") / F.sum("n")).alias("_rate"))
    fitted = F.col("n") * F.col("_rate")
    sums = own.join(base, kind).agg(F.sum(F.when(fitted > 0, (F.col("observed") - fitted) ** 2 / fitted)).alias("chi2"), (F.count("*") - F.count_distinct(kind)).alias("df"))
    return sums.select(F.when(F.col("df") > 0, F.col("chi2") / F.col("df")).otherwise(1.0).alias("phi"))


def interval(observed: str, expected: str, phi: str | float) -> list[Column]:
    """Bounds of a ratio on the log scale, widened by overdispersion; an exact upper bound where nothing was observed."""
    o, e = F.col(observed), F.col(expected)
    phi = F.col(phi) if isinstance(phi, str) else F.lit(float(phi))
    width = Z * F.sqrt(phi / o)
    low = F.when(e <= 0, None).when(o == 0, 0.0).otherwise(F.exp(F.ln(o / e) - width))
    high = F.when(e <= 0, None).when(o == 0, CHI2_TWO_DF / (2 * e)).otherwise(F.exp(F.ln(o / e) + width))
    return [low.alias("smr_low"), high.alias("smr_high")]


def shrunk(table: DataFrame) -> DataFrame:
    """Ratios drawn to their mean by a gamma prior from moments; as they are where fewer than three sites have expectations."""
    ok = table.where("expected > 0").withColumn("_r", F.col("observed") / F.col("expected"))
    m = ok.agg(F.count("*").alias("_n"), F.avg("_r").alias("_mean"), F.var_samp("_r").alias("_var"), F.avg(1 / F.col("expected")).alias("_noise"))
    spread = F.greatest(F.col("_var") - F.col("_noise"), 0.01 * F.col("_var"))
    a, b = F.col("_mean") ** 2 / spread, F.col("_mean") / spread
    joined = ok.join(F.broadcast(m))  # one row of moments
    return joined.withColumn("smr_shrunk", F.when(F.col("_n") < 3, F.col("_r")).otherwise((F.col("observed") + a) / (F.col("expected") + b))).drop("_n", "_mean", "_var", "_noise", "_r")


def discoveries(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Tests with ``rejected`` by Benjamini and Hochberg: all up to the last whose p is at most its rank's share of alpha."""
    rows = value_ranks(tests, p)
    share = (F.col("_below") + F.col("_same")) / F.col("_n") * alpha
    cut = rows.agg(F.max(F.when(F.col(p) <= share, F.col(p))).alias("_cut"))  # one row
    rejected = F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))
    return rows.join(F.broadcast(cut)).withColumn("rejected", rejected).drop("_cut", "_below", "_same", "_n")


def flags(value: str | Column, mean: str | Column) -> Column:
    value, mean = (F.col(x) if isinstance(x, str) else x for x in (value, mean))
    return F.when(value < mean * LOW, "LOW").when(value > mean * HIGH, "HIGH").otherwise("")


def edge_pivot(edges: DataFrame, by: list[str], types: list[str], kind: str = "edge_type") -> DataFrame:
    """One count for each edge type; the types are named, so the table is read once."""
    return edges.groupBy(*by).agg(*(F.count_if(F.col(kind) == t).alias(t.replace("-", "_")) for t in types))


def batch_drift(narratives: DataFrame, when: str, edges: str, guarded: bool = True) -> DataFrame:
    """(batch, n, rate, z, drifted): edges for each narrative by date, against the spread of all dates' rates; the rate is rounded before.

    Spread is that of a sample beyond two dates, of a population for two, and missing for one; without any, nothing has drifted.
    If not ``guarded``, z is SQL's plain quotient by the sample's spread: missing for one date, and no number where all rates are
    equal, which counts as more than any and so as drifted.
    """
    mean = F.avg(edges)
    rate = F.signum(mean) * F.floor(F.abs(mean) * 1000 + 0.5) / 1000  # halves of the double, as SQL rounds, and not of its decimal digits
    rates = narratives.groupBy(F.to_date(when).alias("batch")).agg(F.count("*").alias("n"), rate.alias("rate"))
    every = Window.partitionBy()
    k, off, spread = F.count("*").over(every), F.col("rate") - F.avg("rate").over(every), F.stddev_samp("rate").over(every)
    if not guarded:
        without = F.when(off == 0, math.nan).when(off > 0, math.inf).when(off < 0, -math.inf)
        z = F.round(F.when(spread == 0, without).otherwise(off / F.nullif(spread, F.lit(0.0))), 6)
        return rates.select("*", z.alias("z")).withColumn("drifted", F.abs("z") > DRIFT_Z)
    spread = F.when(k > 2, spread).when(k == 2, F.stddev_pop("rate").over(every))
    z = F.when(spread > 0, off / spread)
    return rates.withColumn("z", F.round(z, 6)).withColumn("drifted", F.coalesce(F.abs("z") > DRIFT_Z, F.lit(False)))


def detectable(sites: DataFrame, expected: str, alpha_prior: float, phi: float) -> DataFrame:
    """Sites with ``smr_low`` and ``smr_high``: the ratios that a site of its size can tell from one."""
    width = Z * F.sqrt(phi / (F.col(expected) + alpha_prior))
    return sites.withColumn("smr_low", F.exp(-width)).withColumn("smr_high", F.exp(width))


# What is changed to see whether flags depend on it: (name, factor of phi, of the baseline, least n, factor of the prior).
SCENARIOS = (
    ("phi x0.8", 0.8, 1.0, 10, 1.0),
    ("phi x1.2", 1.2, 1.0, 10, 1.0),
    ("baseline +5%", 1.0, 1.05, 10, 1.0),
    ("baseline -5%", 1.0, 0.95, 10, 1.0),
    ("baseline +10%", 1.0, 1.10, 10, 1.0),
    ("baseline -10%", 1.0, 0.90, 10, 1.0),
    ("n>=5", 1.0, 1.0, 5, 1.0),
    ("n>=20", 1.0, 1.0, 20, 1.0),
    ("prior x0.5", 1.0, 1.0, 10, 0.5),
    ("prior x2.0", 1.0, 1.0, 10, 2.0),
)


def sensitivity(sites: DataFrame, site: str, phi: float, alpha: float, beta: float, scenarios=SCENARIOS) -> DataFrame:
    """(name, n_flags, n_gained, n_lost, n_stable) of sites (site, n, observed, expected) under each change of assumptions.

    A site is flagged where the interval of its shrunken ratio leaves one out. All scenarios are one small table that the
    sites are joined with, so the sites are read once.
    """
    grid = sites.sparkSession.createDataFrame([("base", 1.0, 1.0, 10, 1.0), *scenarios], "name string, f_phi double, f_base double, least int, f_prior double")
    a, e = alpha * F.col("f_prior"), F.col("expected") * F.col("f_base")
    ratio = (F.col("observed") + a) / (e + beta * F.col("f_prior"))
    width = Z * F.sqrt(phi * F.col("f_phi") / (F.col("observed") + a))
    flag = (F.col("observed") > 0) & ((ratio * F.exp(-width) > 1) | (ratio * F.exp(width) < 1)) & (F.col("n") >= F.col("least"))
    each = sites.join(F.broadcast(grid)).select(site, "name", F.coalesce(flag, F.lit(False)).alias("flag"))  # eleven rows for each site
    base = each.where("name = 'base'").select(site, F.col("flag").alias("was"))
    both = each.where("name <> 'base'").join(base, site)
    return both.groupBy("name").agg(F.count_if("flag").alias("n_flags"), F.count_if(F.expr("flag and not was")).alias("n_gained"), F.count_if(F.expr("was and not flag")).alias("n_lost"), F.count_if(F.expr("flag and was")).alias("n_stable"))


EXTRACTION = "struct<entities:array<struct<text:string,type:string>>,relationships:array<struct<source:string,target:string,edge_type:string,detail:string>>>"


def flattened(records: DataFrame, edge_names: dict[str, str], edge_types: list[str], entity_names: dict[str, str], entity_types: list[str], json: str = "extraction") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Narratives, entities and edges of extracted records (id, valid, extraction JSON).

    Edges get their canonical names, and those of no known type are dropped; entities of no known type are ``unknown``. Records
    that are not valid count for nothing.
    """
    named = lambda names, x, other: F.coalesce(F.create_map(*(F.lit(v) for pair in names.items() for v in pair))[x], F.when(x.isin(*other), x)) if names else F.when(x.isin(*other), x)
    rows = records.where("valid").withColumn("x", F.from_json(json, EXTRACTION)).drop(json)
    ents, rels = F.coalesce("x.entities", F.array().cast("array<struct<text:string,type:string>>")), F.col("x.relationships")
    entities = rows.select("id", F.inline("x.entities")).select("id", "text", F.coalesce(named(entity_names, F.col("type"), entity_types), F.lit("unknown")).alias("type"))
    edges = rows.select("id", F.inline(rels)).withColumn("edge_type", named(edge_names, F.col("edge_type"), edge_types)).where(F.col("edge_type").isNotNull())
    edges = edges.withColumn("is_cultural", F.col("edge_type") != "operational")
    kept = F.filter(F.transform(rels, lambda r: named(edge_names, r["edge_type"], edge_types)), lambda t: t.isNotNull())
    n = lambda cultural: F.coalesce(F.size(F.filter(kept, lambda t: (t != "operational") == cultural)), F.lit(0))
    narratives = rows.select("id", F.size(ents).alias("n_entities"), n(True).alias("n_cultural"), n(False).alias("n_operational"))
    return narratives, entities, edges


def tracker(now: DataFrame, before: DataFrame, site: str, value: str) -> DataFrame:
    """(site, now, before, change, status) of a value in the latest batch and in the snapshot kept: new, gone, up, down or same."""
    joined = now.select(site, F.col(value).alias("now")).join(before.select(site, F.col(value).alias("before")), site, "full")
    change = F.col("now") - F.col("before")
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(change > 0, "up").when(change < 0, "down").otherwise("same")
    return joined.withColumn("change", change).withColumn("status", status)


def trend(cells: DataFrame, by: str, time: str = "year", count: str = "observed", exposure: str = "n", steps: int = 50) -> DataFrame:
    """(by, slope, se, z, p) of a Poisson regression on time with exposure as offset, scaled by Pearson's chi-square; native.

    Cells are summed to one row for each group and time first, so a group's rows are as many as its times however many narratives
    it has; the steps of Newton's method run over these. Null where a group has fewer than three times or counts nothing; ``p``
    is that of both tails of a normal distribution, for ``discoveries``.
    """
    each = cells.where(F.col(exposure) > 0).groupBy(by, time).agg(F.sum(F.col(count).cast("double")).alias("y"), F.sum(F.col(exposure).cast("double")).alias("e"))
    groups = each.groupBy(by).agg(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), "y", "e")).alias("rows"), F.avg(F.col(time).cast("double")).alias("middle"), F.sum("y").alias("y"), F.sum("e").alias("e"), F.count("*").alias("n"))
    rows = F.transform("rows", lambda r: F.struct((r["t"] - F.col("middle")).alias("t"), r["y"].alias("y"), r["e"].alias("e")))
    fits = groups.where((F.col("n") >= 3) & (F.col("y") > 0))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    newton = lambda own: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair(F.log(F.col("y") / F.col("e")), F.lit(0.0)), lambda beta, _: _newton(own, beta))
    # What is named several times is bound, so that it is made once.
    fit = let(rows, lambda own: let(newton(own), lambda beta: let(_sums(own, beta), lambda s: _slope(s, beta, F.col("n")))))
    return groups.select(by).join(fits.select(by, fit.alias("fit")).select(by, "fit.*"), by, "left")


def _slope(s: Column, beta: Column, n: Column) -> Column:
    """struct<slope, se, z, p> of a fit."""
    scale = F.greatest(F.lit(1e-12), s["chi"] / F.greatest(F.lit(1), n - 2))
    error = F.sqrt(s["s0"] / (s["s0"] * s["s2"] - s["s1"] * s["s1"]) * scale)
    told = lambda se: let(F.when(se > 0, beta["b"] / se), lambda z: F.struct(beta["b"].alias("slope"), se.alias("se"), z.alias("z"), both_tails(z).alias("p")))
    return let(error, told)


def _sums(rows: Column, beta: Column) -> Column:
    """struct of what a step needs of the rows: sums of the means by powers of time, of the residuals, and Pearson's chi-square."""
    names = ("s0", "s1", "s2", "r0", "r1", "chi")

    def add(acc: Column, r: Column) -> Column:
        mu, left = r["m"], r["y"] - r["m"]
        more = (mu, mu * r["t"], mu * r["t"] * r["t"], left, left * r["t"], left * left / mu)
        return F.struct(*((acc[n] + x).alias(n) for n, x in zip(names, more, strict=True)))

    means = F.transform(rows, lambda r: F.struct(r["t"].alias("t"), r["y"].alias("y"), (r["e"] * F.exp(beta["a"] + beta["b"] * r["t"])).alias("m")))
    return F.aggregate(means, F.struct(*(F.lit(0.0).alias(n) for n in names)), add)


def _newton(rows: Column, beta: Column) -> Column:
    """The next level and slope."""

    def step(s: Column) -> Column:
        det = s["s0"] * s["s2"] - s["s1"] * s["s1"]
        return F.struct((beta["a"] + (s["s2"] * s["r0"] - s["s1"] * s["r1"]) / det).alias("a"), (beta["b"] + (s["s0"] * s["r1"] - s["s1"] * s["r0"]) / det).alias("b"))

    return F.get(F.transform(F.array(_sums(rows, beta)), step), F.lit(0))


def both_tails(z: Column) -> Column:
    """The chance that a standard normal value is further from nought, within 2e-7."""
    # A rational approximation of the error function (Abramowitz and Stegun, 7.1.26).
    powers = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)

    def tail(t: Column) -> Column:
        poly = F.lit(0.0)
        for c in reversed(powers):
            poly = (poly + c) * t
        return poly * F.exp(-x * x)

    return let(1 / (1 + 0.3275911 * x), tail)


def bootstrap(cells: DataFrame, by: str, value: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """(by, mean, low, high): a bootstrap interval of 95 % of the mean of a group's few cells."""

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        draws = np.random.default_rng(seed).choice(x, size=(n, len(x))).mean(axis=1)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [x.mean()], "low": [np.percentile(draws, 2.5)], "high": [np.percentile(draws, 97.5)]})

    kind = cells.schema[by].dataType.simpleString()
    return cells.select(by, F.col(value).cast("double").alias(value)).groupBy(by).applyInPandas(resample, f"{by} {kind}, mean double, low double, high double")


def bootstrap_large(rows: DataFrame, by: str, value: str, key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """(by, mean, low, high): a Poisson bootstrap interval of 95 % of the mean of groups of many rows.

    In each replicate a row counts as often as a Poisson number of mean one, drawn from the hash of its key, the seed and the
    replicate, so it is the same wherever the row lies and a group's sums are added up in parts. A batch hands on n rows for
    each of its groups. Rows without a value are left out; a replicate that draws no row does not count. Groups of a few rows
    are for ``bootstrap``.
    """
    at_most = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])  # of a Poisson number
    replicates = np.arange(n, dtype=np.uint64)[None, :]

    def draw(frames):
        for f in frames:
            codes, names = pd.factorize(f["_by"], use_na_sentinel=False)
            times, sums = np.zeros((len(names), n)), np.zeros((len(names), n))
            for start in range(0, len(f), 1000):
                part = slice(start, start + 1000)
                w = np.searchsorted(at_most, uniforms(replicates, f["_hash"].to_numpy()[part].view(np.uint64)[:, None], 0)).astype(float)
                np.add.at(times, codes[part], w)
                np.add.at(sums, codes[part], w * f["_x"].to_numpy()[part, None])
            for i, name in enumerate(names):
                yield pd.DataFrame({"_by": [None if pd.isna(name) else name] * n, "_r": np.arange(n), "_w": times[i], "_wx": sums[i]})

    kind = rows.schema[by].dataType.simpleString()
    own = rows.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_x"), F.xxhash64(key, F.lit(seed)).alias("_hash")).where("_x IS NOT NULL")
    drawn = own.mapInPandas(draw, f"_by {kind}, _r long, _w double, _wx double").groupBy("_by", "_r").agg((F.sum("_wx") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_mean"))
    ends = drawn.groupBy("_by").agg(F.percentile("_mean", [0.025, 0.975]).alias("_ends"))
    means = own.groupBy(F.col("_by").alias(by)).agg(F.avg("_x").alias("mean"))
    return means.join(ends, F.col(by).eqNullSafe(F.col("_by"))).select(by, "mean", F.get("_ends", F.lit(0)).alias("low"), F.get("_ends", F.lit(1)).alias("high"))
