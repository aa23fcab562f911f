"""Aggregations: grouped counts, lists and sets, ladders, confusion matrices, vector means and term frequencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def group_counts(df: DataFrame, key: str) -> DataFrame:
    """Counts by key, most first; equal counts by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def span(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("least"), F.max(column).alias("greatest"))


def count_where(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """For each group a count of rows that meet each condition."""
    return df.groupBy(*by).agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def quantiles(df: DataFrame, column: str, *p: float) -> DataFrame:
    """Exact interpolated quantiles, mean and minimum of a column."""
    return df.agg(*(F.percentile(column, x).alias(f"p{round(x * 100):02d}") for x in p), F.avg(column).alias("mean"), F.min(column).alias("least"))


def matched_share(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of the left table the right one has."""
    keys = left.select(key).distinct().join(right.select(F.col(key)).distinct().withColumn("_there", F.lit(1)), key, "left")
    return keys.agg(F.count("_there").alias("n_matched"), F.count("*").alias("n_all"))


def json_lists(df: DataFrame, by: str, columns: list[str], name: str) -> DataFrame:
    """One JSON array of objects for each group, sorted; null fields are written."""
    return df.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns))), {"ignoreNullFields": "false"}).alias(name))


def sets(df: DataFrame, by: str, **columns: str) -> DataFrame:
    """Sorted sets of columns' values for each group, nulls left out."""
    return df.groupBy(by).agg(*(F.array_sort(F.collect_set(c)).alias(name) for name, c in columns.items()))


def ladder(df: DataFrame, by: str, name: str, *rungs: tuple[str, Column], otherwise: str | None = None) -> DataFrame:
    """For each group the first rung that any of its rows meets."""
    best = F.lit(otherwise)
    for label, condition in reversed(rungs):
        best = F.when(F.bool_or(condition), label).otherwise(best)
    return df.groupBy(by).agg(best.alias(name))


def most_frequent(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group; the smallest of several."""
    n = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("value"))).alias(value), F.max("n").alias("n"))


def content_hash(columns: list[str]) -> Column:
    """A hash of list columns that does not depend on their order."""
    return F.sha2(F.to_json(F.struct(*(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in columns))), 256)


def mean_vectors(df: DataFrame, by: str, vector: str, unit: bool = True) -> DataFrame:
    """(by, vector) means of vectors, scaled to unit length; averaged place by place, so no group is gathered."""
    places = df.select(by, F.posexplode(vector).alias("_at", "_x"))
    means = places.groupBy(by, "_at").agg(F.avg("_x").alias("_x"))
    whole = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(vector))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return whole.withColumn(vector, F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.col(vector))) if unit else whole


def centroids(vectors: DataFrame, labels: DataFrame, key: str, label: str, vector: str = "embedding", excluded: list[str] | None = None) -> DataFrame:
    """Mean unit vectors of each label; a list of labels counts for each of its members, excluded ones for none."""
    own = labels.select(key, F.explode(label).alias(label)) if dict(labels.dtypes)[label].startswith("array") else labels.select(key, label)
    own = own.where(F.col(label).isNotNull() & (F.col(label) != "")) if dict(own.dtypes)[label] == "string" else own.where(F.col(label).isNotNull())
    if excluded:
        own = own.where(~F.col(label).isin(excluded))
    return mean_vectors(vectors.join(own, key), label, vector)


def _run(k: int):
    return lambda i: F.slice("_w", i, k)


def terms(df: DataFrame, text: str, known: list[str] = (), stop: list[str] = (), most: int = 3, least: int = 2) -> DataFrame:
    """(term, n) of runs of one to ``most`` words that come ``least`` times: no stop word at either end, no known term."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9\-]+"), lambda w: w != "")
    bare = df.select(words.alias("_w"))
    runs = [F.when(F.size("_w") >= k, F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), _run(k))).otherwise(F.array().cast("array<array<string>>")) for k in range(1, most + 1)]
    each = bare.select(F.explode(F.concat(*runs)).alias("_t"))
    ends = lambda k: F.coalesce(F.try_element_at("_t", F.lit(k)).isin(list(stop)), F.lit(True)) if stop else F.lit(False)
    each = each.where(~ends(1) & ~ends(-1)).select(F.array_join("_t", " ").alias("term"))
    if known:
        each = each.where(~F.col("term").isin(list(known)))
    return each.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, gold: str, tiers: list[str]) -> DataFrame:
    """(tier, n, n_right, accuracy) of each tier's column against the gold one; rows without a prediction are left out."""
    pairs = df.select(gold, F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.col(t).alias("predicted")) for t in tiers))).alias("_p")).select(gold, "_p.*")
    pairs = pairs.where(F.col("predicted").isNotNull() & F.col(gold).isNotNull())
    return pairs.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col("predicted")).alias("n_right"), F.round(F.avg((F.col(gold) == F.col("predicted")).cast("int")), 6).alias("accuracy"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys of more than one row, and how many rows they have."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, n, n_null, n_distinct) of every column.

    Exact counts of distinct values are made column by column, so that no row is multiplied by the number of columns; otherwise
    they are estimated, all in one pass.
    """
    if not exact:
        sums = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.approx_count_distinct(c).alias("n_distinct")) for c in df.columns]
        return df.agg(F.array(*sums).alias("_all")).select(F.inline("_all"))
    each = [df.agg(F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(c).alias("n_distinct")).select(F.lit(c).alias("column_name"), "n", "n_null", "n_distinct") for c in df.columns]
    return reduce(DataFrame.unionByName, each)


def share_anomalies(df: DataFrame, group: str, value: str, times: float = 2.0) -> DataFrame:
    """(group, value, share, corpus_share) where a value's share in a group exceeds ``times`` its share in the corpus."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    own = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    total = df.agg(F.count("*").alias("_total"))
    corpus = df.groupBy(value).agg(F.count("*").alias("_m")).join(F.broadcast(total)).select(value, (F.col("_m") / F.col("_total")).alias("corpus_share"))
    return own.join(corpus, value).where(F.col("share") > times * F.col("corpus_share")).select(group, value, "share", "corpus_share")
