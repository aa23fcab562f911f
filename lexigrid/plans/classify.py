"""Families, subjects and positions by embeddings: centroids, statuses and the features of a linear classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.ranking import dot

# The kinds that a position's features name.
TYPES = ("Obligation", "Liberty", "none")
CATEGORIES = ("Org", "Gvt", "Ind", "SC", "Spc", "Svc", "Public", "EU", "Offshore", "other")
SECTIONS = ("section", "article", "regulation", "paragraph", "schedule", "part", "chapter", "heading", "table", "other")


def normalised(vector: str | Column) -> Column:
    """The vector at length one; a vector of noughts stays."""
    v = F.col(vector) if isinstance(vector, str) else vector
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def classify(vectors: DataFrame, centroids: DataFrame, ident: str, vector: str = "embedding", kinds: tuple[str, ...] = ("family",), least: float = 0.3) -> DataFrame:
    """(ident, family, similarity, others): the best family of each vector, and all other kinds' labels of at least ``least``, descending.

    ``centroids``: (kind, label, centroid), as many as there are labels. They are gathered into one array that goes along with
    every vector, so no vector meets a centroid by a join.
    """
    named = centroids.select(F.struct("kind", "label", normalised("centroid").alias("c")).alias("x"))
    every = named.agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["label"] < b["label"], -1).otherwise(1)).alias("_all"))  # one row of labels
    rows = vectors.select(ident, normalised(vector).alias("_v")).where(F.col("_v").isNotNull()).join(F.broadcast(every))
    scored = F.transform("_all", lambda x: F.struct(F.round(dot(F.col("_v"), x["c"]), 6).alias("s"), x["kind"].alias("kind"), x["label"].alias("label")))
    ranked = F.array_sort(scored, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["label"] < b["label"], -1).otherwise(1))
    rows = rows.withColumn("_r", ranked)
    best = F.get(F.filter("_r", lambda x: x["kind"].isin(*kinds)), F.lit(0))
    others = F.transform(F.filter("_r", lambda x: ~x["kind"].isin(*kinds) & (x["s"] >= least)), lambda x: x["label"])
    return rows.select(ident, best["label"].alias("family"), best["s"].alias("similarity"), others.alias("others"))


def status(given: str | Column, predicted: str | Column) -> Column:
    """predicted where no label was given, confirmed where it agrees, else conflict; null without a prediction."""
    given, predicted = (F.col(x) if isinstance(x, str) else x for x in (given, predicted))
    return F.when(predicted.isNull(), None).when(given.isNull() | (given == ""), "predicted").when(given == predicted, "confirmed").otherwise("conflict")


def written_back(laws: DataFrame, found: DataFrame, key: str, given: str) -> DataFrame:
    """Laws with family_predicted, family_similarity and family_status of what was found; what they had stays where nothing was."""
    new = found.select(key, F.col("family").alias("_f"), F.col("similarity").alias("_s"))
    joined = laws.join(new, key, "left")
    return joined.select(*laws.columns, F.col("_f").alias("family_predicted"), F.col("_s").alias("family_similarity"), status(given, "_f").alias("family_status"))


def one_hot(value: Column, names: tuple[str, ...]) -> Column:
    return F.array(*(F.when(F.coalesce(value == n, F.lit(False)), 1.0).otherwise(0.0) for n in names))


def position_features(embedding: str, modal: str | Column, types: str, label: str, offset: str, parse: str | None = None, section: str | None = None) -> Column:
    """Features of an actor in a provision: embedding, 13 modal ones, types, the actor's category, its place; 17 more with a parse.

    With 384 dimensions they are 411, or 428. Of a label without a category, or with an unknown one, all or the last are nought.
    """
    category = F.when(F.col(label).contains(":"), F.trim(F.split_part(label, F.lit(":"), F.lit(1)))).otherwise("other")
    kinds = F.array(*(F.when(F.array_contains(types, t), 1.0).otherwise(0.0) for t in TYPES))
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    parts = [double(embedding), modal if isinstance(modal, Column) else F.col(modal), kinds, one_hot(category, CATEGORIES), F.array(F.col(offset).cast("double"))]
    if parse:
        parts += [double(parse), one_hot(F.coalesce(section, F.lit("other")) if section else F.lit("other"), SECTIONS)]
    return F.concat(*parts)


def label_sets(df: DataFrame, *columns: str) -> DataFrame:
    """(column_name, n_labelled, n_labels) of each label column."""
    out = None
    for c in columns:
        one = df.agg(F.count(c).alias("n_labelled"), F.count_distinct(c).alias("n_labels")).select(F.lit(c).alias("column_name"), "n_labelled", "n_labels")
        out = one if out is None else out.unionByName(one)
    return out
