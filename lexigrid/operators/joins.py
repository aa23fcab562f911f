"""Joins between laws, provisions, edges and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_edges(laws: DataFrame, edges: DataFrame) -> DataFrame:
    """Laws and the edges that start at them."""
    return laws.join(edges, laws["name"] == edges["source_name"])


def either_way(nodes: DataFrame, edges: DataFrame, node: str = "name") -> DataFrame:
    """Nodes and their edges in both directions: (node, edge's other end); two equi-joins in place of one with OR."""
    out = edges.select(F.col("source_name").alias(node), F.col("target_name").alias("other"))
    back = edges.select(F.col("target_name").alias(node), F.col("source_name").alias("other"))
    return nodes.join(out.unionByName(back), node)


def preceding(rows: DataFrame, group: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Each row with the last non-null value that stands strictly before it in its group."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, value: str, name: str) -> DataFrame:
    """Each left row with the value of the last right row of its group strictly before it; null if there is none.

    One sort of both tables' union instead of a lookup for each row; of right rows at one time the greatest value counts.
    """
    kept = left.columns
    rows = left.select(*kept, F.lit(0).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    marks = right.groupBy(group, at).agg(F.max(value).alias("_value")).select(group, at, F.lit(1).alias("_side"), "_value")
    both = rows.unionByName(marks, allowMissingColumns=True)
    # At one time left rows come first, so they do not see it.
    order = Window.partitionBy(group).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.last("_value", ignorenulls=True).over(order)).where("_side = 0").select(*kept, name)


def collected(left: DataFrame, key: str, lists: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left rows with one sorted list of structs from each other table; empty where a table has no row for the key."""
    for name, (df, columns) in lists.items():
        grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        left = left.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return left


def conflicts(terms: DataFrame, same: str, differs: str, source: str) -> DataFrame:
    """(term, meaning_a, meaning_b, sources_a, sources_b, source_a, source_b): pairs of different meanings of one term, each once.

    Sources are counted by term and meaning first, with the least of each, so a term that all sources use makes as many pairs as
    its meanings do, and not as its sources.
    """
    each = terms.where(F.col(same).isNotNull() & F.col(differs).isNotNull()).groupBy(same, differs).agg(F.countDistinct(source).alias("n"), F.min(source).alias("s"))
    a, b = each.alias("a"), each.alias("b")
    on = (F.col(f"a.{same}") == F.col(f"b.{same}")) & (F.col(f"a.{differs}") < F.col(f"b.{differs}"))
    pairs = [(differs, differs), ("n", "sources"), ("s", source)]
    return a.join(b, on).select(F.col(f"a.{same}").alias(same), *(F.col(f"{x}.{c}").alias(f"{name}_{x}") for c, name in pairs for x in "ab"))


def anti(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows without a partner; a null in the right table removes nothing."""
    return left.join(right.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def semi(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def with_default(left: DataFrame, lookup: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join with a lookup table, with defaults for the values it lacks."""
    out = left.join(lookup, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def best_match(left: DataFrame, right: DataFrame, key: str, score: Column, least: float, tie: str, ident: str, alone: bool = False) -> DataFrame:
    """For each left row the right row of its key with the highest score of at least ``least``; ties go to the smallest ``tie``.

    With ``alone`` the score reads nothing but the right row: then each key's best row is found first, and left rows meet only that
    one. A score of both rows needs all pairs of a key.
    """
    first = lambda df, by: df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_score"), tie))).where("_rank = 1").drop("_rank")
    scored = lambda df: df.withColumn("_score", score).where(F.col("_score") >= least)
    met = left.join(first(scored(right), key), key) if alone else scored(left.join(right, key))
    return first(met, ident).withColumnRenamed("_score", "score")


def update_from(target: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The target with columns taken from the source where it has the key, as it was elsewhere."""
    marked = source.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = target.join(marked, key, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def nearest_ancestor(rows: DataFrame, ancestors: DataFrame, group: str, path: str, value: str, name: str) -> DataFrame:
    """Each row with the value of its nearest ancestor by path (``a/b`` is above ``a/b/c``), null if none has one.

    Every row is exploded into the proper prefixes of its path, so the join is by equality.
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    wide = keyed.where(F.size(parts) > 1).select("_row", group, F.posexplode(prefixes).alias("_depth", "_above"))
    found = wide.join(ancestors.where(F.col(value).isNotNull()).select(group, F.col(path).alias("_above"), F.col(value).alias("_value")), [group, "_above"])
    best = found.groupBy("_row").agg(F.max_by("_value", "_depth").alias(name))
    return keyed.join(best, "_row", "left").drop("_row")
