"""Updates, merges and deletes as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key the new table lacks, and all new rows, in the old table's columns."""
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(new.select(*(c for c in old.columns if c in new.columns)), allowMissingColumns=True).select(old.columns)


def merge(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], insert: bool = True, skip_nulls: bool = False) -> DataFrame:
    """Matched rows take ``columns`` from the new table (nulls keep the old value if asked so); unmatched new rows are inserted if asked."""
    given = new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(given, key, "full" if insert else "left")
    take = lambda c: F.coalesce(f"_n_{c}", c) if skip_nulls else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select(*(take(c).alias(c) if c in columns else F.col(c) for c in old.columns))


def merge_renamed(old: DataFrame, new: DataFrame, key: str, whitelist: list[str], renames: dict[str, str]) -> DataFrame:
    """A merge of whitelisted columns that skips nulls, after the new table's columns got the old one's names."""
    named = new.withColumnsRenamed({a: b for a, b in renames.items() if a in new.columns})
    return merge(old, named, [key], [c for c in whitelist if c in named.columns and c in old.columns], insert=False, skip_nulls=True)


def clear_inferred(actors: DataFrame, inferred: list[str], signals: list[str], condition: Column) -> DataFrame:
    """Clears the inferred columns of chosen rows, then drops those of them without any of the ``signals``.

    Rows that only a tier outside ``signals`` supports are dropped, too: the tier list decides, not the presence of any value.
    """
    cleared = actors.withColumns({c: F.when(condition, F.lit(None)).otherwise(F.col(c)).cast(actors.schema[c].dataType) for c in inferred})
    return cleared.where(~condition | F.coalesce(*(F.col(c).cast("string") for c in signals)).isNotNull())


def delete(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and how many go (one row, n_deleted); a second delete finds none."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value))), df.where(F.col(column) == value).agg(F.count("*").alias("n_deleted"))


def flag(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns of rows that meet a condition."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


# How far each source of a classification is trusted.
TIERS = {"adjudicated": 7, "agentic": 6, "agentic_unvalidated": 5, "classifier": 4, "local": 3, "local_unvalidated": 3, "inherited": 2, "regex": 1}


def tier(column: str) -> Column:
    """The rank of a source; unknown ones and null have 0."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))[F.col(column)], F.lit(0))


def protected(old: DataFrame, new: DataFrame, key: list[str], method: str, columns: list[str], force: bool = False) -> DataFrame:
    """A merge in which a row of an equal or higher tier stays as it is, unless forced; new rows without a tier always write."""
    ranks = old.select(*key, tier(method).alias("_old_tier"))
    joined = new.join(ranks, key, "left").withColumn("_tier", tier(method))
    allowed = F.lit(force) | F.col("_old_tier").isNull() | ~((F.col("_old_tier") >= F.col("_tier")) & (F.col("_tier") > 0))
    return merge(old, joined.where(allowed).drop("_old_tier", "_tier"), key, [method, *columns])


# The columns that each source of an actor's position writes: what, where, how sure.
SOURCES = {
    "regex": ("regex_drrp", "regex_position", None),
    "classifier": ("cls_drrp", "cls_position", "cls_confidence"),
    "slm": ("slm_drrp", "slm_position", "slm_confidence"),
    "llm": ("llm_drrp", "llm_position", None),
    "inferred": ("inferred_drrp", "inferred_position", None),
}
ACTOR = ["section_id", "actor_label"]


def upsert_actors(old: DataFrame, signals: DataFrame, key: list[str] = ACTOR) -> DataFrame:
    """The table of actors after signals (key, category, drrp, position, tier, confidence, at): each writes its source's columns.

    Of several signals of one source on one actor the last counts; a category is kept where the last signal has none; signals of
    unknown sources are left out. Signals are pivoted to one row for each actor, which is then merged.
    """
    known = signals.where(F.col("tier").isin(*SOURCES))
    last = lambda value, tier: F.max_by(F.when(F.lit(True), value), F.when(F.col("tier") == tier, F.col("at")))
    pick, columns = [F.max_by("category", F.when(F.col("category").isNotNull(), F.col("at"))).alias("category")], []
    for tier, names in SOURCES.items():
        pick.append(F.count_if(F.col("tier") == tier).alias(f"_has_{tier}"))
        for name, value in zip(names, ("drrp", "position", "confidence"), strict=True):
            if name:
                pick.append(last(F.col(value), tier).alias(f"_n_{name}"))
                columns.append((tier, name))
    new = known.groupBy(*key).agg(*pick).withColumnRenamed("category", "_n_category")
    joined = old.join(new, key, "full")
    written = {name: F.when(F.col(f"_has_{tier}") > 0, F.col(f"_n_{name}")).otherwise(F.col(name)) for tier, name in columns if name in old.columns}
    written["category"] = F.coalesce("_n_category", "category")
    return joined.select(*((written[c].alias(c) if c in written else F.col(c)) for c in old.columns))


def write_taxa(old: DataFrame, new: DataFrame, key: str, columns: list[str], digest: str = "taxa_hash") -> DataFrame:
    """The laws with ``result``: NoTaxa clears the columns and the hash, Making and NonMaking write them, Unchanged leaves them.

    ``new``: (key, columns, digest, makes); a law that it lacks is Unchanged; a null digest is no taxa.
    """
    given = new.select(key, F.col(digest).alias("_d"), F.col("makes").alias("_makes"), *(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_there"))
    joined = old.join(given, key, "left")
    same = F.col("_there").isNull() | (F.col("_d").isNotNull() & F.col("_d").eqNullSafe(F.col(digest)))
    result = F.when(same, "Unchanged").when(F.col("_d").isNull(), "NoTaxa").when(F.col("_makes"), "Making").otherwise("NonMaking")
    take = lambda c, x: F.when(F.col("result") == "Unchanged", F.col(c)).when(F.col("result") == "NoTaxa", F.lit(None)).otherwise(x).alias(c)
    marked = joined.withColumn("result", result)
    return marked.select(*(take(c, F.col(f"_n_{c}")) if c in columns else take(c, F.col("_d")) if c == digest else F.col(c) for c in old.columns), "result")


def changed_only(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """New rows whose digest differs from the stored one."""
    return new.join(old.select(key, F.col(digest).alias("_d")), key, "left").where(~F.col(digest).eqNullSafe(F.col("_d"))).drop("_d")


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with all columns of a type map, null where they were missing."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def compact(df: DataFrame, files: int) -> DataFrame:
    """The same rows in fewer files."""
    return df.coalesce(files)
