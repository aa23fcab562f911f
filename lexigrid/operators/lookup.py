"""Projections, filters and point lookups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotFound(LookupError):
    """A lookup by name that found no row."""


def one(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with a key's value; raises ``NotFound`` where there is none."""
    found = df.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise NotFound(f"{key} = {value!r}")
    return found


def exists(df: DataFrame, key: str, value) -> bool:
    return not df.where(F.col(key) == F.lit(value)).isEmpty()


def where(df: DataFrame, condition: str) -> DataFrame:
    """Rows that meet a SQL condition."""
    return df.where(condition)


def touching(edges: DataFrame, name: str, source: str = "source_name", target: str = "target_name") -> DataFrame:
    """Edges that start or end at a node."""
    return edges.where((F.col(source) == name) | (F.col(target) == name))


def query(spark: SparkSession, sql: str, **values) -> DataFrame:
    """Any SQL, with named parameters."""
    return spark.sql(sql, args=values)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are, in the order asked for."""
    return df.select(*(c for c in columns if c in df.columns))


def set_but_not(df: DataFrame, there: str, missing: str) -> DataFrame:
    """Rows where one column has a value and another has none."""
    return df.where(F.col(there).isNotNull() & F.col(missing).isNull())


def among(df: DataFrame, key: str, values: list | DataFrame) -> DataFrame:
    """Rows whose key is in a list, or in the first column of a table (a semi join)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(values))


def governed(df: DataFrame, labels: str, types: str, wanted: str, purposes: str, excluded: list[str], prefix: str = "Gvt:") -> DataFrame:
    """Rows with a wanted type and a label that is not governmental, whose purposes have none of those excluded."""
    own = F.exists(labels, lambda x: ~x.startswith(prefix))
    return df.where(F.array_contains(types, wanted) & (F.size(labels) > 0) & own & ~F.coalesce(F.arrays_overlap(purposes, F.lit(excluded)), F.lit(False)))


def changed(df: DataFrame, current: str = "taxa_hash", published: str = "published_hash") -> DataFrame:
    """Rows whose current hash is known and differs from the published one."""
    return df.where(F.col(current).isNotNull() & ~F.col(current).eqNullSafe(F.col(published)))


def pending(df: DataFrame, flag: str, done: str, since: str) -> DataFrame:
    """Flagged rows that were not published since they last changed."""
    return df.where(F.col(flag) & (F.col(done).isNull() | (F.col(done) < F.col(since))))


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


def prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows that start with a text, whatever characters it has."""
    return df.where(F.col(column).startswith(prefix))


def containing(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.where(F.col(column).contains(part))


def first_found(df: DataFrame, exact: str, fallback: str) -> DataFrame:
    """Rows that meet a condition, or, if none does, those that meet another."""
    found = df.where(exact)
    other = df.where(fallback).join(F.broadcast(found.limit(1).select(F.lit(1).alias("_any"))), F.lit(True), "left_anti")
    return found.unionByName(other)


def identifier(name: str) -> str:
    """The name, if it has only letters, digits and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"not a table name: {name!r}")
    return name
