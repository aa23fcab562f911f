"""Quality reports over classified provisions and benchmarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import taxa

# Limits of clause confidence, and shares of purposes that stand out.
LOW, MEDIUM, HIGH = 0.45, 0.60, 0.80
SHARES = {taxa.ENACTMENT: 0.10, "Enforcement+Prosecution": 0.15}
LARGE = 10


def provision_confidence(has_duty: str | Column, has_actor: str | Column) -> Column:
    """0.90 with a duty and an actor, 0.80 with a duty, else 0.30."""
    duty, actor = (F.col(x) if isinstance(x, str) else x for x in (has_duty, has_actor))
    return F.when(duty & actor, 0.90).when(duty, 0.80).otherwise(0.30)


def clause_buckets(df: DataFrame, confidence: str) -> DataFrame:
    """(bucket, n, mean): ten buckets of confidence, the last one closed."""
    bucket = F.least(F.floor(F.col(confidence).cast("float") * F.lit(10).cast("float")), F.lit(9)).cast("int")
    return df.where(F.col(confidence).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("mean"))


def clause_bands(df: DataFrame, by: str, confidence: str) -> DataFrame:
    """Counts of low, medium, fair and high clauses for each group."""
    c = F.col(confidence)
    return df.groupBy(by).agg(F.count_if(c < LOW).alias("n_low"), F.count_if((c >= LOW) & (c < MEDIUM)).alias("n_medium"), F.count_if((c >= MEDIUM) & (c < HIGH)).alias("n_fair"), F.count_if(c >= HIGH).alias("n_high"))


def hottest(df: DataFrame, heat: str, tie: str, n: int) -> DataFrame:
    """The n provisions most likely to be missed duties; those without any heat are left out last, so that it is reckoned once."""
    return df.orderBy(F.desc(heat), tie).limit(n).where(F.col(heat) > 0)


def purpose_shares(df: DataFrame, law: str, purposes: str) -> DataFrame:
    """(law, purpose, n, share of the law's provisions)."""
    n = df.groupBy(law).agg(F.count("*").alias("_n"))
    each = df.select(law, F.explode(purposes).alias("purpose")).groupBy(law, "purpose").agg(F.count("*").alias("n"))
    return each.join(n, law).select(law, "purpose", "n", F.round(F.col("n") / F.col("_n"), 6).alias("share"))


def purpose_anomalies(df: DataFrame, law: str, purposes: str, has_duty: str) -> DataFrame:
    """(law, anomaly): purposes with more than their share, and laws of over ten provisions without a duty."""
    limit = F.create_map(*(F.lit(x) for pair in SHARES.items() for x in pair))
    shares = purpose_shares(df, law, purposes).where(F.col("share") > limit[F.col("purpose")]).select(law, F.concat(F.lit("share: "), "purpose").alias("anomaly"))
    empty = df.groupBy(law).agg(F.count("*").alias("_n"), F.count_if(has_duty).alias("_d")).where((F.col("_n") > LARGE) & (F.col("_d") == 0))
    return shares.unionByName(empty.select(law, F.lit("no duties").alias("anomaly")))


def agreement(gold: str, other: str) -> int:
    """How well two labels agree: 3 with equal last parts, 2 if one last part holds the other, 1 if the other has a gold word of four letters or more."""
    g, o = gold.lower(), other.lower()
    x, y = (s.rsplit(":", 1)[-1].strip() for s in (g, o))
    if x == y:
        return 3
    return 2 if x in y or y in x else int(any(w in o for w in g.split() if len(w) > 3))


def match_labels(df: DataFrame, section: str, gold: str, found: str) -> DataFrame:
    """(section, gold, found): each gold label with the found one that agrees best, each used once; null without one.

    The lists of one section are short; earlier gold labels choose first, and the first of equals wins.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s, golds, others in zip(pdf[section], pdf[gold], pdf[found], strict=True):
            left = list(others) if others is not None else []
            for g in golds if golds is not None else []:
                best = max(range(len(left)), key=lambda i: (agreement(g, left[i]), -i), default=None)
                hit = best is not None and agreement(g, left[best]) > 0
                rows.append((s, g, left.pop(best) if hit else None))
        return pd.DataFrame(rows, columns=["section", "gold", "found"])

    def each(frames):
        for f in frames:
            yield one(f)

    kind = df.schema[section].dataType.simpleString()
    return df.select(section, gold, found).mapInPandas(each, f"section {kind}, gold string, found string")


# Words of an offence.
OFFENCE = r"\bguilty of an offence\b|\bcommits an offence\b|\bis an offence\b|\bliable on (?:summary )?conviction\b|\bliable to a fine\b|\bshall be liable\b|\bpunishable\b"


def three_classes(labels: str | Column, text: str | Column) -> Column:
    """Gold types of five classes as three; a duty whose text tells an offence, without a modal of obligation, is none."""
    labels, text = (F.col(x) if isinstance(x, str) else x for x in (labels, text))
    offence = F.get(labels, F.lit(0)).isin("Duty", "Responsibility") & taxa.found(text, OFFENCE) & ~taxa.found(text, taxa.OBLIGATION)
    mapped = F.transform(labels, lambda x: F.when(x.isin("Duty", "Responsibility"), "Obligation").when(x.isin("Right", "Power"), "Liberty").otherwise(x))
    return F.when(F.coalesce(offence, F.lit(False)), F.array().cast("array<string>")).otherwise(mapped)


def schema_docs(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind) of every column of the tables."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")
