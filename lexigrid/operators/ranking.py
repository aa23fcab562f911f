"""Ranks, top rows, shares by rank, samples and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.sources.scratch import settled


#: Stretches of a global order, each sorted by itself: at least and at most, and rows of one between them.
STRETCHES, MOST, ROWS = 200, 2_000, 2_000_000
#: Places, about, from which bounds of stretches are taken, and bounds looked at in one go.
PLACES, STEP = 20_000, 50


def ordered(df: DataFrame, score: str, tie: str | None = None, descending: bool = False) -> tuple[DataFrame, Column]:
    """The table with ``_stretch``, ``_before`` (rows in stretches before it) and ``_n`` (all rows), and the key of a global order.

    The order goes by score, equal ones by tie, and is cut between places (score and tie) that a hash picks, so that no window
    holds the whole table, nor all rows of one score; only rows equal in both stay together. What is picked moves the cuts and
    no rank. Null stands last in a descending order, else first. Bounds and counts of stretches, ``MOST`` rows, are broadcast.
    """
    key = -F.col(score) if descending else F.col(score)
    place = F.struct((key.isNull() if descending else key.isNotNull()).alias("absent"), key.alias("key"), *([F.col(tie).alias("tie")] if tie else []))
    total = df.agg(F.count("*").alias("_n"))
    picked = F.pmod(F.xxhash64(score, *([tie] if tie else [])), F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / PLACES))) == 0
    some = df.crossJoin(F.broadcast(total)).where(picked).select(place.alias("_place")).distinct()
    stretches = F.least(F.lit(MOST), F.greatest(F.lit(STRETCHES), F.ceil(F.col("_n") / ROWS).cast("int")))
    cut = F.transform(F.sequence(F.lit(1), stretches - 1), lambda i: F.get("_places", F.floor(i * F.size("_places") / stretches).cast("int")))
    bounds = some.agg(F.sort_array(F.collect_list("_place")).alias("_places")).crossJoin(F.broadcast(total))
    bounds = bounds.select("_n", F.when(F.size("_places") > 0, F.array_distinct(cut)).alias("_bounds"))
    bounds = settled(bounds.withColumn("_steps", F.filter("_bounds", lambda x, i: i % STEP == 0)))  # one row
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("_place", place)
    step = F.greatest(F.size(F.filter("_steps", lambda x: x < F.col("_place"))) - 1, F.lit(0)) * STEP
    rows = rows.withColumn("_step", step)
    stretch = F.col("_step") + F.size(F.filter(F.slice("_bounds", F.col("_step") + 1, F.lit(STEP)), lambda x: x < F.col("_place")))
    rows = rows.withColumn("_stretch", stretch).drop("_bounds", "_steps", "_step", "_place")
    sizes = rows.groupBy("_stretch").agg(F.count("*").alias("_m"))
    down = Window.partitionBy(F.lit(0)).orderBy("_stretch")  # a row for each stretch
    before = sizes.select("_stretch", (F.sum("_m").over(down) - F.col("_m")).alias("_before"))
    return rows.join(F.broadcast(before), "_stretch"), place


def value_ranks(df: DataFrame, score: str) -> DataFrame:
    """The table with ``_below`` (rows of smaller score, null the smallest), ``_same`` (of its own) and ``_n`` (all).

    Rows of one score are counted before they are ordered, so a score that half of all rows share is one row of the order.
    """
    values = settled(df.groupBy(F.col(score).alias("_value")).agg(F.count("*").alias("_same")))
    rows, place = ordered(values, "_value")
    sums = rows.groupBy("_stretch").agg(F.sum("_same").alias("_m"))
    down = Window.partitionBy(F.lit(0)).orderBy("_stretch")  # a row for each stretch
    before = sums.select("_stretch", (F.sum("_m").over(down) - F.col("_m")).alias("_start"), F.sum("_m").over(Window.partitionBy(F.lit(0))).alias("_all"))
    within = F.sum("_same").over(Window.partitionBy("_stretch").orderBy(place)) - F.col("_same")
    ranks = rows.join(F.broadcast(before), "_stretch").select("_value", "_same", (F.col("_start") + within).alias("_below"), F.col("_all").alias("_n"))
    ranks = settled(ranks)  # else each further rank of the table would make all before it several times
    return df.join(ranks, F.col(score).eqNullSafe(F.col("_value"))).drop("_value")


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """The table with ``number``, each row's place (from 1) in its group's order, and ``of``, the rows of the group.

    Groups are stretches of one global order, so a large group is numbered by many tasks.
    """
    rows, place = ordered(df.withColumn("_order", F.struct(*order)), by, "_order")
    rows = rows.withColumn("number", F.col("_before") + F.row_number().over(Window.partitionBy("_stretch").orderBy(place)))
    groups = rows.groupBy(F.col(by).alias("_by")).agg(F.min("number").alias("_first"), F.count("*").alias("of"))
    met = rows.join(groups, F.col(by).eqNullSafe(F.col("_by")))
    return met.withColumn("number", F.col("number") - F.col("_first") + 1).drop("_by", "_first", "_order", "_stretch", "_before", "_n")


def rate_by_rank(df: DataFrame, score: str, tie: str, high: float = 0.20, low: float = 0.67) -> DataFrame:
    """A table of groups with rank and rating: the first 20 % by score HIGH, from 67 % on LOW, else MEDIUM (counts are rounded down)."""
    rows, place = ordered(df, score, tie, descending=True)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_stretch").orderBy(place)) - 1
    ranked = rows.withColumn("rank", rank.cast("int"))
    rating = F.when(F.col("rank") < F.floor(F.col("_n") * high), "HIGH").when(F.col("rank") >= F.floor(F.col("_n") * low), "LOW").otherwise("MEDIUM")
    return ranked.withColumn("rating", rating).drop("_n", "_stretch", "_before")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rating_order(column: str) -> Column:
    return F.when(F.col(column) == "HIGH", 0).when(F.col(column) == "MEDIUM", 1).when(F.col(column) == "LOW", 2).otherwise(3)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_top(df: DataFrame, vector: list[float], k: int, column: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k rows most like a vector: similarity is one less the cosine distance; rows without a vector are left out."""
    given = F.lit([float(x) for x in vector])
    similarity = dot(column, given) / (norm(column) * norm(given))
    return df.where(F.col(column).isNotNull()).withColumn("similarity", F.round(similarity, 6)).orderBy(F.desc("similarity"), tie).limit(k)


def l2_top(df: DataFrame, vector: list[float], k: int, column: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k rows nearest to a vector by squared Euclidean distance."""
    given = F.lit([float(x) for x in vector])
    gap = F.aggregate(F.zip_with(column, given, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return df.where(F.col(column).isNotNull()).withColumn("distance", F.round(gap, 6)).orderBy("distance", tie).limit(k)


def hash_order(key: str, seed: int = 0) -> Column:
    """A fixed pseudorandom order: 60 bits of a digest, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 15), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(n)


def stratified(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each class, in hash order."""
    order = Window.partitionBy(by).orderBy(hash_order(key, seed), key)
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def quarters(df: DataFrame, group: str, number: str) -> DataFrame:
    """Each row's quarter (0 to 3) between the least and the greatest number of its group."""
    w = Window.partitionBy(group)
    low, high = F.min(number).over(w), F.max(number).over(w)
    return df.withColumn("quarter", F.least(F.lit(3), F.floor((F.col(number) - low) * 4 / F.greatest(high - low + 1, F.lit(1)))).cast("int"))


def percent_ranks(df: DataFrame, score: str, name: str) -> DataFrame:
    """The share of rows with a smaller score, among all others."""
    rank = F.when(F.col("_n") > 1, F.col("_below") / (F.col("_n") - 1)).otherwise(0.0)
    return value_ranks(df, score).withColumn(name, rank).drop("_n", "_below", "_same")


def thirds(df: DataFrame, score: str, name: str = "third") -> DataFrame:
    """HIGH, MEDIUM or LOW by thirds of the percentile rank."""
    rank = F.col("_rank")
    return percent_ranks(df, score, "_rank").withColumn(name, F.when(rank >= 2 / 3, "HIGH").when(rank >= 1 / 3, "MEDIUM").otherwise("LOW")).drop("_rank")


# How much each ground of a law's place in the hierarchy weighs.
GROUNDS = {"centrality": 0.40, "reach": 0.30, "age": 0.30}


def hierarchy(df: DataFrame, grounds: dict[str, str], weights: dict[str, float] = GROUNDS) -> DataFrame:
    """The table with ``score``, the weighted sum of the percentile ranks of its grounds (name: column), and its third."""
    names = []
    for ground, column in grounds.items():
        df = percent_ranks(df, column, f"_p_{ground}")
        names.append((f"_p_{ground}", weights[ground]))
    total = sum((F.col(c) * w for c, w in names), F.lit(0.0))
    return thirds(df.withColumn("score", F.round(total, 6)), "score").drop(*(c for c, _ in names))


def splits(key: str, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test by the hash of a key."""
    share = hash_order(key) / F.lit(float(1 << 60))
    return F.when(share < train, "train").when(share < train + val, "val").otherwise("test")
