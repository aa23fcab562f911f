"""Vector search: every query against all rows in a grid of bounded blocks, or through inverted lists over cells of vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries and rows that one call compares at most, about: a matrix of 80 MB.
BLOCK, SLICE = 1_000, 10_000
#: Most cells of an index, and vectors of the sample for each cell when they are fitted.
CELLS, SAMPLE = 4_096, 64
#: Cells that a query looks into, as a share of all and at least so many; and rows that it sees at least.
SHARE, PROBES, LEAST = 0.5, 8, 2_000


def matrix(column) -> np.ndarray:
    """A list column of Arrow as a matrix; all its vectors have one length."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scores(q: np.ndarray, x: np.ndarray, cosine: bool) -> np.ndarray:
    """What is least for the nearest: the negative cosine, or the squared distance."""
    if cosine:
        with np.errstate(divide="ignore", invalid="ignore"):
            return -(q @ x.T) / np.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1)))
    return np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T), 0.0)


def least(s: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k least scores of each row, equal ones by name; scores that are no number come last."""
    s = np.where(np.isnan(s), np.inf, s)
    if s.shape[1] <= k:
        return np.divmod(np.arange(s.size), s.shape[1]) if s.size else (np.empty(0, int), np.empty(0, int))
    kth = np.partition(s, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero(s <= kth[:, None])
    order = np.lexsort((names[cols], s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(s)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep]


def _meet(queries: DataFrame, rows: DataFrame, keys: list[str], k: int, cosine: bool) -> DataFrame:
    """(query, ident, rank, score): the k best rows for each query among the rows of its keys.

    Queries (query, v) and rows (ident, v) that share their keys are dealt over a grid of blocks of queries and slices of rows,
    so neither a large cell nor many queries for one make a large task. Rows of keys that no query asks for are left where they
    are. Each call hands on k rows a query, which meet by query.
    """
    import pyarrow as pa

    asked = queries.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    held = rows.groupBy(*keys).agg(F.ceil(F.count("*") / SLICE).alias("_slices"))
    grid = asked.join(held, keys)
    place = [*keys, "_block", "_slice"]
    split = queries.join(grid, keys).withColumn("_block", F.pmod(F.xxhash64("query", "v"), "_blocks"))
    split = split.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
    dealt = rows.join(grid, keys).withColumn("_slice", F.pmod(F.xxhash64("ident", "v"), "_slices"))
    dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        out, names = [], held["ident"].to_numpy()
        x = matrix(held["v"]) if len(held) else None
        for start in range(0, len(asked) if len(held) else 0, BLOCK):
            some = asked.slice(start, BLOCK)
            s = np.round(scores(matrix(some["v"]), x, cosine), 6)
            i, j = least(s, names, k)
            out.append(pa.table({"query": some["query"].combine_chunks().take(pa.array(i)), "ident": held["ident"].combine_chunks().take(pa.array(j)), "score": s[i, j]}))
        return pa.concat_tables(out) if out else pa.table({"query": asked["query"].slice(0, 0), "ident": held["ident"].slice(0, 0), "score": pa.array([], pa.float64())})

    query, ident = queries.schema["query"].dataType.simpleString(), rows.schema["ident"].dataType.simpleString()
    # Columns anew, for queries and rows may come of one table.
    split, dealt = (d.select(*(F.col(c).alias(c) for c in (*place, name, "v"))) for d, name in ((split, "query"), (dealt, "ident")))
    found = split.groupBy(*place).cogroup(dealt.groupBy(*place))
    found = found.applyInArrow(best, f"query {query}, ident {ident}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "ident"))
    score = -F.col("score") if cosine else F.col("score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "ident", "rank", score.alias("score"))


def exact(queries: DataFrame, rows: DataFrame, k: int, cosine: bool = True, within: bool = False) -> DataFrame:
    """(query, ident, rank, score): the k rows of (ident, v) most like each of (query, v), among all rows.

    By cosine the score is the likeness, else the squared distance, both to six digits; equal ones go by ident. Rows and queries
    without a vector are left out; a vector of length zero has no cosine and comes last. With ``within``, only rows of the
    query's own ``within`` count. ``query`` and ``ident`` name rows; a name that repeats is one query, and several rows.
    """
    keys = ["within"] if within else ["_all"]
    queries, rows = (d.where(F.col("v").isNotNull()) for d in (queries, rows))
    if not within:
        queries, rows = (d.withColumn("_all", F.lit(0)) for d in (queries, rows))
    return _meet(queries, rows, keys, k, cosine)


@dataclass
class Index:
    """Inverted lists: ``rows`` (cell, ident, v, and within if it was given) over cells around ``centres``."""

    rows: DataFrame
    centres: np.ndarray
    cosine: bool


def _unit(v: np.ndarray, cosine: bool) -> np.ndarray:
    """Vectors of length one, whose distances rank as cosines do; others as they are."""
    size = np.sqrt((v * v).sum(axis=1))[:, None] if cosine else 1.0
    return v / np.where(size > 0, size, 1.0)


def fit(rows: DataFrame, cells: int | None = None, cosine: bool = True, rounds: int = 10) -> np.ndarray:
    """Centres of cells, by k-means over the ``SAMPLE`` x cells vectors of least hash: 262,144 at most.

    Without a number of cells, it is the root of the number of rows, at most ``CELLS``. A table without vectors has no cells.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = rows.where(F.col("v").isNotNull()).select(F.col("v").cast("array<double>").alias("v"))
    cells = min(CELLS, cells or max(1, int(rows.count() ** 0.5)))
    v = F.col("v")
    if cosine:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        v = F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))
    sample = rows.orderBy(F.xxhash64("v")).limit(SAMPLE * cells).select(v.alias("v")).distinct()
    sample = sample.select(array_to_vector("v").alias("features")).cache()
    try:
        n = sample.count()
        if n < 2 or cells < 2:
            return np.array([r["features"].toArray() for r in sample.limit(1).collect()])
        return np.array(KMeans(k=min(cells, n), seed=7, maxIter=rounds, initSteps=2).fit(sample).clusterCenters())
    finally:
        sample.unpersist()


def build(rows: DataFrame, centres: np.ndarray, cosine: bool = True) -> Index:
    """Every row of (ident, v) with a vector in the cell of its nearest centre; other columns stay."""

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            near = scores(_unit(matrix(pa.chunked_array([b["v"]])), cosine), centres, False) if len(b) else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(near.argmin(axis=1), pa.int32()), *b.columns], ["cell", *b.schema.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return Index(rows.where(F.col("v").isNotNull()).mapInArrow(assign, f"cell int, {schema}"), centres, cosine)


def write(index: Index, path: str) -> None:
    """The lists as Parquet by cell, and the centres beside them."""
    spark = index.rows.sparkSession
    index.rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    centres = [(i, [float(x) for x in c], index.cosine) for i, c in enumerate(index.centres)]
    spark.createDataFrame(centres, "cell int, v array<double>, cosine boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read(spark: SparkSession, path: str) -> Index:
    """An index that was written; its centres, ``CELLS`` at most, come to the driver."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    schema = spark.read.parquet(f"{path}/rows").schema
    return Index(spark.read.schema(schema).parquet(f"{path}/rows"), np.array([r["v"] for r in centres]), bool(centres and centres[0]["cosine"]))


def probed(index: Index, queries: DataFrame, share: float = SHARE, probes: int = PROBES, seen: int = LEAST, within: bool = False) -> DataFrame:
    """Queries with a row for each ``cell`` they look into: the nearest, until both so many cells and so many rows are reached.

    With ``within`` only cells that hold rows of the query's ``within`` count, and their rows of it: a rare one is searched in
    full, so a search of at most ``seen`` rows is exact.
    """
    keys = ["within"] if within else []
    sizes = index.rows.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    # A map of at most CELLS entries for each key.
    held = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("_held"))
    queries = queries.where(F.col("v").isNotNull())
    asked = queries.join(held, keys) if within else queries.crossJoin(F.broadcast(held))
    centres, cosine, wanted = index.centres, index.cosine, max(probes, int(np.ceil(share * len(index.centres))))

    def choose(batches):
        import pyarrow as pa

        for b in batches:
            if not len(b):
                continue
            near, lists = scores(_unit(matrix(pa.chunked_array([b["v"]])), cosine), centres, False), b["_held"]
            cells, n, ends = lists.flatten().field("cell").to_numpy(), lists.flatten().field("n").to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
            chosen = []
            for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
                order = start + np.argsort(near[i, cells[start:end]], kind="stable")
                before = np.cumsum(n[order]) - n[order]
                chosen.append(cells[order[(np.arange(len(order)) < wanted) | (before < seen)]])
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["_held"]).columns, pa.array(chosen, pa.list_(pa.int32()))], [*b.drop_columns(["_held"]).schema.names, "_cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return asked.select(*queries.columns, "_held").mapInArrow(choose, f"{schema}, _cells array<int>").withColumn("cell", F.explode("_cells")).drop("_cells")


def calibrated(index: Index, queries: DataFrame, k: int, target: float = 0.95, n: int = 500) -> float:
    """The share of cells that holds ``target`` of the k nearest rows, by the exact neighbours of the n queries of least hash."""
    some = queries.where(F.col("v").isNotNull()).orderBy(F.xxhash64("query", "v")).limit(n)
    near = exact(some, index.rows.select("ident", "v"), k, index.cosine).select(F.col("query").alias("_query"), F.col("ident").alias("_ident"))
    cells = index.rows.select(F.col("ident").alias("_ident"), "cell").join(F.broadcast(near), "_ident")  # n x k rows
    met = some.join(cells, some["query"] == cells["_query"]).select("v", "cell")
    centres, cosine = index.centres, index.cosine

    def place(batches):
        import pyarrow as pa

        for b in batches:
            if len(b):
                away = scores(_unit(matrix(pa.chunked_array([b["v"]])), cosine), centres, False)
                own = away[np.arange(len(b)), b["cell"].to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array((away <= own[:, None]).sum(axis=1), pa.int32())], ["place"])

    last = met.mapInArrow(place, "place int").agg(F.percentile("place", target)).first()[0]
    return 1.0 if last is None else min(1.0, last / len(centres))


def search(index: Index, queries: DataFrame, k: int, within: bool = False, **reach) -> DataFrame:
    """As ``exact``, through the index: near to it, and equal where a query sees all rows; see ``probed`` for its reach.

    Of a written index only the folders of probed cells are read.
    """
    asked = probed(index, queries, within=within, **reach)
    cells = F.broadcast(asked.select("cell").distinct())  # CELLS at most
    return _meet(asked, index.rows.join(cells, "cell", "left_semi"), ["within", "cell"] if within else ["cell"], k, index.cosine)


def recall(found: DataFrame, right: DataFrame) -> DataFrame:
    """(query, n, n_found, recall): how many of each query's right rows were found, or others just as near as the last of them."""
    last = right.groupBy("query").agg(F.count("*").alias("n"), F.max_by("score", "rank").alias("_last"))
    gap: Callable[[str], Column] = lambda c: F.abs(F.col(c) - F.col("_last")) <= 1e-6
    hit = found.select("query", F.col("ident").alias("_ident"), F.col("score").alias("_score")).join(last.select("query", "_last"), "query")
    hit = hit.join(right.select("query", F.col("ident").alias("_ident"), F.lit(True).alias("_right")), ["query", "_ident"], "left")
    hit = hit.groupBy("query").agg(F.count_if(F.col("_right").isNotNull() | gap("_score")).alias("_hits"))
    n_found = F.least("n", F.coalesce("_hits", F.lit(0)))
    return last.join(hit, "query", "left").select("query", "n", n_found.alias("n_found"), (n_found / F.col("n")).alias("recall"))
