"""Event-driven ingest on Structured Streaming: decode, apply in order, triage, queue, publish and audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lexigrid.operators.ranking import ordered

# The fields of an event, and the retries after which a law waits for a person.
EVENT = "table string, action string, metadata struct<law_name:string,count:int,source:string>, timestamp string"
RETRIES = 3


def decode(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON events as columns; a payload that is not JSON has only nulls."""
    return raw.select(F.from_json(F.col(value).cast("string"), EVENT).alias("e")).select("e.table", "e.action", F.col("e.metadata.law_name").alias("law_name"), F.col("e.metadata.count").alias("n_rows"), F.to_timestamp("e.timestamp").alias("at"))


def relevant(events: DataFrame) -> DataFrame:
    """Events on text or law records that name a law."""
    return events.where(F.col("table").isin("lat", "lrt") & F.col("law_name").isNotNull())


def last_by_law(events: DataFrame) -> DataFrame:
    """The last event of each law; of several at one time, a deletion."""
    order = F.struct(F.col("at"), F.col("action").isin("lat_deleted", "deleted").alias("deletes"), F.col("action"))
    return events.groupBy("law_name").agg(F.max_by(F.struct("table", "action", "at"), order).alias("e")).select("law_name", "e.*")


def apply(state: DataFrame, events: DataFrame) -> DataFrame:
    """The laws after a batch of events: those last deleted go, those last persisted come or are renewed."""
    last = last_by_law(relevant(events))
    come = last.where(~F.col("action").isin("lat_deleted", "deleted")).select("law_name", F.col("at").alias("updated_at"))
    return state.join(last.select("law_name"), "law_name", "left_anti").unionByName(come, allowMissingColumns=True)


def enqueue(queue: DataFrame, triaged: DataFrame) -> DataFrame:
    """The queue (law_name, added_at, pending, retries) with laws whose class is making or uncertain; queued ones keep their place."""
    new = triaged.where(F.col("class").isin("making", "uncertain")).select("law_name", F.col("updated_at").alias("added_at"), F.lit(True).alias("pending"), F.lit(0).alias("retries"))
    return queue.unionByName(new.join(queue.where("pending").select("law_name"), "law_name", "left_anti"))


def on_arrival(queue: DataFrame, events: DataFrame, laws: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The queue after a batch of events: laws that came or were renewed are triaged by ``detect`` (adds class) and queued where they may make duties.

    ``laws`` is a static table of what is known of each law (law_name, ...), joined with the batch.
    """
    last = last_by_law(relevant(events)).where(~F.col("action").isin("lat_deleted", "deleted")).select("law_name", F.col("at").alias("updated_at"))
    return enqueue(queue, detect(last.join(laws, "law_name")))


def status(queue: DataFrame, laws: DataFrame) -> DataFrame:
    """What a status request is answered with, one row: laws, those pending, those due, those that wait for a person, and the oldest."""
    q = queue.agg(F.count_if("pending").alias("n_pending"), F.count_if(F.col("pending") & (F.coalesce("retries", F.lit(0)) < RETRIES)).alias("n_due"), F.count_if(F.col("pending") & (F.coalesce("retries", F.lit(0)) >= RETRIES)).alias("n_stuck"), F.min(F.when(F.col("pending"), F.col("added_at"))).alias("oldest"))
    return laws.agg(F.count("*").alias("n_laws")).join(F.broadcast(q))


def due(queue: DataFrame) -> DataFrame:
    """Laws to be tried, oldest first; those with too many failures stay pending but are not tried."""
    return queue.where(F.col("pending") & (F.coalesce("retries", F.lit(0)) < RETRIES)).orderBy("added_at", "law_name")


def settle(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after tries (law_name, ok): success clears, failure counts."""
    r = results.select("law_name", F.col("ok").alias("_ok"))
    joined = queue.join(r, "law_name", "left")
    return joined.select("law_name", "added_at", F.when(F.col("_ok"), False).otherwise(F.col("pending")).alias("pending"), F.when(F.col("_ok"), None).when(~F.col("_ok"), F.coalesce("retries", F.lit(0)) + 1).otherwise(F.col("retries")).alias("retries"))


def key(*parts: str | Column) -> Column:
    """A key expression: its parts joined by ``/``."""
    return F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def law_of_key(column: str | Column) -> Column:
    """The last part of a key expression; null if it is a wildcard or empty."""
    last = F.element_at(F.split(column, "/"), -1)
    return F.when(~last.isin("", "*", "**"), last)


def watch(spark: SparkSession, source: str, state: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Apply JSON events from files to a Parquet state table, batch by batch; stops when all files are read.

    The state is written to a new folder for each batch, named by its number, so a batch that runs again writes the same folder.
    """
    lines = spark.readStream.format("text").load(source)

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{state}/v{number}")
        apply(before, decode(batch)).write.mode("overwrite").parquet(f"{state}/v{number + 1}")
        if each:
            each(batch, number)

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(df: DataFrame, root: str, *by: str) -> None:
    """Rows to Parquet, a folder for each key."""
    df.write.mode("overwrite").partitionBy(*by).parquet(root)


def chained(log: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """An audit log with each entry's hash; ``previous`` is the hash of the entry before it, empty for the first."""
    return _after(log.withColumn("hash", F.sha2(F.to_json(F.struct(*columns)), 256)), order, "previous")


def _after(log: DataFrame, order: str, name: str) -> DataFrame:
    """The log with the hash of the entry before each, stretch by stretch of its order; the first of a stretch follows the last of the one before."""
    rows, _ = ordered(log, order)
    ends = rows.groupBy("_stretch").agg(F.max_by("hash", order).alias("_end"))
    down = Window.partitionBy(F.lit(0)).orderBy("_stretch")
    ends = ends.select("_stretch", F.lag("_end").over(down).alias("_end"))  # a row for each stretch
    own = F.lag("hash").over(Window.partitionBy("_stretch").orderBy(order))
    met = rows.join(F.broadcast(ends), "_stretch").withColumn(name, F.coalesce(own, "_end", F.lit("")))
    return met.drop("_stretch", "_before", "_n", "_end")


def broken(log: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Entries whose hash, or whose link to the one before, does not hold."""
    linked = _after(log, order, "_p").where((F.sha2(F.to_json(F.struct(*columns)), 256) != F.col("hash")) | (F.col("_p") != F.col("previous")))
    return linked.select(log.columns)


def last_writes(updates: DataFrame) -> DataFrame:
    """The map that updates (doc, key, value, at) leave: the last write of each key, by time and then by value."""
    return updates.groupBy("doc", "key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
