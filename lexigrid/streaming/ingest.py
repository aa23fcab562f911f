"""Ingest with keyed state: each law's last event, its place in the queue and its retries live in the stream's own state.

A law's state changes only when an event of it comes, so a micro-batch costs what it brings, however many laws there are. Every
change is handed on as one row; tables are the last change of each law. The same job runs once over what is there, or goes on;
stopped at any point, it starts again from its checkpoint, and a repeated batch writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexigrid.streaming.events import RETRIES, decode

# Actions that remove a law, tables of events on laws, and the table of a try's result with its actions.
DELETED, TABLES, RESULTS, DONE, FAILED = ("lat_deleted", "deleted"), ("lat", "lrt"), "result", "ok", "failed"
#: Classes that are queued, milliseconds from a failure to the next try, and the settings that keyed state needs.
QUEUED, RETRY_MS = ("making", "uncertain"), 60_000
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CHANGE = "law_name string, version long, cause string, present boolean, at long, added_at long, pending boolean, retries int"
_LAW = "version long, present boolean, at long, action string, added_at long, pending boolean, retries int"


class LawProcessor(StatefulProcessor):
    """Events (law_name, table, action, at, kind) of a law to its changes.

    The last event by time counts, of several at one time a deletion, then the last action by name; an earlier one that comes
    late changes nothing. A law that comes or is renewed is queued if its class says so and it does not wait already. Results
    of tries come after the events of their batch: success ends the wait, failure counts, and a law that has not failed too
    often is due again when its timer expires. State that no event touches for ``ttl_ms`` is forgotten, if given.
    """

    def __init__(self, retry_ms: int, ttl_ms: int | None) -> None:
        self.retry_ms, self.ttl_ms = retry_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.law = handle.getValueState("law", _LAW, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, present, at, action, added, pending, retries = self.law.get() if self.law.exists() else (0, False, None, None, None, False, None)
        order = lambda when, what: (when is not None, when or 0, what in DELETED, what or "")
        out = []

        def change(cause: str) -> None:
            nonlocal version
            version += 1
            out.append((key[0], version, cause, present, at, added, pending, retries))

        last, results = None, []
        for part in rows:  # a batch's events of one law come in parts of bounded size
            for table, what, when, kind in zip(part["table"], part["action"], part["at"], part["kind"], strict=True):
                event = (None if pd.isna(when) else int(when), what, kind)
                if table == RESULTS:
                    results.append(what)
                elif last is None or order(*event[:2]) > order(*last[:2]):
                    last = event
        if last:
            when, what, kind = last
            if not version or at is None and action is None or order(when, what) > order(at, action):
                at, action, present = when, what, what not in DELETED
                if present and kind in QUEUED and not pending:
                    added, pending, retries = when, True, 0
                change(what)
        for result in results:
            if pending and result == DONE:
                pending, retries = False, None
                change(DONE)
            elif pending and result == FAILED:
                retries += 1
                change(FAILED)
                if retries < RETRIES:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
        self.law.update((version, present, at, action, added, pending, retries))
        yield pd.DataFrame(out, columns=CHANGES).astype(TYPES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, present, at, action, added, pending, retries = self.law.get()
        rows = []
        if pending and retries < RETRIES:
            rows.append((key[0], version + 1, "due", present, at, added, pending, retries))
            self.law.update((version + 1, present, at, action, added, pending, retries))
        yield pd.DataFrame(rows, columns=CHANGES).astype(TYPES)

    def close(self) -> None:
        pass


CHANGES = [c.split()[0] for c in CHANGE.split(", ")]
TYPES = {"version": "int64", "at": "Int64", "added_at": "Int64", "present": "bool", "pending": "bool", "retries": "Int32"}


def ingest(spark: SparkSession, source: str, where: str, laws: DataFrame, detect: Callable[[DataFrame], DataFrame], every: str | None = None, retry_ms: int = RETRY_MS, ttl_ms: int | None = None) -> StreamingQuery:
    """Start to take JSON events from the files of a folder into the state under ``where``.

    ``laws`` is a static table of what is known of each law (law_name once, ...), and ``detect`` adds ``class`` to events joined
    with it. ``every`` is the interval of a stream that goes on; without it the query takes what is there and ends.
    """
    events = decode(spark.readStream.format("text").load(source))
    events = events.where(F.col("table").isin(*TABLES, RESULTS) & F.col("law_name").isNotNull())
    classed = detect(events.join(laws, "law_name", "left")).select("law_name", "table", "action", F.unix_micros("at").alias("at"), F.col("class").alias("kind"))
    changes = classed.groupBy("law_name").transformWithStateInPandas(LawProcessor(retry_ms, ttl_ms), CHANGE, "Update", "ProcessingTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/changes/batch={number}")

    # Timers ask for a batch without data after every batch, so a query that is to end runs none: what is due comes with the next call.
    settings = STATE if every else STATE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():  # a query takes the session's settings with it when it starts
            spark.conf.set(k, v)
        stream = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint")
        return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def audit(spark: SparkSession, where: str) -> DataFrame:
    """All changes of all laws, numbered law by law from 1, with times as timestamps."""
    times = {c: F.timestamp_micros(c) for c in ("at", "added_at")}
    return spark.read.schema(f"{CHANGE}, batch long").parquet(f"{where}/changes").drop("batch").withColumns(times)


def last_changes(spark: SparkSession, where: str) -> DataFrame:
    """The state of each law: its last change."""
    rows = audit(spark, where)
    return rows.groupBy("law_name").agg(F.max_by(F.struct(*rows.columns[1:]), "version").alias("c")).select("law_name", "c.*")


def laws_of(spark: SparkSession, where: str) -> DataFrame:
    """(law_name, updated_at) of the laws that are there."""
    return last_changes(spark, where).where("present").select("law_name", F.col("at").alias("updated_at"))


def queue_of(spark: SparkSession, where: str) -> DataFrame:
    """(law_name, added_at, pending, retries) of the laws that were ever queued."""
    return last_changes(spark, where).where("added_at IS NOT NULL").select("law_name", "added_at", "pending", "retries")
