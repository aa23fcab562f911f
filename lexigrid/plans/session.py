"""What a small application may do with the tables: query, insert, and read its own audit log."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from lexigrid.operators.lookup import identifier
from lexigrid.sources import tables
from lexigrid.streaming import events

AUDIT = "entry_id long, at timestamp, action string, detail string, n_rows long"


class Session:
    """A view of the tables of a folder; every call leaves an entry in the audit log, which is chained by hashes."""

    def __init__(self, spark: SparkSession, folder: str | None = None, names: tuple[str, ...] = tables.TABLES):
        self.spark, self._log = spark, []
        if folder:
            tables.load_all(spark, folder, names)

    def _note(self, action: str, detail: str, n: int | None = None) -> None:
        self._log.append((len(self._log) + 1, datetime.datetime.now(), action, detail, n))

    def query(self, sql: str, **values) -> DataFrame:
        self._note("query", sql)
        return self.spark.sql(sql, args=values)

    def insert(self, table: str, rows: DataFrame) -> int:
        """Append rows to a table by column name, and say how many."""
        n = rows.count()
        tables.append(rows, identifier(table))
        self._note("insert", table, n)
        return n

    def audit(self) -> DataFrame:
        log = self.spark.createDataFrame(self._log, AUDIT)
        return events.chained(log, "entry_id", ["entry_id", "at", "action", "detail", "n_rows"])
