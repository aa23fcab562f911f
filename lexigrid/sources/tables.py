"""Tables in and out: Parquet, CSV, JSON and Arrow, with declared keys and evolving columns."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.operators.lookup import identifier, project

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """A Parquet table, as a view if asked; raises ``FileNotFoundError`` where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(identifier(view))
    return df


def load_all(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """All tables of a folder, each also a view."""
    return {n: load(spark, f"{folder}/{n}.parquet", n) for n in names}


def has_tables(spark: SparkSession, *names: str) -> bool:
    return all(spark.catalog.tableExists(n) for n in names)


def replace(df: DataFrame, table: str) -> None:
    """Drop and create a table from rows; raises ``ValueError`` where there are no columns."""
    if not df.columns:
        raise ValueError("a table needs columns")
    df.write.mode("overwrite").saveAsTable(identifier(table))


def append(df: DataFrame, table: str) -> None:
    """Append rows by column name; the name has only letters, digits and underscores."""
    df.select(*df.sparkSession.table(identifier(table)).columns).write.insertInto(table)


def paged(df: DataFrame, condition: str | None, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of rows in a stated order."""
    rows = (df.where(condition) if condition else df).orderBy(*order).offset(offset)
    return rows if limit is None else rows.limit(limit)


def taxa(df: DataFrame, types: str = "drrp_types", heavy: tuple[str, ...] = ("text", "embedding", "token_ids")) -> DataFrame:
    """Rows with a classification, without the heavy columns, which are then not read from Parquet."""
    return project(df.where(F.col(types).isNotNull()), [c for c in df.columns if c not in heavy])


def normalised(df: DataFrame) -> DataFrame:
    """Columns without a type become strings; times without a zone become moments in the session's zone."""
    cast = {T.NullType: "string", T.TimestampNTZType: "timestamp"}
    return df.withColumns({f.name: F.col(f.name).cast(cast[type(f.dataType)]) for f in df.schema if type(f.dataType) in cast})


def to_ipc(df: DataFrame) -> bytes:
    """An Arrow IPC stream of a result that fits the driver."""
    table, out = df.toArrow(), io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",", schema: str | None = None) -> DataFrame:
    """A CSV file with a header; malformed rows are left out."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("encoding", encoding).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_splits(df: DataFrame, split: str, path: str) -> None:
    """Parquet, a folder for each of train, val and test."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Calibration files, one row for each magnitude band."""
    return spark.read.option("multiLine", True).json(path).select("mechanism", F.inline("magnitude_bands"))


def dictionary(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A packaged dictionary as a small table."""
    return spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in rows], schema)


def migrated(df: DataFrame, json: list[str] = (), added: dict[str, str] | None = None) -> DataFrame:
    """The table with its list columns as JSON, and with new columns, null so far."""
    df = df.withColumns({c: F.to_json(c) for c in json})
    return df.withColumns({c: F.lit(None).cast(t) for c, t in (added or {}).items() if c not in df.columns})
