"""Exact deduplication as a stateful stream, by native functions.

A stream reads a table's files. Its state, on disk in RocksDB and in the query's checkpoint, holds one entry for each digest and
never expires: how many rows had it, and of the row that stays its identifier and the place of its content (file and row). Each
micro-batch hands on the entries that it changed, so a later run reads new files only. Digests that came more than once are
hits, whose rows are compared in full: equal digests of unlike texts part into groups of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexigrid.llm.common import cut, shared_dir, stored

#: Bytes of files in a micro-batch at most (one file at least), and the share of all rows from which a digest is hot.
BATCH_BYTES, SHARE = 1 << 40, 1000
#: The state's settings. Without the second, every partition's store would reserve megabytes of disk before it holds anything.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def place() -> Column:
    """Where a row's content is: its file, and its number in it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _schema(spark: SparkSession, path: str, key: str, text: str) -> StructType:
    fields = spark.read.parquet(path).schema
    return StructType([StructField(key, fields[key].dataType), StructField(text, fields[text].dataType)])


def _rows(read, key: str, text: str, digest) -> DataFrame:
    """(id, body, digest, at) of a table's rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    return read.select(F.col(key).alias("id"), body.alias("body"), digest(body).alias("digest"), place().alias("at"))


def feed(spark: SparkSession, path: str, where: str, key: str = "doc_id", text: str = "text", digest=sha256, batch_bytes: int = BATCH_BYTES) -> None:
    """Take files of the table that are new since the last call into the state under ``where``.

    Entries (digest, n, keep) that a micro-batch changed go to a folder named by its number, so one that is repeated after a
    failure writes the same folder again.
    """
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that a table may be one file, too
    stream = spark.readStream.schema(_schema(spark, path, key, text)).option("maxBytesPerTrigger", batch_bytes).parquet(glob)
    keep = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "at")).alias("keep")
    entries = _rows(stream, key, text, digest).groupBy("digest").agg(F.count("*").alias("n"), keep)

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/changes/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():  # a query takes the session's settings with it when it starts
            spark.conf.set(k, v)
        query = entries.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def registry(spark: SparkSession, where: str) -> DataFrame:
    """(digest, n, keep) of every digest: the last entry of each, which counts the most rows."""
    changes = spark.read.parquet(f"{where}/changes").drop("batch")
    return changes.groupBy("digest").agg(F.max("n").alias("n"), F.max_by("keep", "n").alias("keep"))


def _split(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose digest is hot, which no shuffle may bring together, and the others."""
    few = F.broadcast(hot.select("digest"))
    return rows.join(few, "digest", "left_semi"), rows.join(few, "digest", "left_anti")


def dedup(spark: SparkSession, path: str, where: str | None = None, key: str = "doc_id", text: str = "text", digest=sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, at, digest, keep_id, keep_at, group_size, kept) of every row of a Parquet table: of equal texts that with the largest key stays.

    Texts are equal when they are the same bytes; a null text counts as empty. A null key is smaller than all others, and of rows
    with equal keys that in the last place stays, so one row of each group is kept. An empty table has no rows. ``where`` holds
    the state between calls, by default a new folder in the session's shared one; the files that are there must not change,
    and new ones may come. Only the key and the text are read, whatever other columns are called.

    Digests with over a thousandth of all rows, fewer than a thousand of them by arithmetic, are joined by broadcast; texts of
    hits are put together in each task before they are shuffled, so copies do not travel.
    """
    where = where or f"{shared_dir(spark).rstrip('/')}/exact-{uuid.uuid4().hex}"
    feed(spark, path, where, key, text, digest, batch_bytes)
    every = _rows(spark.read.schema(_schema(spark, path, key, text)).parquet(path), key, text, digest)
    if every.isEmpty():  # a stream without rows has written nothing
        return every.select("id", "at", "digest", F.col("id").alias("keep_id"), F.col("at").alias("keep_at"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    known = stored(registry(spark, where))
    total = known.agg(F.sum("n")).first()[0]
    hot = cut(known.where(F.col("n") > max(100, total // SHARE)))

    # The check: hits with more than one text. Rows of hits are found by digest, and equal texts put together before the shuffle.
    warm, cold = _split(every.select("digest", "body"), hot)
    once = known.join(F.broadcast(hot.select("digest")), "digest", "left_anti").where("n > 1").select("digest")
    texts = warm.unionByName(cold.join(once.hint("shuffle_hash"), "digest", "left_semi")).groupBy("digest", "body").agg(F.lit(1).alias("one"))
    clash = cut(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))

    out = lambda df: df.select("id", "at", "digest", F.col("keep.id").alias("keep_id"), F.col("keep.at").alias("keep_at"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep.at")).alias("kept"))
    rows = stored(every.select("id", "at", "digest"))
    warm, cold = _split(rows, hot)
    if clash.isEmpty():
        return out(warm.join(F.broadcast(hot), "digest")).unionByName(out(cold.join(known, "digest")))
    # Unlike texts under one digest: groups are of digest and text, whatever the state says of the digest.
    apart = lambda df: df.join(clash, "digest", "left_anti")
    mixed = stored(every.join(clash, "digest", "left_semi"))
    keep = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "at")).alias("keep")
    own = mixed.groupBy("digest", "body").agg(F.count("*").alias("n"), keep)
    return out(apart(warm).join(F.broadcast(hot), "digest")).unionByName(out(apart(cold).join(known, "digest"))).unionByName(out(mixed.join(own, ["digest", "body"])))


def kept_documents(spark: SparkSession, path: str, decisions: DataFrame) -> DataFrame:
    """All columns of the rows that stay, found by their places; a column of the table may be called ``_metadata``."""
    docs = spark.read.parquet(path)
    meta = docs.metadataColumn("_metadata")
    placed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias("at"))
    return placed.join(decisions.where("kept").select("at"), "at", "left_semi").select("doc.*")
