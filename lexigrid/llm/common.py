"""Helpers that the corpus operators share: cutting lineage, joins with hot keys, and byte-level word tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker looks at together.
SLICE_BYTES = 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ODD = 0x9E3779B97F4A7C15  # 2^64 over the golden ratio
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lexigrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint: evaluated once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read from Parquet files in the shared folder: like ``cut``, but compressed and with columns to choose from.

    The files stay until whoever owns the folder clears it, since the result may be read at any time. While they are written,
    the session has the setting that drops shuffle files with their query; it is put back as it was.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this write are of no use after it
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of the table has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], share: int = 1000) -> DataFrame:
    """Left join with a table that has each key once, where a few keys may hold most rows of the left.

    Keys with more than 1/share of the left rows, fewer than ``share`` by arithmetic, are joined by broadcast; the rest by
    shuffle. ``left`` is read several times, so it should be cheap to read (checkpointed or a narrow scan).
    """
    key = [key] if isinstance(key, str) else key
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = left.count()
    hot = cut(counts.where(F.col("_n") > max(100, total // share)).select(key).join(right, key))
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(1))), key, "left")
    names = [*left.columns, *(c for c in right.columns if c not in key)]
    warm = marked.where(F.col("_hot").isNotNull()).select(names)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, "left").select(names)
    return warm.unionByName(cold)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), root being the smallest node it reaches; alternating large and small stars."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(e)
    while seen[0]:
        # Each edge has u > v, so it moves once: to what is least of v and v's smaller neighbours.
        low = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        # Both ends come from one row: a union would put all that is below it into the plan twice.
        small = linked.select("m", F.explode(F.array("u", "v")).alias("u")).select("u", F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most so many bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_M1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_M2)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and those of its inverse."""
    up, down = _POWERS.get("up", ()), _POWERS.get("down", ())
    if len(up) < n:
        made = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        up, down = made
        if n <= SLICE_BYTES + (1 << 12):  # those of a giant text are not kept
            _POWERS.update(up=up, down=down)
    return up[:n], down[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix sums: substring [s, e) hashes to (sums[e] - sums[s]) times the inverse power s."""
    up, _ = powers(max(1, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each document, and each document's first word (one entry more at the end)."""
    word = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1] if len(data) else word
    after = np.concatenate((word[1:], [False])) & ~edge[1:] if len(data) else word
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, in stretches of bounded memory."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        sums = prefix_hashes(data[base : ends[j - 1]])
        _, down = powers(len(sums))
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (the caller leaves out those that cross documents)."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_ODD) + words[j : j + n]
    return mix(h)


def byte_set(pattern_bytes: bytes, invert: bool = False) -> np.ndarray:
    """A lookup table over bytes: True for those named (or for all others)."""
    found = np.zeros(256, bool)
    found[list(pattern_bytes)] = True
    return ~found if invert else found


SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_SPACE = byte_set(SPACES, invert=True)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOWER_TABLE = np.frombuffer(LOWER, np.uint8)
