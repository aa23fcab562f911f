"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. A bucket whose rows exceed the byte limit splits on one more bit;
all others stay, so a shard's depth follows the data. The split is found from byte sums of hash cells: rows are summed once by
a prefix somewhat longer than the shards need, the sums are rolled up to all shorter prefixes, and each cell takes the shortest
prefix that fits. Only cells that exceed the limit by themselves go into another round with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import cut

#: Bytes a shard holds at most; bits of a row's hash, of which the first are the key's; bits more than shards need in the first
#: round, and in each later one; most in one round; bits up to which the table of cells, 65,536 rows, is broadcast.
LIMIT, BITS, KEY_BITS, EXTRA, STEP, MOST, BROADCAST_BITS = 16 << 20, 60, 32, 4, 8, 20, 16


def route(key: str = "doc_id", text: str = "text") -> Column:
    """60 bits: 32 of the key, then 28 that tell rows with equal keys apart, by their text and their place in the table."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    high = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    low = F.xxhash64(F.xxhash64(text), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << (BITS - KEY_BITS)) - 1))
    return F.shiftleft(high, BITS - KEY_BITS).bitwiseOR(low)


def _prefix(bits: int) -> Column:
    return F.shiftright("_route", BITS - bits)


def _leaves(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes, shard_rows) of each cell of ``high`` bits; depth is null where the cell alone exceeds the limit."""
    cells = rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("n"))
    spread = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("node", F.expr(f"shiftright(cell, {high} - depth)"))
    nodes = spread.groupBy("depth", "node").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS))
    best = spread.join(fits, ["depth", "node"], "left").groupBy("cell")
    first = F.min(F.when(F.col("shard_rows").isNotNull(), F.struct("depth", "shard_bytes", "shard_rows")))
    return best.agg(first.alias("leaf")).select("cell", "leaf.*")


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All columns of the documents (doc_id, text, ...) and n_bytes, shard (its hash prefix, in bits), depth, shard_bytes, shard_rows.

    A null text has no bytes and a null doc_id hashes like an empty one. Rows with one doc_id stay together until their bucket
    is too large at 32 bits; then they part by text and place. One row beyond the limit has a shard for itself; an empty table
    has no shard, and a table within the limit one, with depth 0. Rows that 60 bits can't part into fitting shards raise ``ValueError``. The table is read twice, so it should be a stored one.
    Columns named like the new ones are replaced.
    """
    added = ["n_bytes", "shard", "depth", "shard_bytes", "shard_rows"]
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*kept).alias("_row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes"), route().alias("_route"))
    narrow = rows.select("_bytes", "_route")
    total = narrow.agg(F.sum("_bytes")).first()[0] or 0
    high = min(MOST, max(1, math.ceil(math.log2(max(1, total / limit))) + EXTRA))
    low, out = 0, None
    while True:
        leaves = cut(_leaves(narrow, low, high, limit))
        if high == BITS and not leaves.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).isEmpty():
            raise ValueError(f"rows that agree in all {BITS} bits of their hashes have more than {limit} bytes")
        done = leaves.where("depth is not null")
        if high <= BROADCAST_BITS:  # no more cells than that many bits can tell apart
            done = F.broadcast(done)
        met = rows.withColumn("_cell", _prefix(high)).join(done.withColumnRenamed("cell", "_cell"), "_cell")
        bits = F.lpad(F.conv(F.expr(f"shiftright(_route, {BITS} - depth)").cast("string"), 10, 2), F.col("depth"), "0")
        met = met.select(*(F.col("_row")[c].alias(c) for c in kept), F.col("_bytes").alias("n_bytes"), F.when(F.col("depth") == 0, "").otherwise(bits).alias("shard"), "depth", "shard_bytes", "shard_rows")
        out = met if out is None else out.unionByName(met)
        deep = leaves.where("depth is null").select(F.col("cell").alias("_cell"))
        if deep.isEmpty():
            return out
        narrow = narrow.withColumn("_cell", _prefix(high)).join(deep, "_cell", "left_semi").drop("_cell")
        rows = rows.withColumn("_cell", _prefix(high)).join(deep, "_cell", "left_semi").drop("_cell")
        low, high = high + 1, min(BITS, high + STEP)


def directory(sharded: DataFrame) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows, first_entry, entries): the entries of a directory of the greatest depth that lead to each shard."""
    buckets = sharded.select("shard", "depth", "shard_bytes", "shard_rows").distinct()
    deepest = buckets.agg(F.max("depth").alias("_deepest"))
    entries = F.expr("cast(power(2, _deepest - depth) as bigint)")
    first = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.conv("shard", 2, 10).cast("long")) * entries
    return buckets.join(F.broadcast(deepest)).select(*buckets.columns, first.alias("first_entry"), entries.alias("entries"))
