"""Mixing sources to target weights, block by block.

Each source's documents stand in a fixed pseudorandom order as one stream of words, cut into blocks of ``BLOCK`` words. Output
shards have ``SHARD`` slots; each draws its sources from a multinomial distribution. The slots of a source are numbered over
all shards, and slot j of a source with n blocks takes block perm(j mod n) of epoch j div n, where perm is a keyed permutation
of the indices that is computed, not stored. Slots drawn beyond a source's quota pass to sources drawn too seldom, and the last
slot of a source is cut, so a source gives its target to the word. Blocks and slots meet in a join by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm.common import NOT_SPACE, cut, mix, slices, unused, utf8, word_spans

#: Words of a block, slots of an output shard, documents of a bucket of a source, sources at most.
BLOCK, SHARD, BUCKET, SOURCES = 256, 4096, 1000, 10_000
WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 17


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words each source is to give: shares of ``share`` times all words by weight, none above ``most`` times its source's words."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        full = {i for i in open_ if left * w[i] / total >= most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else left * w[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of range(n), or its inverse: a Feistel network over the next even power of two, walked until inside."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    rounds = [mix(np.array([(key * 0x9E3779B97F4A7C15 + r) % (1 << 64)], np.uint64))[0] for r in range(6)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for k in rounds[::-1] if back else rounds:
            a, b = (b ^ (mix(a ^ k) & low), a) if back else (b, a ^ (mix(b ^ k) & low))
        return a << np.uint64(half) | b

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


class Quota:
    """What one source gives: whole epochs, then ``rest`` words of one more, in ``slots`` slots."""

    def __init__(self, sid: int, size: int, target: float, block: int = BLOCK, seed: int = SEED):
        self.sid, self.size, self.block, self.seed = sid, size, block, seed
        self.blocks = -(-size // block)
        words = math.floor(target + 0.5)
        self.epochs, self.rest = divmod(words, size) if size else (0, 0)
        self.short = self.blocks * block - size  # words the last block lacks
        self.last = int(permute(np.array([self.blocks - 1]), self.blocks, self.key(self.epochs), back=True)[0]) if size else 0
        more = -(-self.rest // block)
        self.slots = self.epochs * self.blocks + (more if more <= self.last else -(-(self.rest + self.short) // block)) if size else 0

    def key(self, epoch: int) -> int:
        return (self.seed << 40) + (self.sid << 8) + epoch

    def deal(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Epoch, block and words taken from the block's start, by slot number."""
        epoch, at = np.divmod(j, self.blocks)
        block, take = np.empty_like(j), np.full(len(j), self.block, np.int64)
        for e in np.unique(epoch):
            own = epoch == e
            block[own] = permute(at[own], self.blocks, self.key(int(e)))
        take[block == self.blocks - 1] -= self.short
        cut_ = epoch == self.epochs
        start = at[cut_] * self.block - self.short * (at[cut_] > self.last)
        take[cut_] = np.clip(self.rest - start, 0, take[cut_])
        return epoch, block, take


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        data, offsets = utf8(b.column("_text"))
        _, _, first = word_spans(data, offsets, NOT_SPACE)
        keep = [c for c in b.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(first))], [*keep, "size"])


class Mix:
    """The mix of a table of documents (doc_id, text, source): quotas, pieces of documents in blocks, and slots."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST, bucket: int = BUCKET):
        spark = docs.sparkSession
        self.block = block
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.select("doc_id", "source", F.xxhash64("text").alias("_h"), F.col("text").alias("_text"))
        sized = rows.mapInArrow(_sizes, f"doc_id {kind}, source string, _h long, size long")
        # Equal rows become one item with a count, so that the order is one and the same in each run.
        items = cut(sized.groupBy("source", "doc_id", "_h", "size").count())
        found = items.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("size"), F.sum("count").alias("n")).limit(SOURCES + 1).collect()
        if len(found) > SOURCES:
            raise ValueError(f"more than {SOURCES} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        goal = targets([r["size"] for r in found], weights, share, most)
        self.quotas = [Quota(i, r["size"], t, block, seed) for i, (r, t) in enumerate(zip(found, goal, strict=True))]
        self.sources = spark.createDataFrame([(i, r.source, r["size"], t) for i, (r, t) in enumerate(zip(found, goal, strict=True))], "sid int, source string, source_size long, target double")
        buckets = max(1, sum(r.n for r in found) // bucket)
        # At most SOURCES rows.
        items = items.join(F.broadcast(self.sources.select("sid", F.col("source").alias("_s"))), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
        items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_h", F.lit(seed)), F.lit(buckets)))
        words = F.col("size") * F.col("count")
        before = items.groupBy("sid", "bucket").agg(F.sum(words).alias("words"))
        before = before.select("sid", "bucket", (F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")).alias("base"))
        inner = F.sum(words).over(Window.partitionBy("sid", "bucket").orderBy("doc_id", "_h", "size").rowsBetween(Window.unboundedPreceding, 0)) - words
        placed = items.withColumn("inner", inner).join(before, ["sid", "bucket"])
        placed = placed.select("sid", "doc_id", "_h", "size", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy", "_"), (F.col("base") + F.col("inner")).alias("start"))
        self.documents = cut(placed.select("sid", "doc_id", "_h", "size", "copy", (F.col("start") + F.col("copy") * F.col("size")).alias("start")))
        self.slots = self._slots(spark, shard, seed)

    def _slots(self, spark, shard: int, seed: int) -> DataFrame:
        """(shard, sid, epoch, block, take): what each slot of the mix takes."""
        quotas, total = self.quotas, sum(q.slots for q in self.quotas)
        p = np.array([q.slots for q in quotas]) / max(1, total)

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for k in f["id"]:
                    n = np.random.default_rng([seed, int(k)]).multinomial(min(shard, total - int(k) * shard), p)
                    yield pd.DataFrame({"shard": int(k), "sid": np.arange(len(p), dtype=np.int32), "n": n}).query("n > 0")

        shards = -(-total // shard)
        drawn = spark.range(shards).repartition(max(1, min(shards, 1000)), "id").mapInPandas(draw, "shard long, sid int, n long")
        drawn = cut(drawn.withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")))
        got = {r.sid: r.n for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).collect()}  # one row for each source
        over = np.cumsum([0, *(max(0, got.get(q.sid, 0) - q.slots) for q in quotas)])
        under = np.cumsum([0, *(max(0, q.slots - got.get(q.sid, 0)) for q in quotas)])

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples():
                    j = np.arange(r.before, r.before + r.n)
                    spare = j >= quotas[r.sid].slots
                    sid = np.full(len(j), r.sid)
                    rank = over[r.sid] + j[spare] - quotas[r.sid].slots
                    sid[spare] = np.searchsorted(under, rank, "right") - 1
                    j[spare] = rank - under[sid[spare]] + np.array([got.get(int(s), 0) for s in sid[spare]], np.int64)
                    for s in np.unique(sid):
                        epoch, block, take = quotas[s].deal(j[sid == s])
                        yield pd.DataFrame({"shard": r.shard, "sid": np.int32(s), "epoch": epoch, "block": block, "take": take})

        # Few rows turn into many here: they are dealt out first, and the join below must not take the result for small.
        dealt = drawn.repartition(max(1, min(shards // 4, 4000)), "shard")
        return dealt.mapInPandas(deal, "shard long, sid int, epoch long, block long, take long")

    def pieces(self) -> DataFrame:
        """(sid, doc_id, _h, size, copy, epoch, lo, hi): words [lo, hi) of a document that a slot takes."""
        of = self.documents.where("size > 0")
        last = F.floor((F.col("start") + F.col("size") - 1) / self.block)
        of = of.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / self.block), last)))
        origin = F.col("block") * self.block - F.col("start")  # the block's first word, counted in the document
        met = of.join(self.slots.hint("merge"), ["sid", "block"])
        met = met.withColumn("lo", F.greatest(F.lit(0), origin)).withColumn("hi", F.least(F.col("size"), origin + F.col("take")))
        return met.where("hi > lo").select("sid", "doc_id", "_h", "size", "copy", "epoch", "lo", "hi")

    def taken(self) -> DataFrame:
        """(doc_id, size, source, source_size, target, taken) of every row."""
        key = ["sid", "doc_id", "_h", "size", "copy"]
        zero = self.documents.select(*key, F.lit(0).cast("long").alias("words"))
        some = self.pieces().select(*key, (F.col("hi") - F.col("lo")).alias("words"))
        sums = zero.unionByName(some).groupBy(*key).agg(F.sum("words").alias("taken"))
        return sums.join(F.broadcast(self.sources), "sid").select("doc_id", "size", "source", "source_size", "target", "taken")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of every row of the documents.

    Null text has size 0; such rows stay with 0 words taken. The null source is a source like any other, the last one. Rows
    that are equal in doc_id, source and text are interchangeable, and each has its own share. An empty table gives no rows.
    """
    return Mix(docs, **options).taken()


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of the documents: for each epoch, the words of a document that the mix takes.

    A text taken whole stays as it is; else its taken stretches are joined by a line break. Documents of which nothing is
    taken are left out; n_chars, where there is such a column, is that of the new text.
    """
    made = Mix(docs, **options)
    spans = made.pieces().groupBy("doc_id", "_h", "sid", "size", "copy", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_spans"))
    spans = spans.join(F.broadcast(made.sources.select("sid", F.col("source").alias("_source"))), "sid")
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("_h").alias("_hash"), "_source", F.col("size").alias("_size"), "_spans")
    key, size_, takes = unused(docs, "_key", "_size", "_spans")
    keyed = docs.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", "source", key])
    joined = keyed.join(spans, (keyed[key] == spans["_hash"]) & keyed["doc_id"].eqNullSafe(spans["_doc"]) & keyed["source"].eqNullSafe(spans["_source"]))
    columns = docs.columns
    schema = docs.schema

    def cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = utf8(b.column("text"))
            starts, ends, first = word_spans(data, offsets, NOT_SPACE)
            texts = []
            for i, (size, spans_) in enumerate(zip(b.column(size_).to_pylist(), b.column(takes).to_pylist(), strict=True)):
                joined_: list[list[int]] = []
                for x in spans_:
                    if joined_ and joined_[-1][1] >= x["lo"]:
                        joined_[-1][1] = max(joined_[-1][1], x["hi"])
                    else:
                        joined_.append([x["lo"], x["hi"]])
                if joined_ == [[0, size]]:
                    texts.append(data[offsets[i] : offsets[i + 1]].tobytes().decode())
                else:
                    texts.append("\n".join(data[starts[first[i] + lo] : ends[first[i] + hi - 1]].tobytes().decode() for lo, hi in joined_))
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                new["n_chars"] = pa.array([len(t) for t in texts], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in columns], columns)

    return joined.select(*(keyed[c] for c in columns), spans["_size"].alias(size_), spans["_spans"].alias(takes)).mapInArrow(cut_text, schema)
