"""Spelling variants: words one edit apart, found by integer keys of their deletions, and the form that each variant stands for.

Two words of equal length are near if they agree but for one place: both give the same rest with that place deleted. Words whose
lengths differ by one are near if the longer one gives the shorter with a place deleted. So every word has keys: of each place
with its rest, of each rest alone, and of itself whole. Polynomial hashes of all prefixes and suffixes of a batch of words give
them in one vectorised step. Keys are dealt out by their leading bits and sorted, and those that stand alone drop out; whatever
shares a key is compared by its strings. A rest with a place has at most one word for each letter, so groups are small, and each
member learns its number of neighbours and the best of them from the group's order, without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm.common import cut, mix, powers, prefix_hashes, slices, stored, utf8

#: Least code points and occurrences of a word; how many times as frequent its form must be; one run in so many is damaged.
LENGTH, TIMES, RATIO, NOISE = 5, 3, 2, 97
RUNS = r"[a-z\x{C0}-\x{FF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words that are hashed together, and the leading bits of a key by which it is dealt out.
TOGETHER, RADIX_BITS = 1 << 18, 20
_WHOLE, _REST = -1, -1


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; for ASCII the faster function does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_counts(docs: DataFrame, length: int = LENGTH, times: int = TIMES, noise: int = NOISE) -> DataFrame:
    """(word, n) of the words of all documents (doc_id, text, ...), runs of a-z and U+00C0 to U+00FF with A-Z in lower case.

    A run whose crc32 with its doc_id ``noise`` divides loses one code point, which plants variants; 0 plants none. What is left
    counts as a word from ``length`` code points and ``times`` occurrences on. A null text has no words; a null doc_id hashes
    like an empty one. Occurrences are summed in each task before they are shuffled.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(RUNS), F.lit(0))).alias("run"))
    word = F.col("run")
    if noise:
        runs = runs.where(F.length("run") >= length).withColumn("h", F.crc32(F.concat("key", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    found = runs.select(word.alias("word")).where(F.length("word") >= length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of words, all of whose code points are below U+0100."""
    data, offsets = utf8(column)
    lead = data >= 0xC0
    before = np.concatenate(([False], lead[:-1])) if len(data) else lead
    first = np.where(before, data[np.maximum(np.arange(len(data)) - 1, 0)] & 0x1F, 0).astype(np.uint8) if len(data) else data
    codes = np.where(before, (first << 6) | (data & 0x3F), data)[~lead]
    return codes, offsets - np.concatenate(([0], np.cumsum(lead)))[offsets]


def deletion_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, id, slot, at) of the words (id, word): ``at`` is the place that is deleted, or -1 for the whole word; ``slot`` is that place where it belongs to the key, else -1."""
    codes, offsets = _letters(batch.column("word"))
    ids = batch.column("id").to_numpy()
    starts, ends = offsets[:-1], offsets[1:]
    sums, (_, down) = prefix_hashes(codes), powers(len(codes) + 2)
    of = np.repeat(np.arange(len(ids)), ends - starts)
    p = np.arange(len(codes))
    s = starts[of]
    at = (p - s).astype(np.int32)
    rest = (sums[p] - sums[s]) * down[s] + (sums[ends[of]] - sums[p + 1]) * down[s + 1]
    whole = (sums[ends] - sums[starts]) * down[starts]
    # Deleting any letter of a run of one letter leaves the same rest, so the first stands for all.
    first = (at == 0) | (codes != np.concatenate((codes[:1], codes[:-1])))
    placed = mix(mix(rest) ^ (at.astype(np.uint64) + np.uint64(1)))
    key = np.concatenate((placed, mix(rest[first]), mix(whole)))
    same = np.full(int(first.sum()) + len(ids), _REST, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(np.concatenate((ids[of], ids[of[first]], ids))), pa.array(np.concatenate((at, same))), pa.array(np.concatenate((at, at[first], np.full(len(ids), _WHOLE, np.int32))))],
        ["key", "id", "slot", "at"],
    )


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "word", TOGETHER):
        yield deletion_keys(part)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has; a batch's last row waits for the next batch."""
    last, met = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
        key = rows.column("key").to_numpy()
        hit = np.zeros(len(key), bool)
        hit[0] = met
        hit[1:] |= key[1:] == key[:-1]
        hit[:-1] |= key[1:] == key[:-1]
        met, last = bool(hit[-1]), rows.slice(rows.num_rows - 1)
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(hit[:-1]))
    if met:
        yield last


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) of the words (id, word, n) that have near ones; the best is the most frequent, of equals the first by code points."""
    keys = words.select("id", "word").mapInArrow(_hash, "key long, id long, slot int, at int")
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    suspects = dealt.mapInArrow(shared, dealt.schema).select("id", "slot", "at")
    rest = F.when(F.col("at") == _WHOLE, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word"))))
    told = suspects.join(words, "id").select("id", "slot", rest.alias("rest"), F.struct((F.col("at") == _WHOLE).alias("whole"), "n", "word").alias("own"))
    group = Window.partitionBy("slot", "rest")
    down = group.orderBy(F.col("own.whole").desc(), F.col("own.n").desc(), F.col("own.word"))
    seen = told.select("id", "slot", "own", F.count("*").over(group).alias("size"), F.row_number().over(down).alias("rank"), F.first("own").over(down).alias("first"), F.lead("own").over(down).alias("second"))
    all_near = (F.col("slot") != _REST) | F.col("own.whole")  # else only the whole word, which stands first
    near = F.when(all_near, F.col("size") - 1).otherwise(F.col("first.whole").cast("long"))
    best = F.when(F.col("rank") > 1, F.col("first")).otherwise(F.col("second"))
    met = seen.where(near > 0).select("id", near.alias("near"), F.struct((-best["n"]).alias("less"), best["word"].alias("word")).alias("best"))
    sums = met.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return sums.select("id", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the links (word, form), which lead to ever more frequent words: each step doubles how far a word looks."""
    up = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = cut(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words with their counts (word, n), each word once.

    Near words differ by exactly one code point that is inserted, deleted or replaced. A word's form is its most frequent near
    word, of equals the first by code points, if that is at least ``ratio`` times as frequent, else null; its root is where
    forms lead, itself without one. All code points must be below U+0100. An empty table has no words.
    """
    words = stored(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"))  # ids hold because they are written down
    near = neighbours(words)
    formed = F.col("best_n") >= ratio * F.col("n")
    known = stored(words.join(near, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    found = roots(known.where(F.col("form").isNotNull()))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, length: int = LENGTH, times: int = TIMES, ratio: int = RATIO, noise: int = 0) -> DataFrame:
    """The spelling variants of all words of the documents (doc_id, text, ...): see ``word_counts`` and ``variants``."""
    return variants(word_counts(docs, length, times, noise), ratio)
