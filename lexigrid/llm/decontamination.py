"""Benchmark decontamination by greedy string tiling.

Rolling hashes of five words, taken over every document at once, are looked up among those of the benchmark; a shared run is a
seed. Seeds on one diagonal join into maximal matches. Tiles are laid greedily: the longest match that is free in document and
item is marked, what is left of overlapping matches goes back into the queue, until no match of five words is left. Since tiles
may lie in any order, the share of an item that they cover also finds passages whose parts were moved. An item too short for
a tile is found where all its words stand in a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import LOWER_TABLE, byte_set, cut, gram_hashes, slices, stored, utf8, word_hashes, word_spans

#: Words of the shortest tile; share of an item's words that tiles must cover; bytes of benchmark text that are broadcast at once;
#: words of the shortest item that is looked for at all: one word gives nothing away.
LEAST, COVER, BLOCK_BYTES, SHORTEST = 5, 0.5, 16 << 20, 2
_WORD = byte_set(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_FILTER_BITS = 22


@dataclass
class Index:
    """The items of a benchmark block: their words, and all their grams by hash."""

    ids: list
    words: list[list[bytes]]
    grams: np.ndarray  # sorted
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # by the first bits of a hash: whether any gram has them
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by words of an item below a tile's: sorted hashes, items
    parts: int = 1  # the benchmark's blocks


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, word starts and ends, first word of each text, word hashes."""
    data = LOWER_TABLE[data]
    starts, ends, first = word_spans(data, offsets, _WORD)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def index(ids: list, texts: list[str | None], least: int = LEAST) -> Index:
    data, starts, ends, first, hashes = tokens(*utf8(pa.array(texts, pa.string())))
    words = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first, first[1:], strict=False)]
    grams, doc, place = _grams(hashes, first, least)
    order = np.argsort(grams, kind="stable")
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[grams >> np.uint64(64 - _FILTER_BITS)] = True
    short = {}
    for k in range(SHORTEST, least):
        h, item, _ = _grams(hashes, first, k)
        whole = np.diff(first)[item] == k
        if whole.any():
            by = np.argsort(h[whole], kind="stable")
            short[k] = (h[whole][by], item[whole][by])
    return Index(ids, words, grams[order], doc[order], place[order], seen, short)


def _grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and position of each run of k words inside one text."""
    h = gram_hashes(hashes, k)
    text = np.searchsorted(first, np.arange(len(h)), "right") - 1
    inside = np.arange(len(h)) + k <= first[text + 1] if len(h) else np.zeros(0, bool)
    return h[inside], text[inside], (np.arange(len(h)) - first[text])[inside] if len(h) else np.zeros(0, np.int64)


def maximal(places: list[int], found: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Maximal matches (document position, item position, length) from the item's shared grams, by ascending place, and where the document has each.

    Only the matches that are open at one place are held, so a phrase that both repeat many times takes no more room than its matches.
    """
    out: list[tuple[int, int, int]] = []
    none = np.zeros(0, np.int64)
    last, at, size = -2, none, none
    for q, own in [*zip(places, found, strict=True), (-1, none)]:
        grown = np.full(len(own), least)
        ended = np.ones(len(at), bool)
        if q == last + 1 and len(at) and len(own):
            i = np.minimum(np.searchsorted(at, own - 1), len(at) - 1)
            grows = at[i] == own - 1
            grown[grows] = size[i[grows]] + 1
            ended[i[grows]] = False
        out += [(p + least - n, last + least - n, n) for p, n in zip(at[ended].tolist(), size[ended].tolist(), strict=True)]
        last, at, size = q, own, grown
    return out


def tile(runs: list[tuple[int, int, int]], n_words: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length) from the maximal matches with an item; ties go to the earlier position."""
    heap = [(-n, p, q) for p, q, n in runs]
    heapq.heapify(heap)
    used_p, used_q = np.zeros(max((p + n for p, _, n in runs), default=0), bool), np.zeros(n_words, bool)
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = used_p[p : p + n] | used_q[q : q + n]
        if not taken.any():
            out.append((p, q, n))
            used_p[p : p + n] = used_q[q : q + n] = True
            continue
        free = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for i, j in zip(free[::2].tolist(), free[1::2].tolist(), strict=True):
            if j - i >= least:
                heapq.heappush(heap, (i - j, p + i, q + i))
    return out


def leaks(column: pa.Array, found: Index, least: int = LEAST, cover: float = COVER) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """(row, item number, coverage, tiles) of each row and item whose tiles cover enough of the item."""
    data, starts, ends, first, hashes = tokens(*utf8(column))
    same = lambda r, p, i, q, n: all(data[starts[first[r] + p + j] : ends[first[r] + p + j]].tobytes() == found.words[i][q + j] for j in range(n))
    yield from _short(hashes, first, found, same)
    h = gram_hashes(hashes, least)
    at = np.flatnonzero(found.seen[h >> np.uint64(64 - _FILTER_BITS)])
    row = np.searchsorted(first, at, "right") - 1
    inside = at + least <= first[row + 1]
    at, row = at[inside], row[inside]
    low, high = np.searchsorted(found.grams, h[at], "left"), np.searchsorted(found.grams, h[at], "right")
    met = high > low
    at, row, low, high = at[met], row[met], low[met], high[met]
    if not len(at):
        return
    # A gram that a document repeats meets the items once; where it stands is looked up for those that stay.
    order = np.lexsort((at, low, row))
    at, row, low, high = at[order], row[order], low[order], high[order]
    begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (low[1:] != low[:-1]))))
    until = np.append(begin[1:], len(at))
    n = (high - low)[begin]
    which = np.repeat(np.arange(len(begin)), n)
    slot = low[begin][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    item, place, of = found.item[slot], found.place[slot], row[begin][which]
    order = np.lexsort((place, item, of))
    item, place, of, which = item[order], place[order], of[order], which[order]
    new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (item[1:] != item[:-1]))))
    for a, b in zip(new, [*new[1:], len(of)], strict=False):
        r, i = int(of[a]), int(item[a])
        n_words = len(found.words[i])
        reach = np.zeros(n_words, bool)
        for j in range(least):
            reach[place[a:b] + j] = True
        if reach.sum() < cover * n_words:
            continue
        runs = maximal(place[a:b].tolist(), [at[begin[k] : until[k]] - first[r] for k in which[a:b]], least)
        tiles = [t for t in tile(runs, n_words, least) if same(r, t[0], i, t[1], t[2])]
        share = sum(t[2] for t in tiles) / n_words
        if share >= cover:
            yield r, i, share, sorted(tiles)


def _short(hashes: np.ndarray, first: np.ndarray, found: Index, same) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """Rows in which all words of an item below a tile's length stand in a row, with the first such place."""
    for k, (keys, items) in found.short.items():
        h = gram_hashes(hashes, k)
        low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        at = np.flatnonzero(high > low)
        row = np.searchsorted(first, at, "right") - 1
        done: set[tuple[int, int]] = set()
        for p, r in zip(at.tolist(), row.tolist(), strict=True):
            if p + k > first[r + 1]:
                continue
            for i in items[low[p] : high[p]].tolist():
                if (r, i) not in done and same(r, p - first[r], i, 0, k):
                    done.add((r, i))
                    yield r, i, 1.0, [(int(p - first[r]), 0, k)]


def blocks(benchmark: DataFrame, least: int = LEAST, most: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark in blocks of bounded text, each collected and indexed by itself."""
    rows = benchmark.select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        made = index([r.item_id for r in own], [r.text for r in own], least)
        made.parts = n
        yield made


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, cover: float = COVER, most: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, tiles) of every row of the documents and every item that it gives away.

    Null and empty texts give nothing away. Items of fewer than ``least`` words are found whole, in one tile; items of one word or
    none match nothing. Repeated rows are reported each.
    A benchmark larger than a block is taken in blocks, with one pass over the documents for each.
    """
    kind, item = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind}, item_id {item}, coverage double, n_tiles int, tiles array<struct<doc_word:int,item_word:int,n_words:int>>"
    arrow = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))
    every = []
    for found in blocks(benchmark, least, most):
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "_text"):
                got = list(leaks(b.column("_text"), shared.value, least, cover))
                if got:
                    rows, items, share, tiles = zip(*got, strict=True)
                    names = ("doc_word", "item_word", "n_words")
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("doc_id").take(pa.array(rows)),
                            pa.array([shared.value.ids[i] for i in items], pa.int64() if item == "bigint" else None),
                            pa.array(share, pa.float64()),
                            pa.array([len(t) for t in tiles], pa.int32()),
                            pa.array([[dict(zip(names, x, strict=True)) for x in t] for t in tiles], arrow),
                        ],
                        ["doc_id", "item_id", "coverage", "n_tiles", "tiles"],
                    )

        rows = docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(find, schema)
        if found.parts > 1:  # of several blocks each is evaluated at once, so that one is in memory at a time
            rows = cut(rows)
            shared.destroy()
        every.append(rows)
    if not every:
        return docs.sparkSession.createDataFrame([], schema)
    first = every[0]
    for x in every[1:]:
        first = first.unionByName(x)
    return first


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, cover: float = COVER, most: int = BLOCK_BYTES) -> DataFrame:
    """The documents that give no benchmark item away, in all their columns; null and empty texts stay.

    A benchmark of several blocks is taken block by block: what one leaves is written to the shared folder before the next is
    loaded, so that a worker holds one block at a time.
    """
    out = docs
    for found in blocks(benchmark, least, most):
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                good = np.ones(b.num_rows, bool)
                good[[r for r, *_ in leaks(b.column("text"), shared.value, least, cover)]] = False
                yield b.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
        if found.parts > 1:
            out = stored(out)
            shared.destroy()
    return out
