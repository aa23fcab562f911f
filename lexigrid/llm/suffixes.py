"""Substring deduplication with suffix arrays.

Two places hold the same 50 bytes only if they hold the same anchor, the 20 bytes of least hash in them. So documents are cut
into anchors, and an anchor's context is all bytes of the 50-byte strings that may belong to it. Equal contexts of one anchor
are one string, owned by its smallest document; all other documents lose it. Where an anchor has several distinct contexts,
those that share a 50-byte hash with another go to a suffix array, built in linear time by grouping suffixes by their Lyndon
prefixes, and the runs of its order that share 50 bytes say which bytes go. Equality of contexts is that of some 100 bits of
hashes; whatever an array decides is decided by bytes. An anchor with very many contexts, such as the end of a phrase that a
third of all documents hold, would be more than one task's: its 50-byte strings are dealt out one by one, as 128 bits of
hashes, and counted before they are shuffled.

Hashes travel packed, a row for each group of documents and hash bucket; texts are shuffled by group and read in place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import lookup, mix, powers, prefix_hashes, stored, utf8

#: Bytes of the shortest repeat; bytes of an anchor; text bytes of a group, of a hash bucket, of a stretch that is hashed at once, and of one suffix array.
LEAST, ANCHOR, GROUP, BUCKET, STRETCH, ARRAY = 50, 20, 4 << 20, 8 << 20, 1 << 18, 1 << 18
#: Distinct contexts from which an anchor is dealt out by its strings.
HOT = 20_000
_LAST = (1 << 63) - 1  # stands for a null doc_id


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffix array of small integers of which the last is the only least one, in time linear in the text and the largest integer.

    Groups hold suffixes with equal Lyndon prefixes and are named by their first place in the array. They are taken in
    descending order: each member's previous smaller suffix is reached over pointers of higher groups, and the suffixes so
    reached leave their group for a higher one, by how often they were reached. Then the smallest suffix is emitted; each
    emitted one places those before it, along previous-smaller pointers, at the next place of their groups. Nothing is sorted:
    first groups come from counting, and counts of reaches are gone through from the largest, which the reaches pay for.
    """
    n = len(text)
    places: list[list[int]] = [[] for _ in range(max(text) + 1)]
    for i, c in enumerate(text):
        places[c].append(i)
    members: dict[int, list[int]] = {}
    first_of: dict[int, int] = {}  # by the place after a group, the group
    group, at = [0] * n, 0
    for own in places:
        if own:
            for i in own:
                group[i] = at
            members[at] = own
            first_of[at + len(own)] = at
            at += len(own)
    size = {g: len(m) for g, m in members.items()}
    smaller = [-2] * n  # not known yet
    end = n
    while end > 0:
        g = first_of[end]
        reached: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue
            if smaller[i] == -2:
                waiting: list[tuple[int, int]] = []
                j, p = i, i - 1
                while True:
                    while p >= 0 and group[p] >= g:
                        q = smaller[p]
                        if q == -2:  # one of the same group that stands before: it comes first
                            waiting.append((j, p))
                            j, p = p, p - 1
                        else:
                            p = q
                    smaller[j] = p
                    if not waiting:
                        break
                    j, p = waiting.pop()
            p = smaller[i]
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for p, k in reached.items():
            split.setdefault(group[p], {}).setdefault(k, []).append(p)
        for h, by_count in split.items():
            top = h + size[h]
            for k in range(max(by_count), 0, -1):
                moved = by_count.get(k)
                if moved is None:
                    continue
                if len(moved) == size[h]:  # the whole group shares the longer prefix and keeps its name
                    break
                new = top - len(moved)
                first_of[top] = new
                members[new], size[new] = moved, len(moved)
                size[h] -= len(moved)
                for p in moved:
                    group[p] = new
                top = new
            first_of[top] = h
        end = g
    out, nxt, placed = [0] * n, {g: g for g in size}, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[nxt[g]] = j
            nxt[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def repeated(strings: list[bytes], docs: list[int], least: int = LEAST) -> list[tuple[int, int]]:
    """(string, offset) of each ``least`` bytes that also stand in a string of a smaller document, by one suffix array."""
    n = len(strings)
    joined = b"\0".join(strings) + b"\0"  # one byte for each separator, so that places agree with the text's
    sizes = np.fromiter(map(len, strings), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    text = np.frombuffer(joined, np.uint8).astype(np.int64) + n
    text[ends] = np.arange(n - 1, -1, -1)  # separators differ, and the last is least
    owner = np.repeat(np.arange(n), sizes + 1)
    begin = ends - sizes
    whole = np.array(suffix_array(text.tolist()))
    whole = whole[ends[owner[whole]] - whole >= least].tolist()
    found, run, last = [], [], None
    for p in [*whole, -1]:
        part = joined[p : p + least] if p >= 0 else None
        if part != last:
            if len(run) > 1:
                own = owner[run].tolist()
                low = min(docs[k] for k in own)
                found += [(k, p_ - int(begin[k])) for k, p_ in zip(own, run, strict=True) if docs[k] > low]
            run, last = [], part
        run.append(p)
    return found


def _windowed(h: np.ndarray, w: int, best) -> np.ndarray:
    """The best of each w neighbours, by doubling."""
    span = 1
    while 2 * span <= w:
        h, span = best(h[:-span], h[span:]), 2 * span
    return best(h[: len(h) - (w - span)], h[w - span :]) if w > span else h


class Anchors:
    """The anchors of a group of documents, and the distinct pairs of anchor and context among them."""

    def __init__(self, table: pa.Table, least: int = LEAST, k: int = ANCHOR):
        table = table.combine_chunks()
        ids = table.column("doc_id").fill_null(_LAST).to_numpy()
        order = np.lexsort((table.column("_key").to_numpy(), ids))
        table = table.take(pa.array(order)).combine_chunks()
        self.rows = table
        self.ids = ids[order]
        chunks = table.column("text").chunks
        self.data, self.offsets = utf8(chunks[0] if chunks else pa.array([], pa.string()))
        n, w, parts, last = len(self.data), least - k + 1, [], np.uint64(0xFFFF)
        for a in range(0, n, STRETCH):
            b, low = min(n, a + STRETCH), max(0, a - least)
            high = min(n, b + 2 * least)
            if high - low < least:
                break
            sums = prefix_hashes(self.data[low:high])
            _, down = powers(len(sums))
            h = mix((sums[k:] - sums[:-k]) * down[: len(sums) - k])
            r, t = np.searchsorted(self.offsets, low, "right") - 1, np.searchsorted(self.offsets, high, "left")
            bounds = np.clip(self.offsets[r : t + 1], low, high)
            ends = np.repeat(self.offsets[r + 1 : t + 1], np.diff(bounds))  # of the document around each byte
            lows = _windowed(h, w, np.minimum)
            lows[np.arange(low, low + len(lows)) + least > ends[: len(lows)]] = 0  # no such string inside one document
            around = np.concatenate((np.zeros(w - 1, np.uint64), lows, np.zeros(w - 1, np.uint64)))
            top = _windowed(around, w, np.maximum)
            p = np.flatnonzero((h == top[: len(h)]) & (h > 0))
            p = p[(p >= a - low) & (p < b - low)]
            parts.append((p + low, h[p]))
        self.at, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.hash = mix(self.hash ^ last)  # least hashes are small ones; buckets need all of the range
        self.row = np.searchsorted(self.offsets, self.at, "right") - 1
        self.low = np.maximum(self.offsets[self.row], self.at - (least - k))
        self.high = np.minimum(self.offsets[self.row + 1], self.at + least)
        self.context = self._contexts()
        # One sort brings the places of a pair together, the smallest document first; a pair that a clash of the last bits parts
        # stands twice in the list, which does no harm.
        self.order = np.argsort(self.hash & ~last | self.context & last, kind="stable")
        h, c = self.hash[self.order], self.context[self.order]
        self.new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(h) else np.zeros(0, bool)
        self.first = self.order[self.new]

    def _contexts(self) -> np.ndarray:
        out = np.empty(len(self.at), np.uint64)
        i = 0
        while i < len(self.at):
            base = int(self.low[i])
            j = max(i + 1, int(np.searchsorted(self.high, base + STRETCH, "right")))
            sums = prefix_hashes(self.data[base : self.high[j - 1]])
            _, down = powers(len(sums))
            s, e = self.low[i:j] - base, self.high[i:j] - base
            out[i:j] = mix(mix((sums[e] - sums[s]) * down[s]) + ((e - s) * 64 + (self.at[i:j] - self.low[i:j])).astype(np.uint64))
            i = j
        return out

    def packed(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, hashes, contexts, smallest documents) of the distinct pairs, in order."""
        h, c, ids = self.hash[self.first], self.context[self.first], self.ids[self.row[self.first]]
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(h) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(h)), strict=False):
            yield int(bucket[a]), h[a:b], c[a:b], ids[a:b]


def judge(h: np.ndarray, c: np.ndarray, ids: np.ndarray, hot: int = HOT) -> np.ndarray:
    """For pairs of all groups: 1 if a smaller document has the same pair, plus 2 if the anchor has other contexts and other documents, plus 4 if it has very many."""
    out = np.zeros(len(h), np.uint8)
    if not len(h):
        return out
    order = np.lexsort((ids, c, h))
    h, c, ids = h[order], c[order], ids[order]
    anchor = np.concatenate(([True], h[1:] != h[:-1]))
    pair = anchor | np.concatenate(([True], c[1:] != c[:-1]))
    heads, pairs = np.flatnonzero(anchor), np.flatnonzero(pair)
    which = np.cumsum(anchor) - 1
    owner = ids[pairs][np.cumsum(pair) - 1]
    many = np.add.reduceat(pair.astype(np.int64), heads)
    others = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
    out[order] = (ids != owner) + 2 * ((many > 1) & others)[which].astype(np.uint8) + 4 * ((many > hot) & others)[which].astype(np.uint8)
    return out


def strings_of(contexts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, hash, hash) of every string of ``least`` bytes in each context: the hashes of its two halves."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    sums = prefix_hashes(data)
    _, down = powers(len(sums))
    n = np.maximum(sizes - least + 1, 0)
    of = np.repeat(np.arange(len(contexts)), n)
    off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at, half = off + offsets[of], least // 2
    first, second = (mix((sums[b] - sums[a]) * down[a]).view(np.int64) for a, b in ((at, at + half), (at + half, at + least)))
    return of, off, first, second


def shared_stretches(contexts: list[bytes], hashes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch of each context from its first to its last ``least``-byte hash that another context of its anchor has, too; both 0 without one."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    sums = prefix_hashes(data)
    _, down = powers(len(sums))
    n = np.maximum(sizes - least + 1, 0)
    of = np.repeat(np.arange(len(contexts)), n)
    off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = off + offsets[of]
    w = mix(mix((sums[at + least] - sums[at]) * down[at]) ^ hashes[of])
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    shared = np.zeros(len(w), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    start, end = np.full(len(contexts), np.iinfo(np.int64).max), np.zeros(len(contexts), np.int64)
    np.minimum.at(start, of[shared], off[shared])
    np.maximum.at(end, of[shared], off[shared] + least)
    return np.where(end > 0, start, 0), end


def later_stretches(contexts: list[bytes], hashes: np.ndarray, docs: list[int], least: int = LEAST, array: int = ARRAY) -> list[tuple[int, int, int]]:
    """(context, start, end) of bytes that also stand, ``least`` at a time, in a context of the same anchor and a smaller document.

    Equal shared stretches of an anchor are one string, owned by its smallest document; the owners of an anchor's several strings
    are compared by suffix arrays, many anchors in one.
    """
    start, end = shared_stretches(contexts, hashes, least)
    strings: dict[tuple[int, bytes], list[int]] = {}
    for i in np.flatnonzero(end):
        strings.setdefault((int(hashes[i]), contexts[i][start[i] : end[i]]), []).append(int(i))
    out, owners = [], defaultdict(list)
    for (h, text), own in strings.items():
        low = min(docs[i] for i in own)
        out += [(i, int(start[i]), int(end[i])) for i in own if docs[i] > low]
        owners[h].append((text, low, [i for i in own if docs[i] == low]))
    batch: list[tuple[bytes, int, list[int]]] = []
    size = 0
    for each in [*(x for x in owners.values() if len(x) > 1), []]:
        batch += each
        size += sum(len(x[0]) for x in each)
        if batch and (size >= array or not each):
            for k, off in repeated([x[0] for x in batch], [x[1] for x in batch], least):
                out += [(i, int(start[i]) + off, int(start[i]) + off + least) for i in batch[k][2]]
            batch, size = [], 0
    return out


def find_repeats(docs: DataFrame, least: int = LEAST, group: int = GROUP, bucket: int = BUCKET, array: int = ARRAY, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row; see ``dedup_substrings``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group))
    bits = max(0, (max(1, -(-total // bucket)) - 1).bit_length())
    key = F.xxhash64("doc_id", "text")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"), F.pmod(key, F.lit(groups)).alias("g"))

    def pack(table: pa.Table) -> pa.Table:
        g = table.column("g")[0]
        made = list(Anchors(table, least).packed(bits))
        blobs = [[x[i].tobytes() for x in made] for i in (1, 2, 3)]
        return pa.table({"g": pa.array([g.as_py()] * len(made), pa.int64()), "bucket": pa.array([x[0] for x in made], pa.int64()), "h": pa.array([(x[1] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for x in made], pa.binary()), "c": pa.array(blobs[1], pa.binary()), "ids": pa.array(blobs[2], pa.binary())})

    def rule(table: pa.Table) -> pa.Table:
        h, c, ids = ([np.frombuffer(x, t) for x in table.column(n).to_pylist()] for n, t in (("h", np.uint32), ("c", np.uint64), ("ids", np.int64)))
        out = judge(*(np.concatenate(x) for x in (h, c, ids)), hot)
        parts = np.split(out, np.cumsum([len(x) for x in h])[:-1])
        return pa.table({"g": table.column("g"), "bucket": table.column("bucket"), "flags": pa.array([x.tobytes() for x in parts], pa.binary()), "hot": pa.array([bool((x & 4).any()) for x in parts])})

    packed = base.groupBy("g").applyInArrow(pack, "g long, bucket long, h binary, c binary, ids binary")
    judged = stored(packed.groupBy("bucket").applyInArrow(rule, "g long, bucket long, flags binary, hot boolean"))
    flags = judged.drop("hot")

    def opened(left: pa.Table, right: pa.Table) -> tuple[Anchors, np.ndarray]:
        anchors = Anchors(left, least)
        rows = sorted(zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist(), strict=True), key=lambda x: x[0])
        return anchors, np.frombuffer(b"".join(f for b, f in rows if b >= 0), np.uint8)

    def mixed(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["part", "h", "more", "doc", "g", "row", "low", "bytes"]
        if not left.num_rows:
            return pa.table({n: pa.array([], pa.binary() if n == "bytes" else pa.int64()) for n in names})
        a, flag = opened(left, right)
        pair = np.cumsum(a.new) - 1
        own = ((flag[pair] & 3) == 2) & (a.ids[a.row[a.order]] == a.ids[a.row[a.first]][pair])
        g, parts = left.column("g")[0].as_py(), max(1, total // (8 * array))
        tables = []
        for large in (False, True):
            pick = a.order[own & ((flag[pair] & 4 > 0) == large)]
            contexts = [a.data[s:e].tobytes() for s, e in zip(a.low[pick], a.high[pick], strict=True)]
            place = a.low[pick] - a.offsets[a.row[pick]]
            if large:  # a row for each string, once for each document and place
                of, off, first, second = strings_of(contexts, least)
                columns = [np.full(len(of), -1), first, second, a.ids[a.row[pick]][of], np.full(len(of), g), a.row[pick][of], place[of] + off]
                contexts = [None] * len(of)
            else:
                h = a.hash[pick]
                columns = [h % np.uint64(parts), h.view(np.int64), np.zeros(len(pick)), a.ids[a.row[pick]], np.full(len(pick), g), a.row[pick], place]
            tables.append(pa.table([*(pa.array(x.astype(np.int64)) for x in columns), pa.array(contexts, pa.binary())], names))
        return pa.concat_tables(tables)

    def sort(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        doc, g, row, low = (table.column(n).to_numpy() for n in ("doc", "g", "row", "low"))
        found = later_stretches(table.column("bytes").to_pylist(), h, doc.tolist(), least, array)
        i, start, end = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"g": g[i], "row": row[i], "start": low[i] + start, "end": low[i] + end})

    contexts = base.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(mixed, "part long, h long, more long, doc long, g long, row long, low long, bytes binary")
    if judged.where("hot").isEmpty():
        spans = contexts.groupBy("part").applyInArrow(sort, "g long, row long, start long, end long")
    else:
        contexts = stored(contexts)
        spans = contexts.where("part >= 0").groupBy("part").applyInArrow(sort, "g long, row long, start long, end long")
        strings = contexts.where("part < 0").select("h", "more", "doc", "g", "row", F.col("low").alias("start"))
        first = strings.groupBy("h", "more").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
        later = lookup(strings, stored(first), ["h", "more"]).where(F.col("doc") > F.col("first"))
        spans = spans.unionByName(later.select("g", "row", "start", (F.col("start") + least).alias("end")))
    # Spans travel beside the flags, in rows of bucket -1.
    spans = spans.groupBy("g").agg(F.collect_list(F.struct("row", "start", "end")).alias("spans")).withColumn("bucket", F.lit(-1).cast("long")).withColumn("flags", F.lit(None).cast("binary"))
    signals = flags.withColumn("spans", F.lit(None).cast("array<struct<row:bigint,start:bigint,end:bigint>>")).unionByName(spans)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not left.num_rows:
            return pa.table([pa.array([], left.schema.field("doc_id").type), *(pa.array([], pa.int64()) for _ in range(3)), pa.array([], pa.binary())], names)
        a, flag = opened(left, right)
        pair = np.cumsum(a.new) - 1
        smallest = a.ids[a.row[a.first]][pair]
        gone = a.order[((flag[pair] & 1) == 1) | (a.ids[a.row[a.order]] != smallest)]
        gone = gone[a.high[gone] - a.low[gone] >= least]
        change = np.bincount(a.low[gone], minlength=len(a.data) + 1) - np.bincount(a.high[gone], minlength=len(a.data) + 1)
        spans = right.column("spans").combine_chunks().flatten() if right.num_rows else pa.array([], pa.struct([]))
        if len(spans):
            # Of one pair only its owner is in this list; all others lose the whole context already.
            row, start, end = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("row", "start", "end"))
            change += np.bincount(a.offsets[row] + start, minlength=len(change)) - np.bincount(a.offsets[row] + end, minlength=len(change))
        covered = np.cumsum(change)[:-1] > 0
        edge = covered & ~np.concatenate(([False], covered[:-1])) if len(covered) else covered
        edge[a.offsets[:-1][a.offsets[:-1] < len(edge)]] |= covered[a.offsets[:-1][a.offsets[:-1] < len(edge)]]
        sums, runs = (np.concatenate(([0], np.cumsum(x))) for x in (covered, edge))
        size, removed, n = np.diff(a.offsets), np.diff(sums[a.offsets]), np.diff(runs[a.offsets])
        kept = [a.data[s:e][~covered[s:e]].tobytes() if r else a.data[s:e].tobytes() for s, e, r in zip(a.offsets, a.offsets[1:], removed, strict=False)]
        return pa.table([a.rows.column("doc_id"), pa.array(size), pa.array(removed), pa.array(n), pa.array(kept, pa.binary())], names)

    return base.groupBy("g").cogroup(signals.groupBy("g")).applyInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_substrings(docs: DataFrame, least: int = LEAST, **sizes: int) -> DataFrame:
    """Every row's bytes less those of ``least``-byte strings that also start in a document with a smaller doc_id.

    Returns doc_id (a whole number or null), n_bytes, n_removed, n_spans (runs of removed bytes) and kept_sha256 (lower-case hex
    digits of the rest). Null and empty texts have no bytes. Rows with one doc_id remove nothing from each other; a null doc_id
    counts as the greatest. Strings are judged on the input. ``sizes`` are those of ``find_repeats``, which the result does not depend on.
    """
    return find_repeats(docs, least, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
