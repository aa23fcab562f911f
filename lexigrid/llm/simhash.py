"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints that differ in few bits agree on all bits of some segments, so each is dealt out once for every choice of segments,
with the chosen bits moved to the front, and only meets those that share them. Where too many share them, they are dealt out
again by segments of the rest. A task builds a trie of its fingerprints and walks the subtries of shared bits, node pair by
node pair and many pairs at a time: it adds up the differing bits and drops a pair once they exceed the budget, or once both
nodes already lie in one component. It hands on a spanning forest of its links, never the links, and alternating stars join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import LOWER, connected_components, cut, lookup, mix, slices

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints that share their chosen bits, on average, at most, and in any case, at most; fingerprints of a task's trie.
GROUP, HOT, BATCH = 1024, 65536, 8192
#: Bytes of text that are taken apart at once, for a word takes some 100 bytes as an object; node pairs that are compared at once; size product below which a node pair is compared directly.
STRETCH, CHUNK, DIRECT = 1 << 19, 1 << 18, 16


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the XXH64 values of the shingles; no words: 0."""
    return simhashes(text, shingle, seed, 1)[0]


def simhashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED, families: int = 1, whole: int = 0) -> list[int]:
    """SimHashes of one text by several hash functions: XXH64 itself, then finalisers of it that do not depend on each other.

    A text of fewer than ``whole`` shingles, of which one more or less makes another text, has the hash of all its words instead.
    """
    words = text.translate(LOWER).split()
    if not words:
        return [0] * families
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros((families, 64), np.int64)
    if len(starts) < whole:
        starts, ends = [0], [len(joined)]
    for at in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        for f in range(families):
            own = mix(h + np.uint64(f)) if f else h
            ones[f] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1).tolist()


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE, families: int = 1, whole: int = 0) -> DataFrame:
    """(doc_id, ``keep`` columns, fp long, and fp1, fp2, ... of further families) of every row; the text is read whole and is not carried further."""
    names, prints = ["doc_id", *keep], ["fp", *(f"fp{f}" for f in range(1, families))]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{c} long" for c in prints]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", STRETCH):
            found = np.array([simhashes(t or b"", shingle, SEED, families, whole) for t in b.column("_text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found.T)], [*names, *prints])

    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, ", ".join(fields))


class Trie:
    """The nodes of a binary trie over sorted distinct integers, level by level from a first depth until all are leaves: bounds and children."""

    def __init__(self, a: np.ndarray, depth: int):
        self.levels, self.last = {}, 64
        same = np.full(len(a), -1, np.int64)  # leading bits shared with the one before
        if len(a) > 1:
            x = a[1:] ^ a[:-1]
            top = np.zeros(len(x), np.int64)
            for shift in (32, 16, 8, 4, 2, 1):
                high = (x >> np.uint64(shift)) != 0
                top += shift * high
                x = np.where(high, x >> np.uint64(shift), x)
            same[1:] = 63 - top
        starts = np.flatnonzero(same < depth).astype(np.int32)
        for d in range(depth, 65):
            ends = np.append(starts[1:], len(a)).astype(np.int32)
            if d == 64 or len(starts) == len(a):
                self.levels[d], self.last = (starts, ends - starts, starts, starts), d
                break
            nxt = np.flatnonzero(same <= d).astype(np.int32)
            first = np.searchsorted(nxt, starts).astype(np.int32)
            one = (a[starts] >> np.uint64(63 - d)) & np.uint64(1) == 1
            two = np.append(nxt, len(a))[first + 1] < ends
            self.levels[d] = (starts, ends - starts, np.where(one, -1, first), np.where(one, first, np.where(two, first + 1, -1)))
            starts = nxt


class Union:
    """Components over positions, labelled by their smallest one."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.steps = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != (up := self.label[self.label])).any():
                self.label = up
        self.steps = np.cumsum(np.concatenate(([0], self.label[1:] != self.label[:-1])))


def join_tries(a: np.ndarray, depth: int, budget: int) -> Union:
    """Components of the links of at most ``budget`` differing bits among those of sorted integers that share their first ``depth`` bits."""
    trie, union = Trie(a, depth), Union(len(a))
    roots = np.arange(len(trie.levels[depth][0]), dtype=np.int32)
    stack = [(depth, roots, roots, np.zeros(len(roots), np.int8))]
    while stack:
        d, ia, ib, c = stack.pop()
        if len(ia) > CHUNK:
            stack.append((d, ia[CHUNK:], ib[CHUNK:], c[CHUNK:]))
            ia, ib, c = ia[:CHUNK], ib[:CHUNK], c[:CHUNK]
        start, n, left, right = trie.levels[d]
        first, last, other, end = start[ia], start[ia] + n[ia] - 1, start[ib], start[ib] + n[ib] - 1
        known = (union.steps[first] == union.steps[last]) & (union.steps[other] == union.steps[end]) & (union.label[first] == union.label[other])
        if known.any():
            ia, ib, c = ia[~known], ib[~known], c[~known]
        if not len(ia):
            continue
        size = n[ia].astype(np.int64) * n[ib]
        small = (size <= DIRECT) | (d == trie.last)
        if small.any():
            x, y, many, wide = ia[small], ib[small], size[small], n[ib[small]]
            which = np.repeat(np.arange(len(x)), many)
            off = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            up = off // wide[which]
            i, j = start[x][which] + up, start[y][which] + off - up * wide[which]
            near = (np.bitwise_count(a[i] ^ a[j]) <= budget) & (i < j)
            if near.any():
                union.add(i[near], j[near])
            ia, ib, c = ia[~small], ib[~small], c[~small]
        if not len(ia):
            continue
        pairs = []
        for x, y, more in ((left, left, 0), (right, right, 0), (left, right, 1), (right, left, 1)):
            p, q = x[ia], y[ib]
            ok = (p >= 0) & (q >= 0) & (c + more <= budget)
            if x is right and more:
                ok &= ia != ib
            pairs.append((p[ok], q[ok], c[ok] + np.int8(more)))
        nxt = [np.concatenate(z) for z in zip(*pairs, strict=True)]
        if len(nxt[0]):
            stack.append((d + 1, *nxt))
    return union


def scheme(n: int, budget: int, group: int = GROUP) -> tuple[int, int]:
    """Segments of 64 bits, and how many of them two fingerprints must share: the fewest for groups of that size."""
    for shared in range(1, 5):
        if n <= group << (shared * (64 // (budget + shared))):
            break
    return budget + shared, shared


def views(value: Column, free: int, segments: int, shared: int) -> list[Column]:
    """The value with each choice of segments of its last ``free`` bits moved up behind the bits before them."""
    width, out = free // segments, []
    for chosen in combinations(range(segments), shared):
        rest = [(k * width, width) for k in range(segments) if k not in chosen] + [(segments * width, free - segments * width)]
        at, made = 64, F.lit(0).cast("long")
        for low, wide in [(free, 64 - free), *((k * width, width) for k in chosen), *rest]:
            at -= wide
            if wide:
                part = F.shiftrightunsigned(value, low) if low + wide == 64 else F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << wide) - 1))
                made = made.bitwiseOR(F.shiftleft(part, at))
        out.append(made)
    return out


def links(prints: DataFrame, budget: int = BUDGET, group: int = GROUP, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """Edges (u, v) that span the components of distinct fingerprints (fp long) linked at ``budget`` or fewer differing bits."""
    rows = prints.select("fp", F.col("fp").alias("value"), F.lit(0).cast("long").alias("view"))
    return view_links(rows, prints.count(), 1, budget, group, hot, batch)


def view_links(rows: DataFrame, n: int, several: int, budget: int = BUDGET, group: int = GROUP, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """Edges (u, v) between the fp of rows (fp, value, view) of one view whose values are linked; a view has each value once.

    ``several`` views stand side by side in one plan, the largest with n rows. Of budget + k segments two linked values share k,
    so both stand in that choice's group. A group of more than ``hot`` is dealt out again by one of budget + 1 segments of the
    bits it does not share, until none is larger; fewer than log2(hot) bits can't hold more.
    """
    free, out = 64, None
    segments, shared = scheme(n, budget, group)
    while True:
        choices = F.array(*(F.struct((F.col("view") * 1000 + k).alias("view"), v.alias("value")) for k, v in enumerate(views(F.col("value"), free, segments, shared))))
        dealt = rows.select("fp", F.explode(choices).alias("x")).select("fp", "x.view", "x.value")
        free -= shared * (free // segments)
        dealt = dealt.withColumn("top", F.shiftrightunsigned("value", free))
        large = None
        if n > hot and free > hot.bit_length() - 1:
            # No more than dealt rows / hot: for each, that many rows share their bits.
            large = cut(dealt.groupBy("view", "top").count().where(F.col("count") > hot).select("view", "top"))
            if large.isEmpty():
                large = None
        calm = dealt if large is None else dealt.join(F.broadcast(large), ["view", "top"], "left_anti")
        found = _walked(calm, 64 - free, budget, max(1, n // batch), several)
        out = found if out is None else out.unionByName(found)
        if large is None:
            return out
        rows = dealt.join(F.broadcast(large), ["view", "top"], "left_semi").select("fp", "value", "view")
        segments, shared = budget + 1, 1


def _walked(dealt: DataFrame, depth: int, budget: int, batches: int, several: int) -> DataFrame:
    """Groups by view and leading bits, many in one batch, and each batch in one trie."""

    def walk(table: pa.Table) -> pa.Table:
        value, fp = (table.column(c).to_numpy() for c in ("value", "fp"))
        value = value.view(np.uint64)
        order = np.argsort(value)
        union = join_tries(value[order], depth, budget)
        # The least fp is the centre whatever the view, so that views mostly find the same edges.
        own, least = fp[order], fp[order]
        np.minimum.at(least, union.label, own)
        centre = least[union.label]
        child = own != centre
        return pa.table({"u": own[child], "v": centre[child]})

    rows = dealt.select("view", F.pmod(F.xxhash64("top"), F.lit(batches)).alias("batch"), "value", "fp")
    # A stated number of partitions: the rows are few bytes and much work, so adaptive execution must not merge them.
    tasks = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4000, several * batches))
    return rows.repartition(tasks, "view", "batch").groupBy("view", "batch").applyInArrow(walk, "u long, v long")


def family_links(prints: DataFrame, families: int, budget: int = BUDGET) -> DataFrame:
    """Edges (u, v) between values of fp whose rows are linked in any family: (fp, fp1, ...) of every row.

    In each family the least fp of a fingerprint stands for it, so links carry over to values of fp. All families are views of
    one plan, since a plan of its own for each takes much of the driver's memory.
    """
    names = ["fp", *(f"fp{f}" for f in range(1, families))]
    every = F.explode(F.array(*(F.struct(F.lit(f).cast("long").alias("view"), F.col(c).alias("value")) for f, c in enumerate(names))))
    own = cut(prints.select("fp", every.alias("x")).select("fp", "x.view", "x.value").distinct())
    least = cut(own.groupBy("view", "value").agg(F.min("fp").alias("rep")))
    n = max((r["count"] for r in least.groupBy("view").count().collect()), default=0)
    near = view_links(least.select(F.col("rep").alias("fp"), "value", "view"), n, families, budget)
    star = lookup(own.where("view > 0"), least.where("view > 0"), ["view", "value"]).select(F.col("fp").alias("u"), F.col("rep").alias("v"))
    return star.where("u <> v").unionByName(near)


def near_duplicates(docs: DataFrame, *keep: str, budget: int = BUDGET, shingle: int = SHINGLE, families: int = 1, whole: int = 0) -> DataFrame:
    """(doc_id, ``keep`` columns, fp, root, component_id) of every row; component_id is the smallest doc_id that links of near fingerprints reach.

    ``root`` is a fingerprint that stands for the component. Several families of fingerprints link what any of them links, so
    that fewer near copies escape; with ``whole`` texts of fewer shingles are linked to equal ones only. Null text counts as empty;
    texts without words have fingerprint 0 and are linked like any other. Rows with the same doc_id stay as they are, each with
    its own fingerprint. A null doc_id is never a component_id unless a component has no other. A fingerprint of which a third of
    all rows is a copy is one row among the links; near copies in any number are dealt out until a task holds ``HOT``.
    Tables may be empty and may have more columns, which are not carried.
    """
    prints = cut(fingerprints(docs, *keep, shingle=shingle, families=families, whole=whole))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(reps.select("fp"), budget) if families == 1 else family_links(prints, families, budget)
    roots = connected_components(edges)
    owned = cut(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    lowest = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    of = lookup(owned.select("fp", "root"), lowest, "root").select("fp", "root", "component_id")
    return lookup(prints, cut(of), "fp").select("doc_id", *keep, "fp", "root", "component_id")
