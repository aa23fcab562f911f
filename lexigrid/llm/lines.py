"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines of a document are hashed to 128 bits. A window that stands earlier, in a document with a smaller
doc_id or further up in the same one, makes all three lines of each later occurrence go; covered positions are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import lookup, slices, stored, unused, utf8

WINDOW = 3


def repeats(rows: DataFrame) -> DataFrame:
    """(_doc, _of, starts) of the documents (doc_id, _key, _text) with windows that stand earlier, by the line at which each starts."""
    lines = rows.withColumn("_lines", F.split("_text", "\n")).where(F.size("_lines") >= WINDOW)
    at = lambda i: [F.get("_lines", i + j) for j in range(WINDOW)]
    hashed = F.transform(F.sequence(F.lit(0), F.size("_lines") - WINDOW), lambda i: F.struct(i.alias("at"), F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit(1), *at(i)).alias("h2")))
    windows = stored(lines.select("doc_id", "_key", F.inline(hashed)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = lookup(windows, stored(first), ["h1", "h2"]).where(F.col("first").isNotNull())
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "at")
    return met.where(own > F.col("first")).groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_of")).agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with text less its repeated lines, and n_lines, n_removed and n_spans (runs of removed lines).

    Null text stays null with no lines; an empty text has one line. A document of fewer than three lines keeps them all. Rows
    equal in doc_id and text count as one document, so none of them is earlier than another; a null doc_id comes last. A text
    whose lines all go is empty. Columns named like the new ones are replaced.
    """
    added = ("n_lines", "n_removed", "n_spans")
    kept = [c for c in docs.columns if c not in added]
    key, begins = unused(docs, "_key", "_starts")
    rows = docs.select(*kept).withColumn(key, F.xxhash64("doc_id", "text"))
    found = repeats(rows.select("doc_id", F.col(key).alias("_key"), F.col("text").alias("_text")))
    joined = rows.join(found, (rows[key] == found["_of"]) & rows["doc_id"].eqNullSafe(found["_doc"]), "left").select(*(rows[c] for c in kept), found["starts"].alias(begins))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", n_lines long, n_removed long, n_spans long"

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = utf8(b.column("text"))
            there = b.column("text").is_valid().to_pylist()
            texts, counts = [], []
            for i, starts in enumerate(b.column(begins).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                n = own.count(b"\n") + 1 if there[i] else 0
                gone = np.zeros(n, bool)
                for j in range(WINDOW) if starts else ():
                    gone[np.array(starts) + j] = True
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                texts.append((b"\n".join(x for x, g in zip(own.split(b"\n"), gone, strict=True) if not g) if starts else own).decode() if there[i] else None)
                counts.append((n, int(gone.sum()), spans))
            columns = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in kept]
            columns += [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    return joined.mapInArrow(drop, schema)
