"""Document fingerprints from closed syncmers, in SQL functions only.

A text is a sequence of word pieces. A run of K pieces is an anchor if the least hash of its inner runs of S pieces stands first
or last in it; whether it does depends on the run alone, so a stretch that two texts share has the same anchors in both, at
positions that differ by one offset. Two texts are compared by all their anchors. The fingerprint to print and to look up is a
digest of all anchors and a sample of them that grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pieces of an anchor and of an inner run; codes a fingerprint's sample has at least, and one in how many; documents of a bucket, and least and most buckets.
K, S, SKETCH, RATE, BUCKET, BUCKETS = 5, 2, 128, 8, 20_000, (256, 10_000)
#: A word, cut after 16 characters; each character of scripts that do not part words is a piece.
_CJK = r"぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
PIECE = rf"[{_CJK}]|[^\x20\x09-\x0D{_CJK}]{{1,16}}"


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: array of (position, hash) of the anchors of a text; a text of fewer than K pieces has one, all its pieces."""
    pieces, inner = f"_{name}_pieces", f"_{name}_inner"
    at = lambda array, i, k: F.get(array, i + k)
    df = df.withColumn(pieces, F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda t: F.xxhash64(t)))
    runs = F.when(F.size(pieces) >= K, F.sequence(F.lit(0), F.size(pieces) - S)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(inner, F.transform(runs, lambda i: F.xxhash64(at(pieces, i, 0), at(pieces, i, 1))))
    edge = lambda i: F.least(at(inner, i, 0), at(inner, i, K - S)) <= F.least(*(at(inner, i, j) for j in range(1, K - S)))
    places = F.filter(F.sequence(F.lit(0), F.size(pieces) - K), edge)
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(F.array_join(F.transform(pieces, lambda x: x.cast("string")), " ")).alias("hash")))
    many = F.transform(places, lambda i: F.struct(i.alias("position"), F.xxhash64(at(inner, i, 0), at(inner, i, 2), at(pieces, i, K - 1)).alias("hash")))
    kind = "array<struct<position:int,hash:bigint>>"
    found = F.when(F.size(pieces) >= K, many.cast(kind)).when(F.size(pieces) > 0, whole.cast(kind)).otherwise(F.array().cast(kind))
    return df.withColumn(name, found).drop(pieces, inner)


def codes(anchors: str) -> Column:
    """The distinct anchors of a text as sorted codes, the first 32 bits of their hashes."""
    return F.array_sort(F.array_distinct(F.transform(F.col(anchors)["hash"], lambda h: (F.shiftrightunsigned(h, 32) - (1 << 31)).cast("int"))))


def printed(values: str) -> Column:
    """The fingerprint of sorted codes: 16 hex digits that stand for all of them, then the least ones, eight digits each.

    The sample holds ``SKETCH`` codes, or all in the first 1/``RATE`` of their range where these are more, so that samples of two
    texts cover the same range and grow with the texts. Without codes it is empty.
    """
    dense = F.size(F.filter(values, lambda c: c < -(1 << 31) + (1 << 32) // RATE))
    sample = F.transform(F.slice(values, 1, F.greatest(F.lit(SKETCH), dense)), lambda c: F.lpad(F.hex(c.cast("long") + (1 << 31)), 8, "0"))
    whole = F.lpad(F.hex(F.xxhash64(values)), 16, "0")
    return F.when(F.size(values) > 0, F.lower(F.concat(whole, F.array_join(sample, "")))).otherwise("")


def likeness(a: str, b: str) -> Column:
    """The likeness of two texts' sets of codes, all of them: those in both over those in either; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns of the documents and fingerprint: null and empty texts have an empty one."""
    df = with_anchors(docs.withColumn("_text", F.coalesce("text", F.lit(""))), "_text", "_anchors").withColumn("_codes", codes("_anchors"))
    return df.withColumn("fingerprint", printed("_codes")).drop("_text", "_anchors", "_codes")


def matches(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """(left_id, right_id, offset, n_anchors, first, last): stretches that two tables of few documents (doc_id, text) share, by at least so many anchors at one offset."""
    def exploded(df: DataFrame, name: str) -> DataFrame:
        df = with_anchors(df.select(F.col("doc_id").alias(name), F.coalesce("text", F.lit("")).alias("_text")), "_text", "_anchors")
        # Not inline: its filter of empty arrays would be pushed below, and the anchors be made once more to be counted.
        rows = df.select(name, F.inline_outer("_anchors")).where(F.col("hash").isNotNull())
        return rows.withColumnRenamed("position", f"{name}_at")

    met = exploded(left, "left_id").join(exploded(right, "right_id"), "hash")
    offset = F.col("right_id_at") - F.col("left_id_at")
    return met.groupBy("left_id", "right_id", offset.alias("offset")).agg(F.countDistinct("left_id_at").alias("n_anchors"), F.min("left_id_at").alias("first"), F.max("left_id_at").alias("last")).where(F.col("n_anchors") >= least)


def _bucket(keys: DataFrame) -> Column:
    """The bucket of a document (doc_id, _key) in ascending order, between approximate percentiles of doc_id.

    A doc_id with more documents than a bucket has several buckets, parted by _key; so has null, which comes before all.
    """
    kind = keys.schema["doc_id"].dataType.simpleString()
    if kind in ("string", "binary", "boolean"):
        raise ValueError(f"doc_id orders the documents by number or time, not by {kind}")
    n, nulls = keys.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    many = min(max(n // BUCKET, BUCKETS[0]), BUCKETS[1])
    cuts = keys.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], BUCKETS[1])).first()[0] or []
    bounds = F.array(*(F.lit(c).cast(kind) for c in sorted(cuts))).cast(f"array<{kind}>")
    share = F.col("_key") / F.lit(2.0**64) + 0.5
    within = lambda parts: F.greatest(F.least(F.floor(share * parts).cast("int"), parts - 1), F.lit(0))
    below = F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    same = F.size(F.filter(bounds, lambda b: b == F.col("doc_id")))
    none = F.lit(-(-nulls * many // max(1, n)))
    return F.when(F.col("doc_id").isNull(), within(none) - none - 1).otherwise(below + within(same))


def _guests(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, guest_of): the document that follows the last of each bucket, the head of the next lower one, round to the first."""
    heads = rows.groupBy("_bucket").agg(F.max(F.struct("doc_id", *key)).alias("head")).select("_bucket", F.struct(*(F.col("head")[k].alias(k) for k in key)).alias("head"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("_bucket"))  # one row for each bucket
    after = F.coalesce(F.lead("head").over(down), F.first("head").over(down))
    return heads.select(after.alias("h"), F.col("_bucket").alias("guest_of")).select(*(F.col("h")[k].alias(k) for k in key), "guest_of")


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document, with fingerprints and likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id. Null text counts as empty.
    Rows equal in doc_id and text count as one document in the order, and each has the same result; rows with one doc_id and
    several texts follow each other in a fixed order, and null doc_ids come last. A table of one document follows itself.
    A doc_id that is no number, date or time raises ``ValueError``. Columns that clash with these are not carried.

    Texts are shuffled once, by bucket, and each bucket's last document meets the next one there as a guest.
    """
    key = ["_key", "_more"]  # 128 bits stand for a document
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("doc_id", "_text")).withColumn("_more", F.xxhash64(F.lit(1), "_text", "doc_id"))
    rows = rows.withColumn("_bucket", _bucket(rows.select("doc_id", "_key")))
    place = lambda bucket, guest: F.struct(bucket.alias("bucket"), F.lit(guest).alias("guest"))
    # As many guests as buckets, at most twice BUCKETS.
    placed = rows.join(F.broadcast(_guests(rows, key)), key, "left")
    placed = placed.withColumn("_at", F.explode(F.array_compact(F.array(place(F.col("_bucket"), False), F.when(F.col("guest_of").isNotNull(), place(F.col("guest_of"), True))))))
    placed = placed.select("_at.bucket", "_at.guest", "doc_id", *key, "_text").repartition("bucket")
    made = placed.groupBy("bucket", "guest", "doc_id", *key).agg(F.first("_text").alias("_text"), F.count("*").cast("int").alias("_copies"))
    made = with_anchors(made, "_text", "_anchors").withColumn("_codes", codes("_anchors")).drop("_anchors")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), *map(F.desc, key))
    made = made.withColumn("_next", F.lead(F.struct("doc_id", "_text", "_codes")).over(order)).where("not guest")
    n = F.length("_text")
    third = F.expr("cast(floor(length(_text) / 3) as int)")
    edited = F.concat(F.substring("_text", F.lit(1), n - third), F.substring(F.col("_next._text"), F.lit(1), third))
    both = made.select("doc_id", F.col("_next.doc_id").alias("next_id"), n.cast("long").alias("n_chars"), edited.alias("_edited"), "_codes", F.col("_next._codes").alias("_after"), "_copies")
    both = with_anchors(both, "_edited", "_anchors").withColumn("_new", codes("_anchors"))
    likes = (likeness("_codes", "_new").alias("near_edited"), likeness("_codes", "_after").alias("near_next"))
    out = both.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), printed("_codes").alias("fingerprint"), printed("_new").alias("edited_fingerprint"), *likes, "next_id", "_copies")
    return out.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")
