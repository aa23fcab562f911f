"""One query for each corpus operator, over its whole table; thin, so that the operators keep interfaces of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import decontamination, exact, infilling, langid, licenses, lines, mixing, sharding, simhash, spelling, suffixes, syncmers, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.with_edits(_read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(_read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.identify(rows, langid.train(docs), "doc_id", "held_out")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("url", "payload")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = F.sha2(infilling.restore("output", "form"), 256).alias("restored_sha256")
    return found.select("doc_id", F.col("n_units").alias("n"), "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), restored)


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(_read(spark, sf_dir, "documents"), noise=spelling.NOISE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_syncmers": op2_syncmers,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_suffixes": op6_suffixes,
    "op7_language": op7_language,
    "op8_warc": op8_warc,
    "op9_lines": op9_lines,
    "op10_licenses": op10_licenses,
    "op11_infilling": op11_infilling,
    "op12_exact": op12_exact,
    "op13_spelling": op13_spelling,
}

SHARDING_SQL = """
WITH d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS route
  FROM documents),
nodes AS (
  SELECT k AS depth, route >> (32 - k) AS node, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
  FROM d, generate_series(0, 32) AS t(k) GROUP BY ALL),
fits AS (SELECT * FROM nodes WHERE shard_bytes <= {limit} OR shard_rows = 1),
best AS (
  SELECT d.*, f.depth, f.shard_bytes, f.shard_rows, row_number() OVER (PARTITION BY doc_id, route ORDER BY f.depth) AS k
  FROM d JOIN fits f ON d.route >> (32 - f.depth) = f.node)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(route >> CAST(32 - depth AS BIGINT)), 40, '0'), CAST(depth AS INTEGER)) END AS shard,
       CAST(depth AS INTEGER) AS depth, shard_bytes, shard_rows
FROM best WHERE k = 1
"""

LINES_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS part
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS i FROM l WHERE len(lines) >= 3)),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM later, generate_series(0, 2) AS t(j)),
every AS (
  SELECT e.doc_id, e.pos, e.line, g.pos IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(0, len(lines) - 1)) AS pos FROM l) e
  LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos),
marked AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM every),
sums AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""

WARC_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

INFILLING_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
h AS (
  SELECT doc_id, body, units, len(units) AS n, CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
         CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, body, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
  FROM f),
o AS (
  SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END AS output
  FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256
FROM o
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: The SQL of those operators that SQL can express; the rest is tested against brute force.
ORACLE: dict[str, str] = {
    "op1_sharding": SHARDING_SQL.format(limit=sharding.LIMIT),
    "op8_warc": WARC_SQL,
    "op9_lines": LINES_SQL,
    "op11_infilling": INFILLING_SQL,
    "op12_exact": EXACT_SQL,
}
