"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to Parquet in the shared folder
and reads them again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import decontamination, langid, mixing, sharding, simhash
from lexigrid.llm.common import cut, stored, unused

#: Bits in which the fingerprints of near-duplicates differ, and fingerprints of a text.
NEAR, FAMILIES = 6, 4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language, go; the others have the language that was found, in ``lang``.

    Where no document has a label there is no language to be unlike: all with letters stay, as ``und``.
    """
    # By place, so that no column of the documents clashes with what is found.
    placed = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), "text")
    found = langid.identify(placed, langid.train(docs), *placed.columns[:-1]).where(~F.col("rejected"))
    return found.select(*(F.col("lang_pred" if c == "lang" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest doc_id, a null one last.

    Near are texts whose fingerprints of five-word shingles differ in at most ``NEAR`` bits in any of ``FAMILIES`` families. Of
    rows equal in doc_id and text one stays. A document is known by 128 bits of hashes of its doc_id and text.
    """
    *key, n = unused(docs, "_key", "_more", "_n")
    keyed = docs.withColumns({key[0]: F.xxhash64("doc_id", "text"), key[1]: F.xxhash64(F.lit(1), "text", "doc_id")})
    found = simhash.near_duplicates(keyed, *key, budget=NEAR, shingle=5, families=FAMILIES, whole=5)
    rows = found.groupBy("root", "doc_id", *key).agg(F.count("*").alias(n))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *key, n)).alias("first"))
    # Cut, for the plan below holds it twice.
    first = cut(first.select(*(F.col("first")[k].alias(k) for k in (*key, n))))
    kept = keyed.join(first, key)
    repeated = kept.where(F.col(n) > 1).dropDuplicates(key)
    return kept.where(F.col(n) == 1).unionByName(repeated).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gives its target of words; a document taken again stands in another row."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix and their shard."""
    return sharding.shard(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


#: Language models and fingerprints can't be stated in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
