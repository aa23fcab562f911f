"""Where intermediate tables lie, and how the plan of one is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: the session's spark.checkpoint.dir; only a local master may go without one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lexigrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The table as it is now, by a reliable checkpoint: what reads it several times does not make it anew."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()
