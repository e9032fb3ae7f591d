"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # what a query cut off goes when nothing refers to it
}


def session(app: str = "loreweave", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(rows: DataFrame, each: int = 8 << 20) -> DataFrame:
    """``rows`` dealt to all cores if they are few: a small file is one task, however much there is to do with its rows.

    Few means an estimate under ``each`` bytes a core, so what is moved is bounded; larger tables come in parts anyway.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if cores > 1 and size < cores * each else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``; where it is unset, a local
    session gets a temporary one and a cluster session is refused."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loreweave-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
