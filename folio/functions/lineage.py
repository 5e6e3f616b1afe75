"""Cutting the lineage of frames that loops build up, and dealing frames out to Python."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; in a local session without one, a new local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return context.getCheckpointDir()


#: With this setting Spark removes the shuffle files of a query once it has ended.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage."""
    return tabled(df)


def tabled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for frames of which each reader asks some columns or rows, and for large ones, as the rows of a checkpoint are not packed."""
    spark, path = df.sparkSession, f"{_folder(df.sparkSession)}/folio-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")  # what was shuffled for the table is of no use to any other query
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANED) if was is None else spark.conf.set(_CLEANED, was)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder, which keeps the tasks of df: small rows of many files stay dealt out."""
    _folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over several tasks for each core, by a hash of keys. A small file is scanned by one task, in which Python would read all its rows."""
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, 32), *keys)


def by_document(df: DataFrame) -> DataFrame:
    """df by doc_id over spark.sql.shuffle.partitions tasks. Spark does not join these to fewer: what a task makes of a document takes more memory than what was sent."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
