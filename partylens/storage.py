"""Intermediate tables that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own where none is configured (tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="partylens-"))
    return context.getCheckpointDir()


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()
