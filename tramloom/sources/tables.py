"""Typed access to the parquet tables of one data directory."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read one table; ``columns`` prunes at the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def not_blank(c: Column) -> Column:
    """False for NULL and for text of white space only (Unicode white space and no-width characters included)."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]"), F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share: the cluster's ``spark.checkpoint.dir``; a temporary one
    is made only where that is unset and the master is local."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tramloom-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(shared)
    return jsc.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, so that an executor lost later can't take the rows with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a parquet table in the shared folder: like a checkpoint, but compressed and read by column."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
