"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; one of our own only where none is set and all runs on this machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "docquarry-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the shared folder.

    Shuffle files of plans that were cut before, and are no longer referred to, go
    when the garbage that held them is collected: this asks for it."""
    ensure_folder(df.sparkSession)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: for rows with their texts."""
    spark = df.sparkSession
    ensure_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.parquet(path)
