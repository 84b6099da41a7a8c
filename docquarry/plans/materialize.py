"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the shared folder; one of our own only where none is set and all runs here."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "docquarry-checkpoints"))
    return df.checkpoint(eager=True)
