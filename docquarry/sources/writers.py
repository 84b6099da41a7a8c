"""Sinks: tables, CSV and routed image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import sanitize_label


def replace_files(df: DataFrame, path: str, key: str = "file_id") -> None:
    """Overwrite only the partitions that df has; writing again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def labelled_name(image_id: Column, label: Column, confidence: Column, person: Column) -> Column:
    return F.format_string("%06d_%s_conf-%.2f_person-%.2f.png", image_id, sanitize_label(label), confidence, person)


def route_images(df: DataFrame, path: str, flag: str) -> None:
    """Image rows, parted by a flag or label."""
    df.write.mode("overwrite").partitionBy(flag).parquet(path)
