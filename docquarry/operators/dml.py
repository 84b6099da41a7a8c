"""Table changes as DataFrames: what the target holds afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.plans.materialize import cut


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(source, allowMissingColumns=True)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first writer of a key wins; keys of the target are left alone."""
    new = first_of(source, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")
    return append(target, new.select(*target.columns))


def upsert_last(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last writer of a key replaces the whole row; columns the source lacks become null."""
    last = first_of(source, keys, [c.desc() for c in order])
    kept = target.join(last.select(*keys), keys, "left_anti").select(*target.columns)
    return append(kept, last.select(*(c for c in target.columns if c in last.columns)))


def update_by_key(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns of the rows whose key the source has, as the source has them (nulls too)."""
    new = source.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = target.join(new, keys, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def fill_null(target: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column where the target has none."""
    joined = target.join(source.select(*keys, F.col(column).alias("_new")), keys, "left")
    return joined.select(*(F.coalesce(column, "_new").alias(c) if c == column else F.col(c) for c in target.columns))


def update_or_insert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source values where given, target values elsewhere, rows of both."""
    others = [c for c in target.columns if c not in keys]
    new = source.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in others if c in source.columns))
    joined = target.join(new, keys, "full_outer")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in others and c in source.columns else F.col(c) for c in target.columns))


def replace_partition(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """All rows of the source's key values are replaced; the same call again changes nothing."""
    kept = target.join(source.select(key).distinct(), key, "left_anti").select(*target.columns)
    return append(kept, source.select(*target.columns))


def numbered_globally(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with numbers from 1 in the given order, without bringing all rows to one task.

    Rows are range-partitioned and numbered within partitions; only the partitions'
    row counts meet in one place."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy("_place")))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return local.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_place", "_local", "_before")


def surrogate_keys(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """name, key: ids from 1 for different keys, in the order they were first seen."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return numbered_globally(first, ["_first", key], name).select(name, key)
