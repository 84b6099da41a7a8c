"""Positional windows: neighbour pairs, gap clusters, differences and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_pairs(df: DataFrame, part: list[str], order: list[str], ident: str, k: int = 5, carry: list[str] | None = None) -> DataFrame:
    """id_a, id_b, distance of each row with its next k rows of the same part; ``carry`` columns come as a_*, b_*.

    One sort and no self-join: k rows are looked ahead within the window."""
    carry = carry or []
    ahead = Window.partitionBy(*part).orderBy(*order, ident).rowsBetween(1, k)
    rows = df.withColumn("_next", F.collect_list(F.struct(F.col(ident).alias("id_b"), *(F.col(c).alias(f"b_{c}") for c in carry))).over(ahead))
    pairs = rows.select(F.col(ident).alias("id_a"), *(F.col(c).alias(f"a_{c}") for c in carry), F.posexplode("_next").alias("_at", "_b"))
    return pairs.select("id_a", "_b.id_b", (F.col("_at") + 1).cast("long").alias("distance"), *(f"a_{c}" for c in carry), *(F.col(f"_b.b_{c}").alias(f"b_{c}") for c in carry))


def canonical_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with the lesser id in a and the greater in b."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def new_pairs(pairs: DataFrame, known: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Pairs not among the known ones, in whichever order those name their ends."""
    return canonical_pair(pairs, a, b).join(canonical_pair(known.select(a, b), a, b).distinct(), [a, b], "left_anti")


def gap_clusters(df: DataFrame, part: list[str], value: str, tolerance: float, weight: str | None = None) -> DataFrame:
    """Clusters of sorted values whose neighbours are at most ``tolerance`` apart: size, weight and median."""
    w = Window.partitionBy(*part).orderBy(value)
    step = F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    rows = df.withColumn("_step", step).withColumn("cluster", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*part, "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(weight or F.lit(1.0)).alias("weight"), F.median(value).alias("median"))


def difference(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """df with ``diff``, the step from the row before."""
    return df.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(*part).orderBy(*order)))


def numbered(df: DataFrame, part: list[str], order: list[str], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def every(values: Column, step: int) -> Column:
    """Every ``step``-th element of an array, from the first."""
    return F.filter(values, lambda _, i: i % step == 0)


def nearest(df: DataFrame, part: list[str], value: str, target: Column, cutoff: float) -> DataFrame:
    """The value nearest to the target in each part, if within the cutoff."""
    gap = F.abs(F.col(value) - target)
    return df.groupBy(*part).agg(F.min_by(value, F.struct(gap, F.col(value))).alias("nearest"), F.min(gap).alias("gap")).where(F.col("gap") <= cutoff)
