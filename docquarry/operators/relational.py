"""Joins, counts and pages of the document and image tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_features(images: DataFrame, features: DataFrame, on: str = "image_id", how: str = "inner") -> DataFrame:
    return images.join(features, on, how)


def pending(rows: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows that are not done yet."""
    return rows.join(done.select(on), on, "left_anti")


def known(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Rows that the table has."""
    return rows.join(table.select(on), on, "left_semi")


def optional(df: DataFrame, column: str, value) -> DataFrame:
    """df, filtered by the value if one is given."""
    return df if value is None else df.where(F.col(column) == value)


def ordered(df: DataFrame, *order, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def browse(df: DataFrame, ident: str, limit: int = 500) -> DataFrame:
    """The first rows by id; an error row for a table without that column."""
    if ident not in df.columns:
        return df.sparkSession.createDataFrame([(f"no column {ident}",)], "error string")
    return df.orderBy(ident).limit(limit)


def paging(total: Column, page: Column, per_page: int) -> tuple[Column, Column, Column]:
    """(pages, offset, page) with the page brought into range; an empty list has one page."""
    pages = F.greatest(F.lit(1), F.ceil(total / per_page))
    at = F.greatest(F.lit(1), F.least(page, pages))
    return pages, (at - 1) * per_page, at


def page_of(rank: Column, per_page: int = 24) -> Column:
    """Page (from 1) that a row of this rank (from 1) is on."""
    return (F.floor((rank - 1) / per_page) + 1).cast("long")


def top_k(df: DataFrame, part: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each part: ranks are limited before the full sort where Spark can."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_share(df: DataFrame, part: list[str], order: list, *, least: int, share: float = 0.15) -> DataFrame:
    """The first rows of each part: a share of them, rounded down, but ``least``; parts of fewer have none."""
    w = Window.partitionBy(*part)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("_n") >= least) & (F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("_n") * share)))).drop("_n")


def top_values(df: DataFrame, part: list[str], value: str, seen: str, k: int) -> DataFrame:
    """The k most frequent values of each part with count and share; ties by first appearance."""
    counts = df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("_first"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*part)), 4)
    return top_k(counts.withColumn("ratio", share), part, [F.desc("n"), F.asc("_first")], k).drop("_first")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """total / (classes * count) of each label; a partial count for each label meets in one row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def confusion(df: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    return df.groupBy(truth).pivot(guess, labels).agg(F.count(F.lit(1))).fillna(0)


def report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each label."""
    cells = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.col(truth).alias("label"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"))
    other = cells.select(F.col(guess).alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"))
    s = both.unionByName(other).groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"))
    p = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return s.select("label", p.alias("precision"), r.alias("recall"), f.alias("f1"), "support")


def joined_text(df: DataFrame, part: list[str], text: str, order: str, separator: str = "\n") -> DataFrame:
    """Texts of each part in order, as one."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*part).agg(F.array_join(F.transform(rows, lambda x: x["t"]), separator).alias(text))


def entropy(share: Column) -> Column:
    """Bits of one part of a distribution, to be summed."""
    return -share * F.log2(share + 1e-7)


def metric(df: DataFrame, names: list[str]) -> str:
    """The first of the names that df has as a column."""
    return next(c for c in names if c in df.columns)


def child_counts(df: DataFrame, parent: str, *, above: int = 50, below: int = 100) -> DataFrame:
    """parent, children: rows that name a parent, where their number lies between the bounds; null is no parent."""
    return df.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count(F.lit(1)).alias("children")).where((F.col("children") > above) & (F.col("children") < below))


def run_counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition; zeros for an empty table."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def observed(df: DataFrame, observation, **conditions: Column) -> DataFrame:
    """df, whose next action leaves the counters in a pyspark Observation, with no pass of its own."""
    return df.observe(observation, *(F.count_if(c).alias(name) for name, c in conditions.items()))
