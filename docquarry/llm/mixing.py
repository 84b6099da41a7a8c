"""Mixing sources to target weights by Poisson replication, in DataFrame operations.

A source with target share w of N rows and n rows of its own gets the repetition
rate w * N / n.  Each document draws its number of copies by inverting the
Poisson distribution of that mean at a value hashed from the seed and its id, is
exploded by that number, and all copies are sorted by a second hash.

Rates above ``PART_RATE`` are drawn as a sum of independent Poisson parts, so the
tables of cumulative probabilities stay short whatever the rate.

Defined cases: a null source is a source of its own; a source without a weight is
left out if weights are given; rows with equal ids draw equal counts and are ordered
by what else they hold; a null id draws like the text "null"; null, empty and very
long texts are carried along; an empty table gives an empty result; input columns
named like an output column get the suffix ``_in``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checkpoints

PART_RATE = 64.0
#: Sources up to which the table of rates (at most about 2 kB each) is broadcast.
BROADCAST_SOURCES = 5_000


def _unit(*parts: Column) -> Column:
    """A value in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where nothing is left in double precision."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc, k):
        log_p = acc["log_p"] + F.log(rate / k)
        return F.struct(log_p.alias("log_p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + F.exp(log_p)).alias("c"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["c"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source") -> DataFrame:
    """source, n_docs, rate, parts and the cumulative probabilities of one part."""
    counts = docs.groupBy(docs[source_col].cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "named string, weight double")
        counts = counts.join(given, counts["source"].eqNullSafe(given["named"]), "left").drop("named").fillna(0.0, ["weight"])
    total = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum("weight").alias("all_weight"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_docs") / F.col("n_docs")).otherwise(0.0)
    out = out.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("long"))
    return out.select("source", "n_docs", "rate", "parts", _cumulative(F.col("rate") / F.col("parts")).alias("cumulative"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, seed: int = 42, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs' rows, each as often as drawn, with ``copy`` (from 1) and ``shuffle_key``, in the order of that key."""
    names = [f"{c}_in" if c in ("copy", "shuffle_key") else c for c in docs.columns]
    ident, source = (f"c{docs.columns.index(c)}" for c in (id_col, source_col))
    # names of the caller may clash or repeat: they travel as positions
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    table = checkpoints.cut(rates(docs, weights, source_col=source).select("source", "parts", "cumulative"))
    small = table.count() <= BROADCAST_SOURCES
    key = F.coalesce(docs[ident].cast("string"), F.lit("null"))
    joined = docs.join(F.broadcast(table) if small else table, docs[source].cast("string").eqNullSafe(table["source"]))

    def drawn(part):
        u = _unit(F.lit(str(seed)), key, part.cast("string"))
        return F.size(F.filter("cumulative", lambda c: c <= u)).cast("long")

    copies = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("parts")), F.lit(0).cast("long"), lambda n, i: n + drawn(i))
    rows = joined.withColumn("n", copies).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), key, F.col("copy").cast("string"))))
    # rows with equal ids have equal keys: what else they hold tells them apart
    held = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return rows.orderBy("shuffle_key", F.xxhash64(*held)).select(*docs.columns, "copy", "shuffle_key").toDF(*names, "copy", "shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to equal shares of the sources."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM c)) * (SELECT sum(n) FROM c) / n AS rate FROM c),
p AS (SELECT source, greatest(1, ceil(rate / 64.0))::BIGINT AS parts, rate / greatest(1, ceil(rate / 64.0)) AS lam FROM r),
k AS (SELECT source, parts, lam, unnest(range(0, (ceil(lam + 12 * sqrt(lam) + 24) + 1)::BIGINT)) AS k FROM p),
q AS (SELECT source, parts, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM k),
u AS (SELECT d.doc_id, d.source, unnest(range(1, p.parts + 1)) AS part FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
v AS (SELECT doc_id, source, part, ('0x' || substr(md5('42|' || doc_id || '|' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM u),
n AS (SELECT v.doc_id, count(*) AS n FROM v JOIN q ON v.source IS NOT DISTINCT FROM q.source AND q.c <= v.u GROUP BY v.doc_id),
e AS (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM n)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, e.copy, md5('order42|' || d.doc_id || '|' || e.copy) AS shuffle_key
FROM documents d JOIN e ON d.doc_id = e.doc_id
"""
