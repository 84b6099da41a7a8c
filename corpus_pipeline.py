"""Training-corpus pipeline: what stays of documents, and how often.

1. quality: documents that fail the base rules or their fertility band go.
2. near_duplicates: of each group of near duplicates the document with the least id stays.
3. decontamination: documents with a twentieth of their words in benchmark windows go.
4. pii: personal data are replaced by their kinds.
5. mixing: documents are repeated by source so that all sources weigh the same.

Each stage takes (spark, docs, sf_dir) and returns the columns of docs; the last
one adds copy and shuffle_key.  SQL has no tokenizer, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import checkpoints, decontaminate, fertility, jaccard_join, mixing, pii
from docquarry.plans.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    import public_tokenizers

    ship(spark)
    return fertility.keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return jaccard_join.keep_firsts(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    ship(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    ship(spark)
    return pii.redact_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to equal shares of the sources, in a global random order."""
    ship(spark)
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpoints.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
