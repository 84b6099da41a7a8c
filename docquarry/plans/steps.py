"""Running a job step by step: tables are the only link between steps, and the first failure ends it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.operators import entities, lines
from docquarry.sources import writers


def run_step(name: str, step: Callable[[], object]) -> object:
    print(f"[{name}] started")
    try:
        out = step()
    except Exception:
        print(f"[{name}] failed")
        raise
    print(f"[{name}] done")
    return out


def text_pipeline(spark: SparkSession, docs: DataFrame, folder: str) -> dict[str, str]:
    """Lines, their similarity, and persons of documents, as tables in a folder; returns their paths."""
    at = {name: f"{folder}/{name}" for name in ("text_lines", "text_similarity", "persons", "person_mentions")}
    run_step("text_lines", lambda: writers.replace_files(lines.text_lines(docs), at["text_lines"]))
    stored = spark.read.parquet(at["text_lines"])
    run_step("text_similarity", lambda: lines.similarity_job(stored).write.mode("overwrite").parquet(at["text_similarity"]))
    people = entities.persons(entities.person_rows(stored))
    run_step("persons", lambda: people.write.mode("overwrite").parquet(at["persons"]))
    run_step("person_mentions", lambda: entities.mentions(entities.person_rows(stored), spark.read.parquet(at["persons"])).write.mode("overwrite").parquet(at["person_mentions"]))
    return at
