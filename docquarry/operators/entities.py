"""Entities of lines, persons and their mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.persons import is_valid_person, person_candidates
from docquarry.functions.text import normalize_name
from docquarry.operators.dml import surrogate_keys


def entities_raw(lines: DataFrame) -> DataFrame:
    """line_id, ent_text, ent_type of the person candidates of lines, each once for a line."""
    return lines.select("line_id", F.explode(person_candidates(F.col("text"))).alias("ent_text")).withColumn("ent_type", F.lit("PERSON")).distinct()


def person_rows(lines: DataFrame) -> DataFrame:
    """line_id, raw_name, norm_name of the entities that are taken for persons."""
    found = entities_raw(lines).where(is_valid_person(F.col("ent_text")))
    return found.select("line_id", F.col("ent_text").alias("raw_name"), normalize_name(F.col("ent_text")).alias("norm_name")).where("norm_name <> ''")


def persons(rows: DataFrame) -> DataFrame:
    """person_id, norm_name in the order of the first line that names them."""
    return surrogate_keys(rows, "norm_name", "line_id", "person_id")


def mentions(rows: DataFrame, people: DataFrame) -> DataFrame:
    """person_id, line_id, raw_name, each once."""
    return rows.join(people, "norm_name").select("person_id", "line_id", "raw_name").distinct()
