"""Queries of the training-data problem that belongs to the core: packed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.packed import unpack_values
from millrace.session import table

PACKED_COLUMNS = ["id", "data_source", "geography", "sector", "inferred_expertise_functional"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "people", PACKED_COLUMNS)
    return unpack_values(people, table(spark, sf_dir, "reference_terms"))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
