"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sql_text(expression: str) -> str:
    """A Python string as a SQL string literal."""
    return "'" + expression.replace("\\", "\\\\").replace("'", "\\'") + "'"


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so, whatever its case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name
