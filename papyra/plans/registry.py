"""The list of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG: dict[str, tuple] = {}


def query(sql: str | None):
    """Registers the function under q_<its name> with its SQL."""

    def register(f):
        CATALOG[f"q_{f.__name__}"] = (f, sql)
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
