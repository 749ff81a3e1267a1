"""Queries over the driver tables: each a function of (spark, sf_dir) beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def long_form(df: DataFrame, array: str, keys: list[str], name: str, kind: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("pos", "x")).select(*keys, F.col("pos").cast("long").alias("pos"), F.col("x").cast(kind).alias(name))
