"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that summation order does not show."""
    from pyspark.sql import functions as F

    cols = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            cols.append(F.round(F.col(f"`{name}`").cast("double"), digits).alias(name))
        elif kind == "int":
            cols.append(F.col(f"`{name}`").cast("long").alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    return df.select(*cols)
