"""Scaling of measurements within groups or over the whole table.

Statistics come from a combining aggregate joined back, so a group with a large
share of the rows is never gathered in one task.  Null is the missing value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.operators.ordered import attach_stats

LO, HI = "__lo", "__hi"


def _range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return attach_stats(df, keys, F.min(value).alias(LO), F.max(value).alias(HI))


def _scaled(value: str) -> Column:
    return F.try_divide(F.col(value) - F.col(LO), F.col(HI) - F.col(LO))


def _finish(df: DataFrame, name: str, column: Column) -> DataFrame:
    return df.withColumn(name, column).drop(LO, HI)


def _constant() -> Column:
    return F.coalesce(F.col(LO) == F.col(HI), F.lit(True))


def unit_range(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """To [0, 1]; a constant group is 0 in every row, nulls included."""
    return _finish(_range(df, keys, value), name, F.when(_constant(), 0.0).otherwise(_scaled(value)))


def signed_range(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """To [-1, 1]; a constant group is 0."""
    return _finish(_range(df, keys, value), name, F.when(_constant(), 0.0).otherwise(_scaled(value) * 2 - 1))


def overall_range(df: DataFrame, value: str, name: str) -> DataFrame:
    """To [0, 1] over all rows of the table."""
    return unit_range(df, [], value, name)


def centred_unit_range(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """To [0, 1]; a constant group is 0.5 and nulls stay null."""
    c = F.when(F.col(value).isNotNull(), F.when(_constant(), 0.5).otherwise(_scaled(value)))
    return _finish(_range(df, keys, value), name, c)


def plain_range(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """To [0, 1] without a guard: a constant group has no value."""
    return _finish(_range(df, keys, value), name, _scaled(value))


def share_of_max(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    df = attach_stats(df, keys, F.max(value).alias(HI))
    return _finish(df, name, F.try_divide(F.col(value), F.col(HI)))


def relative_to_baseline(df: DataFrame, value: str, reference: Column, name: str) -> DataFrame:
    """(x - b) / b with b the mean over the reference rows."""
    base = df.filter(reference).agg(F.avg(value).alias("__base"))
    out = df.crossJoin(base)
    return out.withColumn(name, F.try_divide(F.col(value) - F.col("__base"), F.col("__base"))).drop("__base")


def z_score(df: DataFrame, keys: Sequence[str], value: str, name: str, population: bool = False) -> DataFrame:
    sd = F.stddev_pop if population else F.stddev_samp
    df = attach_stats(df, keys, F.avg(value).alias(LO), sd(value).alias(HI))
    return _finish(df, name, F.try_divide(F.col(value) - F.col(LO), F.col(HI)))


def group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return attach_stats(df, keys, F.avg(value).alias(name))


def low_outliers(df: DataFrame, keys: Sequence[str], value: str, flag: str, label: str) -> DataFrame:
    """Flag values under mean - sd of the group, and name the group."""
    df = attach_stats(df, keys, F.avg(value).alias(LO), F.stddev_samp(value).alias(HI))
    low = F.coalesce(F.col(value) < F.col(LO) - F.col(HI), F.lit(False))
    return df.withColumns({flag: low, label: F.concat_ws("_", *[F.col(k).cast("string") for k in keys])}).drop(LO, HI)
