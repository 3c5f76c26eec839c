"""Sinks and round-trip checks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.operators.ordered import null_safe_join
from kymora.session import checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint location."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_new(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """Write, and refuse to replace an existing result."""
    df.write.mode("errorifexists").options(**options).format(fmt).save(path)
    return path


def wide_measurements(df: DataFrame, keys: Sequence[str], object_id: str, objects: Sequence[int]) -> DataFrame:
    """Per-frame wide rows: frame, background, raw means, corrected means, pixel counts."""
    wide = df.groupBy(*keys, "background").pivot(object_id, list(objects)).agg(
        F.min("mean").alias("mean"),
        F.min("bg_corrected").alias("bg_corrected"),
        F.min("pixel_count").alias("pixel_count"),
    )
    return wide.select(
        *keys,
        "background",
        *[F.col(f"{o}_mean").alias(f"{o}") for o in objects],
        *[F.col(f"{o}_bg_corrected") for o in objects],
        *[F.coalesce(F.col(f"{o}_pixel_count"), F.lit(0)).alias(f"{o}_pixel_count") for o in objects],
    )


def differing_rows(a: DataFrame, b: DataFrame, order: Sequence[str], first: int = 5) -> DataFrame:
    """First rows two tables do not share, with the side each comes from."""
    only_a = a.exceptAll(b).withColumn("side", F.lit("first"))
    only_b = b.exceptAll(a).withColumn("side", F.lit("second"))
    return only_a.unionByName(only_b).orderBy("side", *order).limit(first)


def without_prompts(df: DataFrame, prompts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leave out the listed frames before writing."""
    return null_safe_join(df, prompts.select(*keys).distinct(), list(keys), "left_anti")
