"""Operator inputs derived from the given tables, with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.operators.ordered import time_bucket, with_row_index
from kymora.plans.registry import table

HOUR = 3600

# Per-subject series: one row per reading, frame dense from 0.
SERIES_SQL = """series AS (
  SELECT user_id AS subject, event_id, event_type AS condition, 'v' || (user_id % 3) AS viscosity, value,
         (value * 7.0) % 240.0 - 120.0 AS angle,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
  FROM events)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without the frame number, for work that needs no order."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"),
        "event_id",
        "ts",
        F.col("event_type").alias("condition"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("viscosity"),
        "value",
        (F.col("value") * 7.0 % 240.0 - 120.0).alias("angle"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readings(spark, sf_dir)
    return with_row_index(df, ["subject"], ["ts", "event_id"], time_bucket(df, "ts", HOUR)).drop("ts")


# Image frames: four vectors of 64 values tile one 16x16 frame; 25 frames make a video.
PIXELS_SQL = """frame_pixels AS (
  SELECT 'v' || (vec_id // 100) AS video_id, (vec_id // 4) % 25 AS frame,
         8 * ((vec_id % 4) // 2) + i // 8 AS y, 8 * (vec_id % 2) + i % 8 AS x,
         CAST(embedding[i + 1] AS DOUBLE) AS intensity
  FROM embeddings, range(64) r(i))"""

# Object ids and the intensity rule that makes each mask.
MASKS_SQL = (
    PIXELS_SQL
    + """,
mask_pixels AS (
  SELECT video_id, frame, o.object_id, y, x FROM frame_pixels, (VALUES (2), (3), (4)) o(object_id)
  WHERE (object_id = 2 AND intensity > 0.1)
     OR (object_id = 3 AND intensity < -0.05 AND x >= 3)
     OR (object_id = 4 AND abs(intensity) > 0.12 AND frame % 7 NOT IN (3, 4))),
mask_index AS (
  SELECT video_id, frame, object_id, 16 AS height, 16 AS width
  FROM (SELECT DISTINCT video_id, frame FROM frame_pixels), (VALUES (2), (3), (4)) o(object_id))"""
)


def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    flat = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.floor(v / 100).cast("string")).alias("video_id"),
        (F.floor(v / 4) % 25).cast("int").alias("frame"),
        (8 * F.floor((v % 4) / 2)).alias("y0"),
        (8 * (v % 2)).alias("x0"),
        F.posexplode("embedding").alias("i", "e"),
    )
    return flat.select(
        "video_id",
        "frame",
        (F.col("y0") + F.floor(F.col("i") / 8)).cast("int").alias("y"),
        (F.col("x0") + F.col("i") % 8).cast("int").alias("x"),
        F.col("e").cast("double").alias("intensity"),
    )


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("intensity")
    hit = F.array_compact(
        F.array(
            F.when(v > 0.1, F.lit(2)),
            F.when((v < -0.05) & (F.col("x") >= 3), F.lit(3)),
            F.when((F.abs(v) > 0.12) & ~(F.col("frame") % 7).isin(3, 4), F.lit(4)),
        )
    )
    return frame_pixels(spark, sf_dir).select("video_id", "frame", F.explode(hit).alias("object_id"), "y", "x")


def mask_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    frames = (
        table(spark, sf_dir, "embeddings")
        .select(
            F.concat(F.lit("v"), F.floor(v / 100).cast("string")).alias("video_id"),
            (F.floor(v / 4) % 25).cast("int").alias("frame"),
        )
        .distinct()
    )
    return frames.select(
        "video_id",
        "frame",
        F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("object_id"),
        F.lit(16).alias("height"),
        F.lit(16).alias("width"),
    )


# Curves: 32 points per vector; 50 vectors make a video.
CURVES_SQL = """curves AS (
  SELECT 'c' || (vec_id // 50) AS video_id, vec_id % 50 AS frame,
         [3.0 * i + CAST(embedding[i + 1] AS DOUBLE) for i in range(32)] AS ys,
         [8.0 * CAST(embedding[i + 33] AS DOUBLE) for i in range(32)] AS xs
  FROM embeddings)"""

CURVE_POINTS_SQL = """curve_points AS (
  SELECT 'c' || (vec_id // 50) AS video_id, vec_id % 50 AS frame, i AS pos,
         3.0 * i + CAST(embedding[i + 1] AS DOUBLE) AS y, 8.0 * CAST(embedding[i + 33] AS DOUBLE) AS x
  FROM embeddings, range(32) r(i))"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centrelines as ordered arrays of (y, x)."""
    v = F.col("vec_id")
    e = F.col("embedding")
    pts = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.struct(
            (3.0 * i + F.element_at(e, i + 1).cast("double")).alias("y"),
            (8.0 * F.element_at(e, i + 33).cast("double")).alias("x"),
        ),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), F.floor(v / 50).cast("string")).alias("video_id"),
        (v % 50).cast("long").alias("frame"),
        pts.alias("points"),
    )


# Gene counts: part -> gene, supplier -> sample, quantity -> count.
COUNTS_SQL = """counts AS (
  SELECT 'g' || l_partkey AS gene_id, 's' || (l_suppkey % 12) AS sample,
         chr(CAST(65 + (l_suppkey % 12) // 3 AS INTEGER)) AS condition, CAST(sum(l_quantity) AS BIGINT) AS n
  FROM lineitem GROUP BY ALL)"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey") % 12
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene_id"),
            F.concat(F.lit("s"), s.cast("string")).alias("sample"),
            F.char(65 + F.floor(s / 3)).alias("condition"),
        )
        .agg(F.sum("l_quantity").cast("long").alias("n"))
    )


# Gene results: one row per gene and condition pair.
DE_SQL = """de AS (
  SELECT 'g' || l_partkey AS gene, l_returnflag AS comparison_condition, l_linestatus AS reference_condition,
         round(log2(avg(l_extendedprice) / 25000.0), 6) AS lfc,
         round((sum(l_quantity) * 0.618034) % 1.0, 6) AS pvalue
  FROM lineitem GROUP BY ALL)"""


def gene_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene"),
            F.col("l_returnflag").alias("comparison_condition"),
            F.col("l_linestatus").alias("reference_condition"),
        )
        .agg(
            F.round(F.log2(F.avg("l_extendedprice") / 25000.0), 6).alias("lfc"),
            F.round(F.sum("l_quantity") * 0.618034 % 1.0, 6).alias("pvalue"),
        )
    )
