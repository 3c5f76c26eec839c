"""Sorting, top-k, sets, reshaping, sampling and generated grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_value_order(column: str, last: str) -> list[Column]:
    """Sort keys that put one value after all others."""
    return [F.when(F.col(column) == last, 1).otherwise(0), F.col(column)]


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, pre: Sequence[str] = ()) -> DataFrame:
    """First k rows of each group.  ``pre`` spreads a large group: rows are cut
    to k within each (group, pre) part before the final ranking."""
    if pre:
        w = Window.partitionBy(*keys, *pre).orderBy(*order)
        df = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def union_tables(*tables: DataFrame) -> DataFrame:
    """Stack tables of unlike columns; absent columns become null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def pivot_long(df: DataFrame, keys: Sequence[str], names: str, values: Sequence, aggs: Sequence[Column]) -> DataFrame:
    """Long to wide over a stated value list, so no extra pass finds the values."""
    return df.groupBy(*keys).pivot(names, list(values)).agg(*aggs)


def explode_profile(df: DataFrame, keys: Sequence[str], profile: str, position: str, value: str) -> DataFrame:
    return df.select(*keys, F.posexplode(profile).alias(position, value))


def sample_by_hash(df: DataFrame, key: Column, k: int, seed: int, rank_hash: Column | None = None) -> DataFrame:
    """Repeatable random sample of k rows without replacement: the first by ``rank_hash``, or by a hash of seed and key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key) if rank_hash is None else rank_hash, key).limit(k)


def stratified_split(df: DataFrame, stratum: str, key: str, share: float, rank_hash: Column) -> DataFrame:
    """Mark int(share * n) rows of each stratum as validation, the rest as training.

    Rows are ranked by hash in slices that the data set, so one stratum may hold all rows.
    """
    from kymora.operators.ordered import attach_stats, with_sorted_index

    df = with_sorted_index(df.withColumn("__h", rank_hash), [stratum], ["__h", key], "__pos", 1)
    df = attach_stats(df, [stratum], F.count(F.lit(1)).alias("__n"))
    out = df.withColumn(
        "split", F.when(F.col("__pos") <= F.floor(F.col("__n") * share), "validation").otherwise("training")
    )
    return out.drop("__h", "__pos", "__n")


def group_pairs(groups: DataFrame, name: str, references: Sequence[str]) -> DataFrame:
    """All two-combinations of a small group list, oriented by reference preference."""
    a = groups.select(F.col(name).alias("a"))
    b = groups.select(F.col(name).alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    ref = F.when(F.lit(False), F.lit(""))
    for r in references:
        ref = ref.when((F.col("a") == r) | (F.col("b") == r), F.lit(r))
    ref = ref.otherwise(F.col("a"))
    pairs = pairs.withColumn("reference", ref)
    return pairs.select(
        F.when(F.col("a") == F.col("reference"), F.col("b")).otherwise(F.col("a")).alias("comparison"), "reference"
    )


def point_grid(df: DataFrame, n: Column) -> DataFrame:
    """Evenly spaced points of the unit square, row by row, for each input row."""
    axis = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 0.5) / n)
    rows = df.withColumn("gy", F.explode(axis))
    return rows.withColumn("gx", F.explode(axis))


def crop_boxes(df: DataFrame, height: Column, width: Column, layers: int, ratio: float) -> DataFrame:
    """Overlapping crop boxes of each image: one whole box, then 2^layer per side."""
    out = df.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers))))
    side = F.pow(F.lit(2), F.col("layer")).cast("int")
    short = F.least(height, width)
    overlap = F.floor(F.lit(ratio) * short * (2 / side))

    def length(total: Column) -> Column:
        return F.ceil((overlap * (side - 1) + total) / side)

    w, h = length(width), length(height)
    cells = F.sequence(F.lit(0), side - 1)
    out = out.withColumns({"__w": w, "__h": h, "__o": overlap})
    out = out.withColumn("ix", F.explode(cells)).withColumn("iy", F.explode(cells))
    x0 = F.floor((F.col("__w") - F.col("__o")) * F.col("ix"))
    y0 = F.floor((F.col("__h") - F.col("__o")) * F.col("iy"))
    whole = F.col("layer") == 0
    return out.select(
        *df.columns,
        "layer",
        F.when(whole, 0).otherwise(x0).alias("x0"),
        F.when(whole, 0).otherwise(y0).alias("y0"),
        F.when(whole, width).otherwise(F.least(x0 + F.col("__w"), width)).alias("x1"),
        F.when(whole, height).otherwise(F.least(y0 + F.col("__h"), height)).alias("y1"),
    )
