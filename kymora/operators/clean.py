"""Row and column cleaning: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.functions.curves import top_prominence
from kymora.operators.ordered import neighbour_columns, null_safe_join


def keep_and_rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep mapped columns under new names; columns the table lacks are skipped."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items() if old in df.columns])


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def ensure_columns(df: DataFrame, wanted: Sequence[str], default: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.lit(default) for c in missing_columns(df, wanted)})


def trim_headers(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns]).drop(*drop)


def fill_from_first_row(df: DataFrame, file: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the value in the file's first row, even when that is null."""
    firsts = df.groupBy(file).agg(*[F.min_by(F.struct(c), order).getField(c).alias(f"__{c}") for c in columns])
    out = null_safe_join(df, firsts, [file])
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns})
    return out.drop(*[f"__{c}" for c in columns])


def unexpected_row_counts(df: DataFrame, file: str, expected: int = 613) -> DataFrame:
    return df.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") != expected)


def drop_listed(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove rows whose key is in the list."""
    return null_safe_join(df, listed.select(*keys).distinct(), list(keys), "left_anti")


def frame_jumps(df: DataFrame, keys: Sequence[str], index: str, angle: str, limit: float = 30.0) -> DataFrame:
    """Rows whose angle moved by more than ``limit`` since the previous row."""
    out = neighbour_columns(df, keys, index, 1, {"prev_angle": lambda w: F.lag(angle).over(w)})
    out = out.withColumn("change", F.abs(F.col(angle) - F.col("prev_angle")))
    return out.filter(F.col("change") > limit)


def with_previous(df: DataFrame, keys: Sequence[str], index: str, value: str, name: str = "prev") -> DataFrame:
    return neighbour_columns(df, keys, index, 1, {name: lambda w: F.lag(value).over(w)})


def diagnostic_issues(df: DataFrame, change: Column, flip: Column, head: Column, body: Column) -> DataFrame:
    """One row per issue found in a record; a record may give several."""
    issues = F.array(
        F.when(change > 20, F.lit("Large angle change")),
        F.when(flip, F.lit("Possible orientation flip")),
        F.when((F.coalesce(head, F.lit(0)) < 5) | (F.coalesce(body, F.lit(0)) < 5), F.lit("Small vector magnitude")),
    )
    return df.withColumn("issue", F.explode(F.array_compact(issues)))


def shape_check(masks: Column, pinhole: Column, folded: Column, merged: Column) -> Column:
    """First failing check names the object."""
    return (
        F.when(masks > 1, "many masks").when(pinhole, "pinhole").when(folded, "folded").when(merged, "merged")
    ).otherwise("normal")


def is_folded(widths: Column, share: float = 0.03) -> Column:
    """Not folded when both tips are clearly thinner than the middle of the profile.

    The second tip leaves out the last point, as the measure is defined.
    """
    n = F.size(widths)
    tip = F.floor(n * F.lit(share)).cast("int")
    mid = F.element_at(widths, (F.floor(n / 2) + 1).cast("int"))

    def mean_of(arr: Column) -> Column:
        return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr))

    first = mean_of(F.slice(widths, F.lit(1), tip))
    last = mean_of(F.slice(widths, n - tip, tip))
    thin = (first < mid * 0.95) & (last < mid * 0.95)
    return ~F.coalesce(thin, F.lit(False))


def has_prominent_peak(widths: Column, prominence: float = 35.0) -> Column:
    """Some inner peak of the profile stands out by at least ``prominence``."""
    return F.coalesce(top_prominence(widths) >= prominence, F.lit(False))
