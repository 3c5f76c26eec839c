"""Joining and comparing measurement sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.operators.ordered import attach_stats, null_safe_join


def left_join_chain(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chained left joins on a composite key; null keys match as in the source tools."""
    for other in others:
        base = null_safe_join(base, other, keys)
    return base


def suffix_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str], how: str = "full") -> DataFrame:
    """Join that renames columns both sides have."""
    both = [c for c in left.columns if c in right.columns and c not in keys]
    for c in both:
        left = left.withColumnRenamed(c, c + suffixes[0])
        right = right.withColumnRenamed(c, c + suffixes[1])
    return null_safe_join(left, right, keys, how)


def overwrite_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which the right side's columns replace same-named ones."""
    overlap = [c for c in right.columns if c in left.columns and c not in keys]
    return null_safe_join(left.drop(*overlap), right, keys)


def fill_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that brings only columns the left side lacks."""
    new = [c for c in right.columns if c not in left.columns]
    return null_safe_join(left, right.select(*keys, *new), keys)


def paired_join(left: DataFrame, right: DataFrame, subject: str, index: str, columns: Sequence[str]) -> DataFrame:
    """Left join per subject; subjects the right side lacks are left out whole."""
    paired = null_safe_join(left, right.select(subject).distinct(), [subject], "left_semi")
    return null_safe_join(paired, right.select(subject, index, *columns), [subject, index])


def bind_columns(files: dict[str, DataFrame], index: str) -> DataFrame:
    """Place tables side by side by row position, columns prefixed by table name."""
    out = None
    for name, df in files.items():
        part = df.select(index, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != index])
        out = part if out is None else null_safe_join(out, part, [index], "full")
    return out


def lookup_or(df: DataFrame, table: DataFrame, key: Column, key_name: str, value: str, default: str) -> DataFrame:
    """Look a generated key up; a missing entry gets the default."""
    out = null_safe_join(df.withColumn(key_name, key), table.select(key_name, value), [key_name])
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def paired_examples(df: DataFrame, subject: str, index: str, source: str, a: str, b: str) -> DataFrame:
    """Rows of two sources for the frames both have."""
    keys = [subject, index]
    ka = df.filter(F.col(source) == a).select(*keys).distinct()
    kb = df.filter(F.col(source) == b).select(*keys).distinct()
    common = ka.intersect(kb)
    return null_safe_join(df.filter(F.col(source).isin(a, b)), common, keys, "left_semi")


def disagreement(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "disagreement") -> DataFrame:
    """Absolute difference of two min-max scaled series, in percent, over rows valid in both."""
    ok = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ok = attach_stats(
        ok, keys, *[f(c).alias(f"__{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))]
    )

    def unit(c: str) -> Column:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        return F.when(hi == lo, 0.0).otherwise((F.col(c) - lo) / (hi - lo))

    out = ok.withColumn(name, F.abs(unit(a) - unit(b)) * 100)
    return out.drop(*[f"__{n}_{c}" for c in (a, b) for n in ("lo", "hi")])


def angle_differences(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in pairs.items()})


def sources_missing(df: DataFrame, subject: str, source: str, expected: int = 2) -> DataFrame:
    """Subjects that do not have the expected number of sources."""
    per = df.groupBy(subject).agg(F.countDistinct(source).alias("n_sources"))
    return per.filter(F.col("n_sources") != expected)
