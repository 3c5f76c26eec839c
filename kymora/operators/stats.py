"""Grouped statistics.  Quantiles are exact and computed without gathering groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.operators.ordered import attach_stats, exact_quantiles, null_safe_join, with_quantiles


def group_summary(df: DataFrame, keys: Sequence[str], values: Sequence[str], first: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Mean, max and min of several columns; attributes take their first non-null value in order."""
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    for c in first:
        aggs.append(F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).getField(c).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def group_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group; rows with a null key are left out, as the source tools do."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def category_shares(df: DataFrame, group: str, category: str, levels: Sequence[str]) -> DataFrame:
    """Percent of each category in its group, one column per level, absent ones 0."""
    counted = df.na.drop(subset=[group, category]).groupBy(group)
    total = F.count(F.lit(1))
    return counted.agg(*[(F.count_if(F.col(category) == v) / total * 100).alias(v) for v in levels])


def shape_shares(df: DataFrame, key: str, shape: str, turn: str, first: Sequence[str], order: str) -> DataFrame:
    """Percent of each posture per recording, over all frames and over frames without a turn."""
    n, turns = F.count(F.lit(1)), F.count_if(F.col(turn))
    aggs = [(turns / n * 100).alias("z_axis_turn_percentage")]
    for label, name in (("C-shape", "c_shape"), ("S-shape", "s_shape"), ("Straight", "straight")):
        hit = F.count_if((F.col(shape) == label) & ~F.col(turn))
        aggs.append((hit / n * 100).alias(f"{name}_percentage"))
        aggs.append(F.coalesce(F.try_divide(hit, n - turns) * 100, F.lit(0.0)).alias(f"{name}_percentage_excluding_z"))
    aggs += [F.min_by(F.struct(c), order).getField(c).alias(c) for c in first]
    return df.groupBy(key).agg(*aggs)


def label_share(df: DataFrame, keys: Sequence[str], column: str, label: str, name: str) -> DataFrame:
    """Percent of a label; nulls count in the denominator."""
    return df.groupBy(*keys).agg((F.avg(F.when(F.col(column) == label, 1.0).otherwise(0.0)) * 100).alias(name))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    return with_quantiles(base, df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})


def median_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return describe(df, keys, value).drop("q25", "q75")


def two_level_summary(df: DataFrame, detail: str, group: str, value: str) -> DataFrame:
    """Summary per (detail, group) and per group; the coarser rows have a null detail.  Both sets go through the same steps."""
    both = df.select(detail, group, value).withColumn("__set", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn(detail, F.when(F.col("__set") == 0, F.col(detail)))
    return median_summary(both, ["__set", detail, group], value).drop("__set")


def frame_spread(df: DataFrame, frame: str, value: str) -> DataFrame:
    """Mean and sd per frame over annotators, scaled by the range of the means.

    The interval uses the row count of the first frame.
    """
    per = df.groupBy(frame).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("__n"))
    total = per.agg(
        (F.max("mean") - F.min("mean")).alias("__range"), F.min("mean").alias("__lo"), F.min_by("__n", frame).alias("__first")
    )
    out = per.crossJoin(total)
    half = 1.96 * F.col("std") / F.sqrt("__first")
    return out.select(
        frame,
        "mean",
        "std",
        F.try_divide(F.col("std"), F.col("__range")).alias("std_norm"),
        F.try_divide(half, F.col("__range")).alias("ci_norm"),
        F.try_divide(F.col("mean") - F.col("__lo"), F.col("__range")).alias("mean_norm"),
    )


def student_t_975(df: int) -> float:
    """0.975 quantile of Student's t for whole degrees of freedom, by bisection on the
    finite trigonometric form of its distribution function."""

    def cdf(t: float) -> float:
        th = math.atan(t / math.sqrt(df))
        c, s = math.cos(th), math.sin(th)
        if df % 2:
            term, total = c, 0.0
            for k in range(1, df - 1, 2):
                total += term
                term *= c * c * (k + 1) / (k + 2)
            a = 2 / math.pi * (th + s * total) if df > 1 else 2 * th / math.pi
        else:
            term, total = 1.0, 0.0
            for k in range(0, df - 1, 2):
                total += term
                term *= c * c * (k + 1) / (k + 2)
            a = s * total
        return 0.5 + a / 2

    lo, hi = 0.0, 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < 0.975 else (lo, mid)
    return (lo + hi) / 2


T_TABLE_SIZE = 60
Z_975 = 1.959963984540054


def t_quantile(df: Column) -> Column:
    """Exact up to T_TABLE_SIZE degrees of freedom; beyond them the large-sample expansion, which is off by less than 1e-8."""
    table = F.array(*[F.lit(student_t_975(i)) for i in range(1, T_TABLE_SIZE + 1)])
    z, v = Z_975, df.cast("double")
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    far = z + F.try_divide(F.lit(g1), v) + F.try_divide(F.lit(g2), v**2) + F.try_divide(F.lit(g3), v**3) + F.try_divide(F.lit(g4), v**4)
    return F.when(df < 1, None).when(df <= T_TABLE_SIZE, F.try_element_at(table, df.cast("int"))).otherwise(far)


def mean_intervals(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error, 95 % t interval and coefficient of variation."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"))
    sem = F.col("__sd") / F.sqrt("n")
    half = F.when(F.col("n") > 1, t_quantile(F.col("n") - 1)) * sem
    return g.select(
        *keys, "n", "mean", sem.alias("sem"), (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"),
        F.try_divide(F.col("__sd"), F.col("mean") * F.lit(0.01)).alias("cv"),
    )


def linear_trend(means: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    return means.groupBy(*keys).agg(
        F.regr_slope(value, time).alias("slope"), F.regr_intercept(value, time).alias("intercept"), F.regr_r2(value, time).alias("r2")
    )


def absolute_difference_summary(df: DataFrame, diffs: Sequence[str]) -> DataFrame:
    """(source, metric, value) rows of |difference| statistics."""
    long = df.select([F.abs(F.col(c)).alias(c) for c in diffs]).unpivot([], list(diffs), "source", "d").na.drop(subset=["d"])
    stats = describe(long, ["source"], "d")
    return stats.unpivot(["source"], ["mean", "median", "min", "max", "std"], "metric", "value")


def binned_counts(df: DataFrame, sources: Sequence[str], binnings: dict[str, int], bin_of) -> DataFrame:
    """Counts per source, binning and bin; bins nobody falls in count 0."""
    long = df.select(*sources).unpivot([], list(sources), "source", "angle")
    kinds = F.array(*[F.struct(F.lit(name).alias("binning"), bin_of(F.col("angle"), 180.0 / n).alias("bin")) for name, n in binnings.items()])
    seen = long.select("source", F.explode(kinds).alias("b")).select("source", "b.binning", "b.bin")
    counts = seen.filter(F.col("bin").isNotNull()).groupBy("source", "binning", "bin").agg(F.count(F.lit(1)).alias("n"))
    spec = F.array(*[F.struct(F.lit(name).alias("binning"), F.lit(n).alias("k")) for name, n in binnings.items()])
    names = F.array(*[F.lit(s) for s in sources])
    dim = df.sparkSession.range(1).select(F.explode(names).alias("source")).select("source", F.explode(spec).alias("s"))
    dim = dim.select("source", "s.binning", F.explode(F.sequence(F.lit(1).cast("long"), F.col("s.k").cast("long"))).alias("bin"))
    out = dim.join(counts, ["source", "binning", "bin"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def correlation_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair over the rows valid in both, as (a, b, r) rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs],
        *[F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs],
        *[F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), F.lit(1.0).alias("r")) for a in columns],
    )
    return one.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.a", "c.b", "c.r")


def first_valid(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First non-null value of each column per group, in a stated order."""
    o = [F.col(c) for c in order]
    aggs = [F.min(F.when(F.col(c).isNotNull(), F.struct(*o, F.col(c).alias("__v")))).getField("__v").alias(c) for c in columns]
    return df.groupBy(*keys).agg(*aggs)


def repeated_with_labels(df: DataFrame, key: str, label: Column) -> DataFrame:
    """Keys seen more than once with their count and sorted distinct labels.

    The label set is the fixed list of condition pairs, so the set stays small.
    """
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set(label)).alias("__l"))
    return g.filter(F.col("count") > 1).select(key, "count", F.array_join("__l", ", ").alias("comparisons"))


def distinct_values(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Distinct values with null as one of them."""
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias(name))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Equal-width density histogram per group; the last bin is closed, empty bins are kept."""
    span = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__n"))
    flat = F.col("__lo") == F.col("__hi")
    span = span.select(
        *keys, "__n", F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("__lo"),
        F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("__hi"),
    ).filter("__n > 0")
    j = null_safe_join(df.filter(F.col(value).isNotNull()), span, list(keys))
    b = F.least(F.floor((F.col(value) - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo"))), F.lit(bins - 1))
    counts = j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dim = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = null_safe_join(dim, counts, [*keys, "bin"])
    width = (F.col("__hi") - F.col("__lo")) / bins
    n = F.coalesce("n", F.lit(0))
    return out.select(*keys, "bin", (F.col("__lo") + F.col("bin") * width).alias("left"), n.alias("n"), (n / (F.col("__n") * width)).alias("density"))


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and the number of points beyond them."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    j = null_safe_join(df.filter(F.col(value).isNotNull()), q, list(keys))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    w = j.groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return null_safe_join(q, w, list(keys))


def padded_range(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.1) -> DataFrame:
    pad = (F.max(value) - F.min(value)) * share
    return df.groupBy(*keys).agg((F.min(value) - pad).alias("low"), (F.max(value) + pad).alias("high"))


def z_summary(df: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count_if(F.abs(value) > limit).alias("n_extreme")
    )
    return with_quantiles(base, df, keys, value, {"median": 0.5})


def size_filter(df: DataFrame, group: str, area: str, share: float = 0.75) -> DataFrame:
    """Keep objects larger than a share of the mean of their image."""
    out = attach_stats(df, [group], F.avg(area).alias("__mean"))
    return out.filter(F.col(area) > F.col("__mean") * share).drop("__mean")
