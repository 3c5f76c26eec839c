"""Filters, smoothing and gap filling along an ordered index.

``index`` is dense (0, 1, 2 ...) in each group unless a function says otherwise;
``with_row_index`` makes it so.  Work runs on chunks with copied borders.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymora.operators.ordered import (
    attach_stats,
    nearest_valid,
    neighbour_columns,
    null_safe_join,
    with_sorted_index,
)

SIZE = "__size"


def with_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach_stats(df, keys, F.count(F.lit(1)).alias(SIZE))


def moving_mean(df: DataFrame, keys: Sequence[str], index: str, value: str, window: int, name: str) -> DataFrame:
    """Centred mean of the values present, shorter at the ends."""
    h = window // 2
    return neighbour_columns(df, keys, index, h, {name: lambda w: F.avg(value).over(w.rowsBetween(-h, h))})


def moving_mean_raw_edges(df: DataFrame, keys: Sequence[str], index: str, value: str, name: str) -> DataFrame:
    """Five-point mean; the first and last two points stay as they are.

    Series under five points use their own length as the window, with zeros outside.
    """
    frames = {5: (-2, 2), 4: (-2, 1), 3: (-1, 1), 2: (-1, 0), 1: (0, 0)}
    cols = {f"__m{k}": (lambda w, f=f: F.sum(value).over(w.rowsBetween(*f))) for k, f in frames.items()}
    out = neighbour_columns(with_size(df, keys), keys, index, 2, cols)
    n, i = F.col(SIZE), F.col(index)
    k = F.least(n, F.lit(5))
    edge = F.floor(k / 2)
    mean = F.when(k == 5, F.col("__m5") / 5)
    for w in (4, 3, 2, 1):
        mean = mean.when(k == w, F.col(f"__m{w}") / w)
    raw = (n > edge * 2) & ((i < edge) | (i >= n - edge))
    return out.withColumn(name, F.when(raw, F.col(value)).otherwise(mean)).drop(SIZE, *cols)


def _window_values(w: Window, value: str, back: int, ahead: int) -> Column:
    rows = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-back, ahead))
    return F.transform(rows, lambda r: r["v"])


def array_median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    lo, hi = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (lo + hi) / 2


def median_filter_edges(df: DataFrame, keys: Sequence[str], index: str, value: str, kernel: int, edges: str, name: str) -> DataFrame:
    """Median filter with mirrored, repeated or shrinking edges."""
    h = kernel // 2
    reach = h + 1
    out = neighbour_columns(
        with_size(df, keys), keys, index, reach,
        {"__w": lambda w: _window_values(w, value, h, h), "__x": lambda w: _window_values(w, value, reach, reach)},
    )
    i, n, arr = F.col(index).cast("int"), F.col(SIZE).cast("int"), F.col("__w")
    left, right = F.greatest(F.lit(0), h - i), F.greatest(F.lit(0), i + h - n + 1)
    if edges == "mirror":
        full = F.concat(F.slice(arr, F.lit(2), left), arr, F.slice(arr, F.greatest(F.size(arr) - right, F.lit(1)), right))
    elif edges == "nearest":
        full = F.concat(F.array_repeat(F.get(arr, F.lit(0)), left), arr, F.array_repeat(F.element_at(arr, -1), right))
    elif edges == "auto":
        wide, j = F.col("__x"), n - 1 - i
        head = F.slice(wide, F.lit(1), i * 2 + 3)
        tail_n = F.least(j * 2 + 3, F.size(wide))
        tail = F.slice(wide, F.size(wide) - tail_n + 1, tail_n)
        full = F.when((j < h) & ((i >= h) | (j >= i)), tail).when(i < h, head).otherwise(arr)
    else:
        raise ValueError(f"unknown edge rule {edges}")
    return out.withColumn(name, array_median(full)).drop(SIZE, "__w", "__x")


def median_filter_zero(df: DataFrame, keys: Sequence[str], index: str, value: str, kernel: int, name: str) -> DataFrame:
    """Median filter with zeros outside the series."""
    h = kernel // 2
    out = neighbour_columns(df, keys, index, h, {"__w": lambda w: _window_values(w, value, h, h)})
    arr = F.transform("__w", lambda v: v.cast("double"))
    full = F.concat(arr, F.array_repeat(F.lit(0.0), kernel - F.size(arr)))
    return out.withColumn(name, F.get(F.array_sort(full), F.lit(h))).drop("__w")


def polynomial_smooth(df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], window: int = 11, order: int = 3, suffix: str = "_smooth") -> DataFrame:
    """Least-squares polynomial smoothing; the ends use the fit of the end window.

    Each point is a fixed weighting of one window, taken from the projection matrix
    of the fit.  Series shorter than the window have no value.
    """
    h = window // 2
    v = np.vander(np.arange(window) - h, order + 1)
    proj = v @ np.linalg.pinv(v)
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in proj])
    reach = window - 1
    cols = {f"__w_{c}": (lambda w, c=c: _window_values(w, c, reach, reach)) for c in values}
    out = neighbour_columns(with_size(df, keys), keys, index, reach, cols)
    i, n = F.col(index).cast("int"), F.col(SIZE).cast("int")
    row = F.when(i < h, i).when(i >= n - h, window - n + i).otherwise(h)
    first = F.greatest(i - reach, F.lit(0))
    start = i - row - first + 1
    for c in values:
        part = F.zip_with(F.slice(F.col(f"__w_{c}"), start, window), F.get(weights, row), lambda a, b: a * b)
        out = out.withColumn(c + suffix, F.when(n >= window, F.aggregate(part, F.lit(0.0), lambda s, x: s + x)))
    return out.drop(SIZE, *cols)


def gradient(df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], fps: float, names: Sequence[str]) -> DataFrame:
    """Central difference times the frame rate, one-sided at the ends."""
    cols = {}
    for c in values:
        cols[f"__p_{c}"] = lambda w, c=c: F.lag(c).over(w)
        cols[f"__n_{c}"] = lambda w, c=c: F.lead(c).over(w)
    out = neighbour_columns(df, keys, index, 1, cols)
    for c, name in zip(values, names):
        p, n, x = F.col(f"__p_{c}"), F.col(f"__n_{c}"), F.col(c)
        g = F.when(p.isNull(), n - x).when(n.isNull(), x - p).otherwise((n - p) / 2)
        out = out.withColumn(name, g * fps)
    return out.drop(*cols)


def remove_noise_peaks(df: DataFrame, keys: Sequence[str], index: str, angle: str, window: int = 3, limit: float = 15.0, max_sd: float = 10.0) -> DataFrame:
    """Replace a point that stands apart from calm stretches before and after it.

    Reads raw values only.  Adds the original value and what was done.
    """
    before = lambda w: w.rowsBetween(-window, -1)
    after = lambda w: w.rowsBetween(1, window)
    out = neighbour_columns(
        with_size(df, keys), keys, index, window,
        {
            "__mb": lambda w: F.avg(angle).over(before(w)), "__sb": lambda w: F.stddev_pop(angle).over(before(w)),
            "__ma": lambda w: F.avg(angle).over(after(w)), "__sa": lambda w: F.stddev_pop(angle).over(after(w)),
        },
    )
    i, n, x = F.col(index), F.col(SIZE), F.col(angle)
    mb, sb, ma, sa = (F.col(c) for c in ("__mb", "__sb", "__ma", "__sa"))
    wb, wa = 1 / (sb + 1e-6), 1 / (sa + 1e-6)
    apart_b, apart_a = (F.abs(x - mb) > limit) & (sb < max_sd), (F.abs(x - ma) > limit) & (sa < max_sd)
    first = F.when((n > window) & apart_a, ma)
    last = F.when(apart_b, mb)
    inner = F.when(apart_b & apart_a, (mb * wb + ma * wa) / (wb + wa))
    new = F.when(i == 0, first).when(i == n - 1, last).otherwise(inner)
    out = out.withColumn("__new", new)
    hit = F.col("__new").isNotNull()
    used = F.when(i < window, i).when(i >= n - window, n - i - 1).otherwise(window)
    return out.select(
        *[c for c in df.columns if c != angle],
        F.coalesce("__new", angle).alias(angle),
        x.alias("original_angle"),
        hit.alias("is_noise_peak"),
        F.when(hit, F.abs(x - F.col("__new"))).otherwise(0.0).alias("peak_deviation"),
        F.when(hit, used).otherwise(0).cast("long").alias("window_size_used"),
    )


BEND = ("bend_location", "bend_magnitude", "bend_position_y", "bend_position_x")


def fill_failed_frames(df: DataFrame, keys: Sequence[str], frame: str, scalars: Sequence[str], error: str = "error", angle: str = "angle_degrees", straight: float = 3.0) -> DataFrame:
    """Fill frames with an error from their nearest good frames.

    Between two good frames: linear in frame distance.  With one: decay by 0.9 per
    frame.  With none: zeros.  Filled frames keep a text saying so and never feed
    another frame.  ``frame`` need not be dense.
    """
    good = F.when(F.col(error).isNull(), F.struct(F.col(frame).alias("__f"), *[F.col(c) for c in scalars]))
    out = nearest_valid(df, keys, frame, good, "__p", "__n")
    f, p, n = F.col(frame), F.col("__p"), F.col("__n")
    failed = F.col(error).isNotNull()
    w = (f - p["__f"]) / (n["__f"] - p["__f"])
    two, one_p, one_n = p.isNotNull() & n.isNotNull(), p.isNotNull(), n.isNotNull()

    def filled(c: str) -> Column:
        return (
            F.when(two, p[c] * (1 - w) + n[c] * w)
            .when(one_p, p[c] * F.pow(F.lit(0.9), f - p["__f"]))
            .when(one_n, n[c] * F.pow(F.lit(0.9), n["__f"] - f))
            .otherwise(0.0)
        )

    note = (
        F.when(two, F.concat(F.lit("Interpolated between frames "), p["__f"].cast("string"), F.lit(" and "), n["__f"].cast("string")))
        .when(one_p, F.concat(F.lit("Decayed from previous frame "), p["__f"].cast("string")))
        .when(one_n, F.concat(F.lit("Decayed from next frame "), n["__f"].cast("string")))
        .otherwise("No valid frames available for interpolation")
    )
    new_angle = filled(angle)
    cols = {}
    for c in scalars:
        v = F.when(F.abs(new_angle) <= straight, 0.0).otherwise(filled(c)) if c in BEND else filled(c)
        cols[c] = F.when(failed, v).otherwise(F.col(c))
    cols[error] = F.when(failed, note).otherwise(F.col(error))
    return out.withColumns(cols).drop("__p", "__n")


def interpolate_runs(df: DataFrame, keys: Sequence[str], index: str, matches: Column, value: str) -> DataFrame:
    """Replace each run of matching rows by the line between the rows around it."""
    outside = F.when(~matches, F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    out = nearest_valid(df.withColumn("__m", matches), keys, index, outside, "__p", "__n")
    p, n = F.col("__p"), F.col("__n")
    w = (F.col(index) - p["i"]) / (n["i"] - p["i"])
    line = (
        F.when(p.isNotNull() & n.isNotNull(), p["v"] * (1 - w) + n["v"] * w)
        .when(p.isNotNull(), p["v"])
        .when(n.isNotNull(), n["v"])
        .otherwise(F.col(value))
    )
    return out.withColumn(value, F.when(F.col("__m"), line).otherwise(F.col(value))).drop("__m", "__p", "__n")


def interpolate_bends(df: DataFrame, keys: Sequence[str], index: str, straight: float = 3.0) -> DataFrame:
    """Zero the bend fields of straight frames, then draw lines through the other runs."""
    flat = F.abs("angle_degrees") <= straight
    zeroed = df.withColumns({c: F.when(flat, 0.0).otherwise(F.col(c)) for c in BEND if c in df.columns})
    return interpolate_runs(zeroed, keys, index, ~flat, "bend_location")


def last_known(df: DataFrame, keys: Sequence[str], frame: str, value: Column, default: Column, name: str) -> DataFrame:
    """Forward fill with a default before the first value."""
    out = nearest_valid(df.withColumn(name, value), keys, frame, F.col(name), "__p", "__n")
    return out.withColumn(name, F.coalesce(F.col(name), F.col("__p"), default)).drop("__p", "__n")


def interpolate_arrays(df: DataFrame, keys: Sequence[str], frame: str, good: Column, values: str, identity: Sequence[float]) -> DataFrame:
    """Interpolate an array column of failed frames between good neighbours."""
    payload = F.when(good, F.struct(F.col(frame).alias("f"), F.col(values).alias("v")))
    out = nearest_valid(df.withColumn("__g", good), keys, frame, payload, "__p", "__n")
    p, n = F.col("__p"), F.col("__n")
    w = (F.col(frame) - p["f"]) / (n["f"] - p["f"])
    mixed = F.zip_with(p["v"], n["v"], lambda a, b: a * (1 - w) + b * w)
    fixed = F.array(*[F.lit(float(x)) for x in identity])
    new = (
        F.when(F.col("__g"), F.col(values))
        .when(p.isNotNull() & n.isNotNull(), mixed)
        .when(p.isNotNull(), p["v"])
        .when(n.isNotNull(), n["v"])
        .otherwise(fixed)
    )
    return out.withColumn(values, new).drop("__g", "__p", "__n")


def correct_uncertain(df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], confidence: str, reach: int = 5, limit: float = 0.7) -> DataFrame:
    """Median of the neighbourhood where confidence is low; the point itself counts."""
    cols = {f"__w_{c}": (lambda w, c=c: _window_values(w, c, reach, reach)) for c in values}
    out = neighbour_columns(df, keys, index, reach, cols)
    low = F.col(confidence) < limit
    fixed = {c: F.when(low, array_median(F.col(f"__w_{c}"))).otherwise(F.col(c)) for c in values}
    return out.withColumns(fixed).drop(*cols)


def autocorrelation(df: DataFrame, keys: Sequence[str], index: str, value: str, lags: int = 50) -> DataFrame:
    """Biased autocorrelation per lag, with the mean of the whole series."""
    d = attach_stats(df, keys, F.avg(value).alias("__m")).withColumn("__d", F.col(value) - F.col("__m"))
    cols = {f"__l{k}": (lambda w, k=k: F.lag("__d", k).over(w)) for k in range(1, lags + 1)}
    out = neighbour_columns(d.select(*keys, index, "__d"), keys, index, lags, cols)
    sums = out.groupBy(*keys).agg(
        F.sum(F.col("__d") * F.col("__d")).alias("__s0"), *[F.sum(F.col("__d") * F.col(c)).alias(c) for c in cols], F.count(F.lit(1)).alias("__n")
    )
    acf = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col("__s0" if k == 0 else f"__l{k}"), F.col("__s0")).alias("r")) for k in range(lags + 1)])
    rows = sums.select(*keys, "__n", F.explode(acf).alias("a"))
    return rows.filter(F.col("a.lag") < F.col("__n")).select(*keys, "a.lag", "a.r")


def lag_one_correlation(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    out = neighbour_columns(df, keys, index, 1, {"__l": lambda w: F.lag(value).over(w)})
    return out.groupBy(*keys).agg(F.corr(value, "__l").alias("r"))


def adjusted_p(df: DataFrame, keys: Sequence[str], p: str, tie: Sequence[str], name: str = "padj") -> DataFrame:
    """False-discovery-rate adjustment: running minimum of p*n/rank from the largest p down, over slices that the data set."""
    valid = df.filter(F.col(p).isNotNull())
    ranked = attach_stats(with_sorted_index(valid, keys, [p, *tie], "__rank", 1, "__s"), keys, F.count(F.lit(1)).alias("__n"))
    ranked = ranked.withColumn("__q", F.col(p) * F.col("__n") / F.col("__rank"))
    # from the largest rank down: a frame that grows keeps its minimum, one that shrinks would be read again for every row
    w = Window.partitionBy(*keys, "__s").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    lows = ranked.groupBy(*keys, "__s").agg(F.min("__q").alias("__low"))
    # one row for each slice of a group
    kw = Window.partitionBy(*keys).orderBy(F.desc("__s"))
    lows = lows.select(*keys, "__s", F.min("__low").over(kw.rowsBetween(Window.unboundedPreceding, -1)).alias("__rest"))
    out = null_safe_join(ranked.withColumn("__own", F.min("__q").over(w)), lows, [*keys, "__s"])
    adj = F.least(F.lit(1.0), F.least(F.col("__own"), F.col("__rest")))
    return out.withColumn(name, adj).drop("__rank", "__n", "__q", "__s", "__own", "__rest")
