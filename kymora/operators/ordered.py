"""Building blocks for ordered series and grouped statistics.

A group (one subject, one recording) may hold a large share of all rows, so no
helper here puts a whole group into one window partition.  Ordered work runs on
bounded *chunks* of a group: rows near a chunk border are copied to the chunk
next to it, and running values cross chunks through per-chunk summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymora.session import cut_lineage

CHUNK = 4096
#: Half the share of a group's values that a bracket around a quantile holds, and the accuracy of the summary that finds it.
SPREAD, SUMMARY_ACCURACY = 0.0005, 10_000
#: Parts that a group's values are dealt to when they meet its brackets.
PARTS = 16
#: Values under which a summary's brackets are too narrow; such a group is counted whole.
SUMMARY_ROWS = 20_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a null key equals a null key (pandas and R merge do so).

    Keeps one copy of the keys.  For full joins the key is taken from either side.
    """
    if not keys:
        if how in ("left_semi", "left_anti"):
            raise ValueError("a semi or anti join needs keys")
        return left.crossJoin(right)
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "outer", "full_outer", "right"):
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(F.col(k), F.col(f"__r_{k}")))
    return joined.drop(*[f"__r_{k}" for k in keys])


def attach_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Add group aggregates to every row: partial aggregation, then a join back.

    Unlike a window over the group, rows of a large group stay spread out.
    """
    stats = df.groupBy(*keys).agg(*aggs)
    return null_safe_join(df, stats, keys)


def width_bucket(order: Column, width: float) -> Column:
    """Deterministic chunk number of a numeric order value."""
    return F.floor(order / F.lit(width)).cast("long")


def time_bucket(df: DataFrame, ts: str, seconds: int) -> Column:
    """Chunk number of a time column, with or without time zone."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")
    day = F.unix_date(F.to_date(ts)).cast("long") * 86400
    return F.floor((day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / F.lit(seconds)).cast("long")


def _offsets(sizes: DataFrame, keys: Sequence[str], total: str, out: str) -> DataFrame:
    """Sum of ``total`` over the earlier buckets of a group.

    Buckets of a table without keys are summed in stretches of CHUNK first, so that one task sees only their sums.
    """
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if keys:
        return sizes.withColumn(out, before(Window.partitionBy(*keys).orderBy("__o_b"), total))
    sizes = sizes.withColumn("__o_u", F.floor(F.col("__o_b") / CHUNK))
    upper = sizes.groupBy("__o_u").agg(F.sum(total).alias("__o_t2"))
    upper = upper.select("__o_u", before(Window.orderBy("__o_u"), "__o_t2").alias("__o_before"))
    inner = sizes.withColumn(out, before(Window.partitionBy("__o_u").orderBy("__o_b"), total))
    return null_safe_join(inner, upper, ["__o_u"]).withColumn(out, F.col(out) + F.col("__o_before")).drop("__o_u", "__o_before")


def with_row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    name: str = "frame",
    start: int = 0,
) -> DataFrame:
    """Dense position of each row in its group.

    ``bucket`` is a non-decreasing function of the leading order column; rows are
    ranked inside (group, bucket) and shifted by the sizes of earlier buckets.
    """
    rows = df.withColumn("__o_b", bucket)
    local = Window.partitionBy(*keys, "__o_b").orderBy(*order)
    ranked = rows.withColumn("__o_rn", F.row_number().over(local))
    sizes = rows.groupBy(*keys, "__o_b").agg(F.count(F.lit(1)).alias("__o_n"))
    offsets = _offsets(sizes, keys, "__o_n", "__o_off").drop("__o_n")
    out = null_safe_join(ranked, offsets, [*keys, "__o_b"])
    return out.withColumn(name, (F.col("__o_rn") + F.col("__o_off") + F.lit(start - 1)).cast("long")).drop(
        "__o_rn", "__o_off", "__o_b"
    )


def with_sorted_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, start: int = 0, part: str | None = None) -> DataFrame:
    """Dense position of each row in its group, in slices that the data set.

    Rows are dealt by ranges of keys, order and arrival, which Spark finds from a sample, so neither a large group nor many
    equal values make a large slice.  Each slice is sorted and counted by group; a group's earlier slices shift its rows.
    The sorted rows are stored once.  ``part`` names the slice in the result, if wanted.
    """
    spread = df.withColumn("__o_r", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(*[F.col(c) for c in (*keys, *order, "__o_r")]).sortWithinPartitions(*keys, *order, "__o_r")
    at = F.monotonically_increasing_id()
    rows = cut_lineage(dealt.drop("__o_r").withColumns({"__o_p": F.shiftright(at, 33), "__o_i": at.bitwiseAND((1 << 33) - 1)}))
    sizes = rows.groupBy("__o_p", *keys).agg(F.count(F.lit(1)).alias("__o_n"), F.min("__o_i").alias("__o_low"))
    # as many rows as slices and groups
    earlier = Window.partitionBy(*keys).orderBy("__o_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__o_off", F.coalesce(F.sum("__o_n").over(earlier), F.lit(0)) - F.col("__o_low")).drop("__o_n", "__o_low")
    out = null_safe_join(rows, sizes, ["__o_p", *keys]).withColumn(name, F.col("__o_i") + F.col("__o_off") + F.lit(start))
    return (out.withColumnRenamed("__o_p", part) if part else out.drop("__o_p")).drop("__o_i", "__o_off")


def neighbour_columns(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    reach: int,
    columns: dict[str, Callable[[Window], Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Window columns that look at most ``reach`` rows back or ahead.

    ``index`` must be dense in each group.  Each callable gets the ordered window
    of the chunk; rows within ``reach`` of a border are copied over it.
    """
    chunk = max(chunk, reach + 1)
    low = F.greatest(F.floor((F.col(index) - reach) / chunk), F.lit(0))
    high = F.floor((F.col(index) + reach) / chunk)
    copies = df.withColumn("__o_chunk", F.explode(F.sequence(low, high)))
    w = Window.partitionBy(*keys, "__o_chunk").orderBy(index)
    copies = copies.withColumns({n: f(w) for n, f in columns.items()})
    return copies.filter(F.col("__o_chunk") == F.floor(F.col(index) / chunk)).drop("__o_chunk")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum in group order, carried across buckets."""
    rows = df.withColumn("__o_b", bucket).withColumn("__o_rt", value)
    local = Window.partitionBy(*keys, "__o_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("__o_run", F.sum("__o_rt").over(local))
    totals = rows.groupBy(*keys, "__o_b").agg(F.sum("__o_rt").alias("__o_t"))
    offsets = _offsets(totals, keys, "__o_t", "__o_off").drop("__o_t")
    out = null_safe_join(inner, offsets, [*keys, "__o_b"])
    return out.withColumn(name, F.coalesce(F.col("__o_run"), F.lit(0)) + F.col("__o_off")).drop(
        "__o_run", "__o_off", "__o_b", "__o_rt"
    )


def nearest_valid(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: Column,
    prev: str = "prev",
    next: str = "next",
    width: int = CHUNK,
) -> DataFrame:
    """Nearest non-null payload strictly before and after each row of its group."""
    rows = df.withColumn("__o_b", width_bucket(F.col(order), width)).withColumn("__o_pay", payload)
    # both ways from the far end on: a frame that grows keeps its last value, one that shrinks would be read again for every row
    back, ahead = (Window.partitionBy(*keys, "__o_b").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (order, F.desc(order)))
    inner = rows.withColumns(
        {"__o_lp": F.last("__o_pay", True).over(back), "__o_ln": F.last("__o_pay", True).over(ahead)}
    )
    edge = F.when(F.col("__o_pay").isNotNull(), F.col(order))
    ends = rows.groupBy(*keys, "__o_b").agg(
        F.max_by("__o_pay", edge).alias("__o_last"), F.min_by("__o_pay", edge).alias("__o_first")
    )
    kw = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ends = ends.select(
        *keys,
        "__o_b",
        F.last("__o_last", True).over(kw.orderBy("__o_b").rowsBetween(Window.unboundedPreceding, -1)).alias("__o_op"),
        F.last("__o_first", True).over(kw.orderBy(F.desc("__o_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("__o_on"),
    )
    out = null_safe_join(inner, ends, [*keys, "__o_b"])
    return out.withColumns(
        {prev: F.coalesce("__o_lp", "__o_op"), next: F.coalesce("__o_ln", "__o_on")}
    ).drop("__o_b", "__o_pay", "__o_lp", "__o_ln", "__o_op", "__o_on")


def run_ids(
    df: DataFrame, keys: Sequence[str], index: str, state: Column, name: str = "run_id"
) -> DataFrame:
    """Number the runs of equal consecutive ``state`` in each group, from 1."""
    rows = df.withColumn("__o_s", state)
    rows = neighbour_columns(
        rows,
        keys,
        index,
        1,
        {"__o_new": lambda w: F.when(F.lag("__o_s").over(w).eqNullSafe(F.col("__o_s")) & (F.col(index) > 0), 0).otherwise(1)},
    )
    return running_total(
        rows, keys, [index], width_bucket(F.col(index), CHUNK), F.col("__o_new"), name
    ).drop("__o_s", "__o_new")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group that has a value.

    A first aggregate keeps a mergeable summary of bounded size for each group, which gives a bracket around each
    quantile: the values at SPREAD below and above it, or the whole range of a group under SUMMARY_ROWS.  A second one
    counts values: those in a bracket one by one, those between brackets together.  So every group, large or small, takes
    two combining aggregates and no job before the action, and of a large one about 2 * SPREAD of its values are sorted for each quantile.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    values = df.select(*keys, x.alias("__o_v")).filter(F.col("__o_v").isNotNull() & ~F.isnan("__o_v"))
    by = keys or ["__o_all"]
    if not keys:
        values = values.withColumn("__o_all", F.lit(1))
    sides = [max(0.0, p - SPREAD) for p in probs.values()] + [min(1.0, p + SPREAD) for p in probs.values()]
    summary = F.percentile_approx("__o_v", sides, SUMMARY_ACCURACY)
    spans = values.groupBy(*by).agg(summary.alias("__o_s"), F.min("__o_v").alias("__o_lo"), F.max("__o_v").alias("__o_hi"), F.count(F.lit(1)).alias("__o_total"))

    def bracket(i: int, p: float) -> Column:
        small = F.col("__o_total") < SUMMARY_ROWS
        low = F.when(small | F.lit(p <= SPREAD), F.col("__o_lo")).otherwise(F.get("__o_s", F.lit(i)))
        high = F.when(small | F.lit(p >= 1 - SPREAD), F.col("__o_hi")).otherwise(F.get("__o_s", F.lit(len(probs) + i)))
        return F.struct(low.alias("lo"), high.alias("hi"))

    ranges = spans.select(*by, "__o_total", F.array(*[bracket(i, p) for i, p in enumerate(probs.values())]).alias("__o_in"))
    v = F.col("__o_v")
    # a large group is dealt to several tasks, each with a copy of its brackets
    dealt = values.withColumn("__o_k", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    copies = ranges.withColumn("__o_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    near = null_safe_join(dealt, copies, [*by, "__o_k"], "inner")
    inside = F.exists("__o_in", lambda r: (v >= r["lo"]) & (v <= r["hi"]))
    passed = F.size(F.filter("__o_in", lambda r: r["hi"] < v))
    counts = near.groupBy(*by, F.when(inside, v).alias("__o_at"), F.when(~inside, passed).alias("__o_gap"), "__o_total").agg(F.count(F.lit(1)).alias("__o_n"), F.min("__o_v").alias("__o_v"))
    before = Window.partitionBy(*by).orderBy("__o_v").rowsBetween(Window.unboundedPreceding, -1)
    skip, end = F.col("__o_skip"), F.col("__o_skip") + F.col("__o_n")
    counts = counts.withColumn("__o_skip", F.coalesce(F.sum("__o_n").over(before), F.lit(0)))
    exact = F.when(F.col("__o_gap").isNull(), F.col("__o_v")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= skip) & (rank < end), exact))

    places = {n: F.lit(p) * (F.col("__o_total") - 1) for n, p in probs.items()}
    cells = counts.groupBy(*by, "__o_total").agg(*[at(f(c)).alias(f"__o_{side}_{n}") for n, c in places.items() for side, f in (("a", F.floor), ("b", F.ceil))])
    cols = []
    for n, c in places.items():
        low, high = F.col(f"__o_a_{n}"), F.col(f"__o_b_{n}")
        cols.append((low + (high - low) * (c - F.floor(c))).alias(n))
    return cells.select(*keys, *cols)


def with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Add exact quantile columns to a table of group statistics."""
    return null_safe_join(stats, exact_quantiles(df, keys, value, probs), list(keys))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in a stated order, by a combining aggregate."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("__o_row")
    )
    return packed.select(*keys, *[F.col("__o_row")[c].alias(c) for c in rest])
