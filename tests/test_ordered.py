"""Chunked helpers against plain windows, with one group holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kymora.operators import ordered as O
from kymora.operators import series as W


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows belong to one subject; order values have ties and gaps."""
    rnd = random.Random(3)
    data = [("hot" if i % 2 else f"s{i % 20}", rnd.randrange(0, 5000), i, rnd.choice([None, rnd.gauss(0, 9)])) for i in range(1200)]
    df = spark.createDataFrame(data, "s string, t long, id long, x double")
    return df.repartition(7).cache()


def test_row_index_equals_row_number(skewed):
    w = Window.partitionBy("s").orderBy("t", "id")
    out = O.with_row_index(skewed, ["s"], ["t", "id"], F.floor(F.col("t") / 37), "i").withColumn("j", F.row_number().over(w) - 1)
    assert out.filter("i <> j").isEmpty() and out.count() == 1200


def test_neighbour_columns_cross_chunks(skewed):
    d = O.with_row_index(skewed, ["s"], ["t", "id"], F.floor(F.col("t") / 37), "i")
    w = Window.partitionBy("s").orderBy("i")
    out = O.neighbour_columns(d, ["s"], "i", 3, {"a": lambda c: F.avg("x").over(c.rowsBetween(-3, 2)), "l": lambda c: F.lag("id", 3).over(c)}, chunk=8)
    out = out.withColumns({"b": F.avg("x").over(w.rowsBetween(-3, 2)), "m": F.lag("id", 3).over(w)})
    assert out.count() == 1200
    assert out.filter(~(F.round("a", 9).eqNullSafe(F.round("b", 9)) & F.col("l").eqNullSafe(F.col("m")))).isEmpty()


def test_running_total_and_nearest_valid(skewed):
    d = O.with_row_index(skewed, ["s"], ["t", "id"], F.floor(F.col("t") / 37), "i")
    w = Window.partitionBy("s").orderBy("i")
    r = O.running_total(d, ["s"], ["i"], O.width_bucket(F.col("i"), 10), F.col("id"), "c").withColumn("e", F.sum("id").over(w))
    assert r.filter("c <> e").isEmpty()
    v = O.nearest_valid(d, ["s"], "i", F.when(F.col("x").isNotNull(), F.struct("i")), "p", "n", width=10)
    v = v.withColumns(
        {
            "pp": F.last(F.when(F.col("x").isNotNull(), F.col("i")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "nn": F.first(F.when(F.col("x").isNotNull(), F.col("i")), True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    assert v.filter(~(F.col("p.i").eqNullSafe(F.col("pp")) & F.col("n.i").eqNullSafe(F.col("nn")))).isEmpty()


def test_runs(spark):
    d = spark.createDataFrame([("a", i, c) for i, c in enumerate("xxyyyxzz")], "s string, i long, c string")
    assert [r.run_id for r in O.run_ids(d, ["s"], "i", F.col("c")).orderBy("i").collect()] == [1, 1, 2, 2, 2, 3, 4, 4]


def test_partitioning_does_not_change_results(skewed):
    d = O.with_row_index(skewed, ["s"], ["t", "id"], F.floor(F.col("t") / 37), "i")
    a = W.moving_mean(d, ["s"], "i", "x", 5, "m").select("s", "i", F.round("m", 9))
    b = W.moving_mean(O.with_row_index(skewed.repartition(3, "id"), ["s"], ["t", "id"], F.floor(F.col("t") / 91), "i"), ["s"], "i", "x", 5, "m").select("s", "i", F.round("m", 9))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _noisy():
    rng = np.random.default_rng(5)
    y = np.sin(np.linspace(0, 20, 300)) + rng.normal(0, 0.2, 300)
    y[0] += 3
    y[-1] -= 3
    return y


@pytest.fixture(scope="module")
def noisy(spark):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(_noisy())], "s string, i long, x double")


@pytest.mark.parametrize("mode,pad", [("mirror", "reflect"), ("nearest", "edge")])
def test_median_edges(noisy, mode, pad):
    y = _noisy()
    want = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(y, 5, mode=pad), 11), axis=1)
    got = [r.m for r in W.median_filter_edges(noisy, ["s"], "i", "x", 11, mode, "m").orderBy("i").collect()]
    assert got == pytest.approx(list(want))


def test_median_shrinking_edges(noisy):
    y = _noisy()
    want = np.array([np.median(y[max(0, i - 5) : i + 6]) for i in range(300)])
    for i in range(5):
        want[i], want[-(i + 1)] = np.median(y[: 2 * i + 3]), np.median(y[-(2 * i + 3) :])
    got = [r.m for r in W.median_filter_edges(noisy, ["s"], "i", "x", 11, "auto", "m").orderBy("i").collect()]
    assert got == pytest.approx(list(want))


def test_polynomial_smoothing_with_ends(noisy):
    y, want = _noisy(), np.empty(300)
    fit = lambda lo: np.polyval(np.polyfit(np.arange(11), y[lo : lo + 11], 3), np.arange(11))
    for i in range(5, 295):
        want[i] = fit(i - 5)[5]
    want[:5], want[-5:] = fit(0)[:5], fit(289)[-5:]
    got = [r.x_smooth for r in W.polynomial_smooth(noisy, ["s"], "i", ["x"]).orderBy("i").collect()]
    assert got == pytest.approx(list(want), abs=1e-8)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_moving_mean_of_short_series(spark, n):
    y = [float(v * v) for v in range(n)]
    w = min(5, n)
    full = np.convolve(y, np.ones(w) / w, mode="same")
    e = w // 2
    if n > 2 * e and e:
        full[:e], full[-e:] = y[:e], y[-e:]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "s string, i long, x double")
    got = [r.m for r in W.moving_mean_raw_edges(d, ["s"], "i", "x", "m").orderBy("i").collect()]
    assert got == pytest.approx(list(full[:n]))


def test_failed_frames_never_feed_others(spark):
    data = [(0, 0.0, "bad"), (1, 10.0, None), (2, 0.0, "bad"), (4, 0.0, "bad"), (5, 2.0, None), (7, 0.0, "bad"), (9, 0.0, "bad")]
    d = spark.createDataFrame([("a", *r) for r in data], "s string, f long, angle_degrees double, error string")
    out = {r.f: r for r in W.fill_failed_frames(d, ["s"], "f", ["angle_degrees"]).collect()}
    assert out[0].angle_degrees == pytest.approx(9.0) and out[2].angle_degrees == pytest.approx(8.0) and out[4].angle_degrees == pytest.approx(4.0)
    assert out[7].angle_degrees == pytest.approx(2 * 0.81) and out[9].angle_degrees == pytest.approx(2 * 0.9**4)
    assert out[2].error == "Interpolated between frames 1 and 5" and out[9].error == "Decayed from previous frame 5" and out[1].error is None


def test_first_per_key_and_stratified_split(spark):
    from kymora.operators.reshape import stratified_split

    d = spark.range(1000).select(F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("c"), F.col("id").alias("k"))
    out = stratified_split(d, "c", "k", 0.2, (F.col("k") * 2654435761) % 4294967296)
    got = {(r.c, r.split): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert got == {("big", "validation"): 160, ("big", "training"): 640, ("small", "validation"): 40, ("small", "training"): 160}


def test_sorted_index_of_one_stratum_and_of_equal_values(spark):
    """All rows in one group, all values equal: slices stay even, positions are those of one sort."""
    n = 40_000
    df = spark.range(n).select(F.lit("all").alias("g"), F.lit(0.5).alias("p"), ((F.col("id") * 7919) % n).alias("t"), F.lit(1).alias("same")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order in (["p", "t"], ["same"]):
            got = O.with_sorted_index(df, ["g"], order, "i", 1, "slice").cache()
            sizes = sorted(r["count"] for r in got.groupBy("slice").count().collect())
            assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
            assert sorted(r.i for r in got.select("i").collect()) == list(range(1, n + 1))
            assert order == ["same"] or got.filter("i <> t + 1").isEmpty()
        padj = W.adjusted_p(df, ["g"], "p", ["t"])
        assert padj.count() == n and padj.filter("padj <> 0.5").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sorted_index_over_groups_nulls_and_no_keys(spark, skewed):
    w = Window.partitionBy("s").orderBy("x", "id")
    out = O.with_sorted_index(skewed, ["s"], ["x", "id"], "i").withColumn("j", F.row_number().over(w) - 1)
    assert out.filter("i <> j").isEmpty() and out.count() == 1200 and out.columns == [*skewed.columns, "i", "j"]
    whole = O.with_sorted_index(skewed, [], ["x", "id"], "i", 1).withColumn("j", F.row_number().over(Window.orderBy("x", "id")))
    assert whole.filter("i <> j").isEmpty()
    assert O.with_sorted_index(skewed.limit(0), ["s"], ["x"], "i").collect() == []


def test_index_without_keys_over_ten_million_buckets(spark):
    """Every row a bucket of its own: offsets are summed in stretches."""
    n = 10_000_000
    df = spark.range(n, numPartitions=8).select((F.col("id") * 3).alias("t"))
    out = O.with_row_index(df, [], ["t"], F.col("t"), "i")
    assert out.agg(F.count(F.lit(1)), F.max(F.abs(F.col("i") * 3 - F.col("t")))).first()[:] == (n, 0)


def test_adjusted_p_equals_a_running_minimum(spark):
    rnd = np.random.default_rng(5)
    rows = [(g, i, None if i % 50 == 7 else float(v)) for g, n in (("a", 700), ("b", 3), (None, 40)) for i, v in enumerate(rnd.choice(np.linspace(0, 1, 60), n) ** 3)]
    got = {(r.g, r.t): r.padj for r in W.adjusted_p(spark.createDataFrame(rows, "g string, t long, p double"), ["g"], "p", ["t"]).collect()}
    for g in ("a", "b", None):
        ranked = sorted((p, t) for k, t, p in rows if k == g and p is not None)
        low = 1.0
        for rank in range(len(ranked), 0, -1):
            low = min(low, ranked[rank - 1][0] * len(ranked) / rank)
            assert got[g, ranked[rank - 1][1]] == pytest.approx(low)


def test_adjusted_p_reads_a_slice_once(spark):
    """No frame runs to the end of its slice (read again for every row): one slice of 200 000 rows takes seconds."""
    n = 200_000
    df = spark.range(n).select(F.lit("all").alias("g"), F.col("id").alias("t"), (F.col("id") / n).alias("p"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = W.adjusted_p(df, ["g"], "p", ["t"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "currentrow$(), unboundedfollowing$()" not in plan and "1, unboundedfollowing$()" not in plan
        assert out.filter(F.abs(F.col("padj") - F.col("t") / (F.col("t") + 1)) > 1e-9).isEmpty()
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")


def test_values_of_one_group_meet_their_brackets_in_several_parts(spark):
    df = spark.range(60_000).select(F.lit("all").alias("g"), (F.col("id") * 7 % 60_000).cast("double").alias("v"))
    q = O.exact_quantiles(df, ["g"], "v", {"q": 0.5})
    assert "__o_k" in q._jdf.queryExecution().analyzed().toString() and q.first().q == 29_999.5
