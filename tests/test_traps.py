"""Cases where the source tools and Spark differ: nulls, constants, bins, edges, names."""

import math

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kymora.functions import scalar as S
from kymora.operators import clean as C
from kymora.operators import compare as J
from kymora.operators import normalize as N
from kymora.operators import stats as A
from kymora.operators.ordered import exact_quantiles, null_safe_join


def test_scaling_of_constant_null_and_single_groups(spark):
    df = spark.createDataFrame([("c", 1, 5.0), ("c", 2, 5.0), ("c", 3, None), ("n", 1, None), ("one", 1, 2.0), ("v", 1, 0.0), ("v", 2, 4.0), ("v", 3, 1.0)], "g string, i int, x double")
    by = lambda f: {(r.g, r.i): r.y for r in f(df, ["g"], "x", "y").collect()}
    u, s, c, p = by(N.unit_range), by(N.signed_range), by(N.centred_unit_range), by(N.plain_range)
    assert u["c", 1] == 0 and u["c", 3] == 0 and u["n", 1] == 0 and u["v", 3] == 0.25
    assert s["c", 2] == 0 and s["v", 1] == -1 and s["v", 3] == -0.5
    assert c["c", 1] == 0.5 and c["c", 3] is None and c["one", 1] == 0.5
    assert p["c", 1] is None and p["one", 1] is None and p["v", 2] == 1


def test_sample_and_population_sd(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [round(r.z, 6) for r in N.z_score(df, [], "x", "z").orderBy("x").collect()] == [-0.707107, 0.707107]
    assert [r.z for r in N.z_score(df, [], "x", "z", population=True).orderBy("x").collect()] == [-1.0, 1.0]


def test_bins_are_right_closed(spark):
    xs = [0.0, 45.0, 45.01, 90.0, 180.0, -1.0, 181.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    assert [r.b for r in df.select("i", S.angle_bin(F.col("x"), 45.0).alias("b")).orderBy("i").collect()] == [1, 1, 2, 2, 4, None, None, None]


def test_empty_bins_count_zero(spark):
    df = spark.createDataFrame([(10.0, None), (20.0, 170.0)], "a double, b double")
    out = {(r.source, r.binning, r.bin): r.n for r in A.binned_counts(df, ["a", "b"], {"4_bins": 4}, S.angle_bin).collect()}
    assert len(out) == 8 and out["a", "4_bins", 1] == 2 and out["a", "4_bins", 2] == 0 and out["b", "4_bins", 4] == 1


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert rows(null_safe_join(a, b, ["k"])) == [("x", 2, None), (None, 1, 10)]
    assert rows(null_safe_join(a, b, ["k"], "left_anti")) == [("x", 2)]
    assert rows(J.suffix_join(a, b, ["k"], ("_l", "_r"))) == [("x", 2, None), ("y", None, 20), (None, 1, 10)]


def test_group_counts_drop_null_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(A.group_counts(df, ["k"])) == [("a", 2)]
    assert A.distinct_values(df, "k").first().n == 2


ANGLES = [(77.3, -94.3), (75.6, -98.3), (67.8, -107.4), (60.1, -116.7), (-114.0, 47.5), (70.0, -120.0)]


def test_impossible_switches(spark):
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(ANGLES)], "i int, p double, c double")
    out = df.select("i", S.forced_switch(F.col("p"), F.col("c")).alias("s"), (F.abs(F.col("c") - F.col("p")) > 150).alias("e")).orderBy("i").collect()
    assert all(r.s for r in out)
    assert [r.e for r in out] == [abs(c - p) > 150 for p, c in ANGLES]


def test_bent_scaling(spark):
    cases = [(45.0, True, 90.0), (30.0, True, 75.0), (15.0, True, 37.5), (75.0, True, 75.0), (-35.0, True, -87.5), (45.0, False, 45.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a double, b boolean")
    got = [r.y for r in df.select("i", S.bent_scaled(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()]
    assert got == pytest.approx([c[2] for c in cases])


def test_alternative_angles(spark):
    def expect(a):
        b = a * 1.6
        if abs(b) <= 20:
            return b
        s = 1.4 if abs(b) > 80 else 1.6 if abs(b) > 60 else 1.8 if abs(b) > 40 else 2.0
        return max(-175.0, min(175.0, b * s))

    xs = [45.0, 62.0, 75.0, 85.0, 95.0, -70.0, -85.0, 3.2, 12.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, a double")
    got = [r.y for r in df.select("i", S.bent_alternative(F.col("a"), F.lit(True)).alias("y")).orderBy("i").collect()]
    assert got == pytest.approx([expect(x) for x in xs])


def test_volcano_distance_of_zero_p(spark):
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 1e-4), (None, 0.5)], "l double, p double")
    got = [r.d for r in df.select(S.volcano_distance(F.col("l"), F.col("p")).alias("d")).collect()]
    assert math.isinf(got[0]) and got[1] == pytest.approx(5.0) and got[2] is None


def test_names_and_literals(spark):
    df = spark.createDataFrame([("AG_WT-MMG9_10s_20190305_01_crop_x.csv", "b'C-shape'", "[0.1  0.2\n 3]")], "n string, b string, a string")
    r = df.select(S.clean_subject_name(F.col("n")).alias("n"), S.decode_bytes_literal(F.col("b")).alias("b"), S.parse_array_literal(F.col("a")).alias("a")).first()
    assert r.n == "MMH9_10s_20190305_01" and r.b == "C-shape" and r.a == [0.1, 0.2, 3.0]


def test_first_row_fill_keeps_null_of_first_row(spark):
    df = spark.createDataFrame([("f", 1, "w"), ("f", 2, None), ("g", 1, None), ("g", 2, "z"), ("g", 3, None)], "f string, i int, w string")
    assert rows(C.fill_from_first_row(df, "f", "i", ["w"])) == [("f", 1, "w"), ("f", 2, "w"), ("g", 1, None), ("g", 2, "z"), ("g", 3, None)]


def test_t_quantiles_match_published_values():
    table = {1: 12.706205, 2: 4.302653, 5: 2.570582, 10: 2.228139, 30: 2.042272, 60: 2.000298}
    for df, q in table.items():
        assert A.student_t_975(df) == pytest.approx(q, abs=1e-6)


def test_t_quantile_expansion_joins_table(spark):
    got = spark.range(59, 63).select("id", A.t_quantile(F.col("id")).alias("q")).orderBy("id").collect()
    assert [r.q for r in got] == pytest.approx([2.000995, 2.000298, 1.999624, 1.998972], abs=2e-6)
    assert spark.range(1).select(A.t_quantile(F.lit(0)).alias("q")).first().q is None


PROBS = {"least": 0.0, "low": 0.0004, "q1": 0.25, "m": 0.5, "p": 0.9, "high": 0.9997, "most": 1.0}


def test_quantiles_of_repeated_and_skewed_values(spark):
    import numpy as np

    data = [("a", 1.0)] * 50 + [("a", 1e9), ("a", 2.0)] + [("b", float(i * i)) for i in range(37)] + [("c", None), ("d", 7.0), (None, -0.0), (None, 3.0), ("a", float("nan"))]
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(data, "k string, x double"), ["k"], "x", PROBS).collect()}
    for k in ("a", "b", "d", None):
        v = [x for g, x in data if g == k and x is not None and x == x]
        assert list(got[k][1:]) == pytest.approx(list(np.percentile(v, [100 * p for p in PROBS.values()])))
    assert set(got) == {"a", "b", "d", None}


@pytest.mark.parametrize("n", [19_999, 20_000, 20_001, 27_777, 300_000])
def test_quantiles_around_and_above_the_size_of_summaries(spark, n):
    """Even, heavy-tailed, far-off and repeated values, rising and falling, in groups that need brackets."""
    import numpy as np

    rng = np.random.default_rng(n)
    kinds = {"normal": rng.normal(0, 1, n), "tail": rng.pareto(0.3, n), "far": np.append(rng.normal(0, 1, n - 2), [1e300, -1e300]), "few": rng.integers(0, 4, n) * 1.0, "up": np.arange(n) * 1.0, "down": -np.arange(n) * 1.0}
    kinds["hot"] = np.where(rng.random(n) < 0.6, 5.0, rng.normal(5, 1e-9, n))
    rows = pd.DataFrame({"k": np.repeat(list(kinds), n), "x": np.concatenate(list(kinds.values()))})
    df = spark.createDataFrame(rows).repartition(7)
    got = {r.k: list(r[1:]) for r in exact_quantiles(df, ["k"], "x", PROBS).collect()}
    for k, v in kinds.items():
        assert got[k] == pytest.approx(list(np.quantile(v, list(PROBS.values()))), rel=1e-12, abs=1e-12)
    assert list(exact_quantiles(df.filter("k = 'tail'"), [], "x", {"m": 0.5}).first()) == [pytest.approx(np.median(kinds["tail"]))]


def test_quantiles_need_no_job_before_the_action(spark):
    spark.sparkContext.setJobGroup("built", "built")
    exact_quantiles(spark.range(100).selectExpr("id % 3 AS k", "id * 1.0 AS x"), ["k"], "x", PROBS)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_t_quantile_where_table_and_expansion_meet(spark):
    from kymora.operators.stats import student_t_975, t_quantile

    df = spark.range(58, 70)
    for r in df.select("id", t_quantile(F.col("id")).alias("t")).collect():
        assert abs(r.t - student_t_975(r.id)) < 1e-8


def test_pixel_columns_out_of_range_are_an_error(spark):
    from kymora.functions.scalar import pixel_code

    df = spark.createDataFrame([(2, 3), (0, (1 << 20) - 1), (None, 1), (1, None)], "y int, x int")
    assert [r.c for r in df.select(pixel_code(F.col("y"), F.col("x")).alias("c")).collect()] == [(2 << 20) + 3, (1 << 20) - 1, None, None]
    for x in (-1, 1 << 20):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(0, x)], "y int, x int").select(pixel_code(F.col("y"), F.col("x"))).collect()


def test_box_suppression_over_several_places(spark):
    """Chains that cross places wait for boxes elsewhere, so a second round follows."""
    rows = [(k, float(1000 - k), 0.0, 4.0 * k, 40.0, 4.0 * k + 40) for k in range(400)]
    boxes = spark.createDataFrame(rows, "box long, score double, x0 double, y0 double, x1 double, y1 double").withColumn("image", F.lit(1))
    from kymora.operators.greedy import box_nms

    kept = []
    for k, *_ in rows:
        if all((40 - 4 * (k - j)) / (40 + 4 * (k - j)) <= 0.7 for j in kept if k - j < 10):
            kept.append(k)
    # places in tasks of their own, as in large tables
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(r.box for r in box_nms(boxes, ["image"], "box", "score", 0.7, 1).collect()) == kept
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
