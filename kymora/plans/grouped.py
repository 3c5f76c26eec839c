"""Grouped statistics and scaling on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.functions import scalar as S
from kymora.operators import compare as J
from kymora.operators import normalize as N
from kymora.operators import stats as A
from kymora.plans import inputs as I
from kymora.plans.registry import query, rounded, table
from kymora.plans.tables import BIN30, BIN45, CATEGORY, KINDS

READ_SQL = """rd AS (SELECT user_id AS subject, event_id, event_type AS condition, 'v' || (user_id % 3) AS viscosity, value,
  (value * 7.0) % 240.0 - 120.0 AS angle, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
Q = "quantile_cont"


@query("a1_group_mean_max_min", "SELECT l_returnflag AS condition, l_linestatus AS viscosity, " + ", ".join(
    f"round(avg({c}), 4) AS {c}_mean, max({c}) AS {c}_max, min({c}) AS {c}_min" for c in ("l_quantity", "l_extendedprice")) + " FROM lineitem GROUP BY 1, 2")
def a1(spark, d):
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "condition", "l_linestatus": "viscosity"})
    return rounded(A.group_summary(li, ["condition", "viscosity"], ["l_quantity", "l_extendedprice"]), 4)


@query("a2_means_and_first", "SELECT user_id, round(avg(value), 6) AS value_mean, max(value) AS value_max, min(value) AS value_min, "
       "arg_min(CASE WHEN event_id % 5 <> 0 THEN event_type END, event_id) FILTER (event_id % 5 <> 0) AS shape FROM events GROUP BY 1")
def a2(spark, d):
    ev = table(spark, d, "events").withColumn("shape", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return rounded(A.group_summary(ev, ["user_id"], ["value"], ["shape"], "event_id"))


@query("a3_group_counts", "SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def a3(spark, d):
    ev = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return A.group_counts(ev, ["event_type", "user_id"])


@query("a4_category_shares", f"""WITH c AS (SELECT user_id AS strain, {CATEGORY} AS category FROM (SELECT user_id, (value * 7.0) % 240.0 - 120.0 AS a FROM events))
  SELECT strain, round(100.0 * count(*) FILTER (category = 'straight') / count(*), 6) AS straight, round(100.0 * count(*) FILTER (category = 'in odor') / count(*), 6) AS "in odor",
  round(100.0 * count(*) FILTER (category = 'in buffer') / count(*), 6) AS "in buffer" FROM c GROUP BY 1""")
def a4(spark, d):
    r = I.readings(spark, d).select(F.col("subject").alias("strain"), S.odor_category(F.col("angle")).alias("category"))
    return rounded(A.category_shares(r, "strain", "category", ["straight", "in odor", "in buffer"]))


SHAPE = "CASE event_type WHEN 'click' THEN 'C-shape' WHEN 'view' THEN 'S-shape' WHEN 'error' THEN 'Straight' ELSE 'Unknown' END"


@query("a5_shape_shares", f"""WITH s AS (SELECT user_id AS video_id, event_id, {SHAPE} AS shape, value < 8 AS t FROM events)
  SELECT video_id, round(100.0 * count(*) FILTER (t) / count(*), 6) AS z_axis_turn_percentage, """ + ", ".join(
    f"round(100.0 * count(*) FILTER (shape = '{l}' AND NOT t) / count(*), 6) AS {n}_percentage, round(coalesce(100.0 * count(*) FILTER (shape = '{l}' AND NOT t) / nullif(count(*) FILTER (NOT t), 0), 0), 6) AS {n}_percentage_excluding_z"
    for l, n in (("C-shape", "c_shape"), ("S-shape", "s_shape"), ("Straight", "straight"))) + ", arg_min(shape, event_id) AS first_shape FROM s GROUP BY 1")
def a5(spark, d):
    t = F.col("event_type")
    shape = F.when(t == "click", "C-shape").when(t == "view", "S-shape").when(t == "error", "Straight").otherwise("Unknown")
    ev = table(spark, d, "events").select(F.col("user_id").alias("video_id"), "event_id", shape.alias("shape"), shape.alias("first_shape"), (F.col("value") < 8).alias("turn"))
    return rounded(A.shape_shares(ev, "video_id", "shape", "turn", ["first_shape"], "event_id"))


@query("a6_label_share", "SELECT lang, round(100.0 * count(*) FILTER (q = 1) / count(*), 6) AS certified FROM (SELECT lang, (SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id) AS q FROM documents d) GROUP BY 1")
def a6(spark, d):
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    docs = table(spark, d, "documents").join(lab, "doc_id", "left").withColumn("certified", F.when(F.col("q") == 1, "Yes").when(F.col("q") == 0, "No"))
    return rounded(A.label_share(docs.select("lang", F.col("certified").alias("c")), ["lang"], "c", "Yes", "certified"))


@query("a7_median_of_averages", """WITH m AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus) AS v FROM orders)
  SELECT o_orderstatus, o_orderpriority, count(v) AS "count", round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 3) AS min, round(max(v), 3) AS max, round(quantile_cont(v, 0.5), 3) AS median FROM m GROUP BY 1, 2""")
def a7(spark, d):
    """Values first averaged per (customer, status), then summarised."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    m = N.group_mean(o, ["o_custkey", "o_orderstatus"], "o_totalprice", "v")
    return rounded(A.median_summary(m, ["o_orderstatus", "o_orderpriority"], "v"), 3)


def _compartments(spark, d):
    """Two measuring sources per compartment; rows missing in either drop out."""
    r = I.readings(spark, d)
    a = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    rows = F.array(
        F.struct(F.lit("loop").alias("compartment"), a.alias("a"), F.col("k").cast("double").alias("b")),
        F.struct(F.lit("nrd").alias("compartment"), F.col("angle").alias("a"), F.col("k").cast("double").alias("b")),
        F.struct(F.lit("nrv").alias("compartment"), a.alias("a"), F.col("angle").alias("b")),
    )
    long = r.select(F.col("subject").alias("video"), "event_id", F.explode(rows).alias("r")).select("video", "event_id", "r.*")
    return J.disagreement(long, ["video", "compartment"], "a", "b")


DIS_SQL = f"""WITH {READ_SQL}, v AS (SELECT subject AS video, event_id, 'loop' AS compartment, CASE WHEN event_id % 7 <> 0 THEN value END AS a, CAST(k AS DOUBLE) AS b FROM rd
    UNION ALL SELECT subject, event_id, 'nrd', angle, k FROM rd UNION ALL SELECT subject, event_id, 'nrv', CASE WHEN event_id % 7 <> 0 THEN value END, angle FROM rd),
  s AS (SELECT *, min(a) OVER w AS la, max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb FROM v WHERE a IS NOT NULL AND b IS NOT NULL WINDOW w AS (PARTITION BY video, compartment)),
  dis AS (SELECT video, compartment, event_id, abs(CASE WHEN la = ha THEN 0 ELSE (a - la) / (ha - la) END - CASE WHEN lb = hb THEN 0 ELSE (b - lb) / (hb - lb) END) * 100 AS disagreement FROM s)"""


@query("a17_disagreement", DIS_SQL + " SELECT video, compartment, event_id, round(disagreement, 6) AS disagreement FROM dis")
def a17(spark, d):
    return rounded(_compartments(spark, d).select("video", "compartment", "event_id", "disagreement"))


def _sum_sql(c):
    return f'count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.5), 6) AS median'


@query("a8_disagreement_summary", DIS_SQL + f" SELECT video, compartment, {_sum_sql('disagreement')} FROM dis GROUP BY GROUPING SETS ((video, compartment), (compartment))")
def a8(spark, d):
    return rounded(A.two_level_summary(_compartments(spark, d), "video", "compartment", "disagreement"))


@query("a10_frame_spread", f"""WITH {READ_SQL}, p AS (SELECT k AS frame, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM rd GROUP BY 1),
  t AS (SELECT max(m) - min(m) AS r, min(m) AS lo, arg_min(n, frame) AS n0 FROM p)
  SELECT frame, round(m, 6) AS mean, round(s, 6) AS std, round(s / r, 6) AS std_norm, round(1.96 * s / sqrt(n0) / r, 6) AS ci_norm, round((m - lo) / r, 6) AS mean_norm FROM p, t""")
def a10(spark, d):
    """Mean and sd per frame over annotators, scaled by the range of means."""
    return rounded(A.frame_spread(I.readings(spark, d).withColumnRenamed("k", "frame"), "frame", "value"))


T_SQL = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {A.student_t_975(i)!r})" for i in range(1, 61)) + ") v(df, q))"
_z = A.Z_975


@query("a11_mean_intervals", f"""WITH {T_SQL}, g AS (SELECT event_type AS condition, user_id AS minutes, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1, 2)
  SELECT condition, minutes, n, round(m, 6) AS mean, round(sd / sqrt(n), 6) AS sem, round(m - q * sd / sqrt(n), 6) AS ci_low, round(m + q * sd / sqrt(n), 6) AS ci_high, round(sd / m * 100, 6) AS cv FROM g LEFT JOIN t ON t.df = n - 1""")
def a11(spark, d):
    """Mean, standard error, t interval (A11) and coefficient of variation."""
    ev = table(spark, d, "events").select(F.col("event_type").alias("condition"), F.col("user_id").alias("minutes"), "value")
    return rounded(A.mean_intervals(ev, ["condition", "minutes"], "value"))


@query("a13_linear_trend", """WITH g AS (SELECT event_type AS condition, user_id AS minutes, avg(value) AS m FROM events GROUP BY 1, 2)
  SELECT condition, round(regr_slope(m, minutes), 6) AS slope, round(regr_intercept(m, minutes), 6) AS intercept, round(regr_r2(m, minutes), 6) AS r2 FROM g GROUP BY 1""")
def a13(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("condition"), F.col("user_id").alias("minutes"), "value")
    return rounded(A.linear_trend(A.mean_intervals(ev, ["condition", "minutes"], "value"), ["condition"], "minutes", "mean"))


@query("a14_describe", 'SELECT l_returnflag, count(l_extendedprice) AS "count", round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.25), 3) AS q25, round(quantile_cont(l_extendedprice, 0.5), 3) AS median, round(quantile_cont(l_extendedprice, 0.75), 3) AS q75 FROM lineitem GROUP BY 1')
def a14(spark, d):
    return rounded(A.describe(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"), 3)


@query("a15_absolute_difference_summary", f"""WITH {READ_SQL}, l AS (SELECT 'human_fiji' AS source, abs(value - k) AS x FROM rd UNION ALL SELECT 'human_sam', abs(value - angle) FROM rd),
  s AS (SELECT source, avg(x) AS mean, quantile_cont(x, 0.5) AS median, min(x) AS min, max(x) AS max, stddev_samp(x) AS std FROM l GROUP BY 1)
  SELECT source, metric, round(value, 6) AS value FROM s UNPIVOT (value FOR metric IN (mean, median, min, max, std))""")
def a15(spark, d):
    r = J.angle_differences(I.readings(spark, d), {"human_fiji": ("value", "k"), "human_sam": ("value", "angle")})
    return rounded(A.absolute_difference_summary(r, ["human_fiji", "human_sam"]))


@query("a16_binned_counts", f"""WITH l AS (SELECT 'human' AS source, value AS value FROM events UNION ALL SELECT 'fiji', value / 2 FROM events UNION ALL SELECT 'sam', (value * 7.0) % 240.0 - 20.0 FROM events),
  b AS (SELECT source, '4_bins' AS binning, {BIN45} AS bin FROM l UNION ALL SELECT source, '6_bins', {BIN30} FROM l),
  dim AS (SELECT source, '4_bins' AS binning, i AS bin FROM (VALUES ('human'), ('fiji'), ('sam')) s(source), range(1, 5) r(i) UNION ALL SELECT source, '6_bins', i FROM (VALUES ('human'), ('fiji'), ('sam')) s(source), range(1, 7) r(i))
  SELECT dim.source, dim.binning, dim.bin, count(b.bin) AS n FROM dim LEFT JOIN b ON b.source = dim.source AND b.binning = dim.binning AND b.bin = dim.bin GROUP BY 1, 2, 3""")
def a16(spark, d):
    r = table(spark, d, "events").select(F.col("value").alias("human"), (F.col("value") / 2).alias("fiji"), (F.col("value") * 7.0 % 240.0 - 20.0).alias("sam"))
    return A.binned_counts(r, ["human", "fiji", "sam"], {"4_bins": 4, "6_bins": 6}, S.angle_bin)


@query("a18_correlation_matrix", f"""WITH {READ_SQL}, m AS (SELECT value, angle, CASE WHEN event_id % 3 <> 0 THEN CAST(k AS DOUBLE) END AS k FROM rd),
  p AS (SELECT corr(value, angle) AS va, corr(value, k) AS vk, corr(angle, k) AS ak FROM m)
  SELECT a, b, round(r, 6) AS r FROM (SELECT 'value' AS a, 'angle' AS b, va AS r FROM p UNION ALL SELECT 'angle', 'value', va FROM p UNION ALL SELECT 'value', 'k', vk FROM p UNION ALL SELECT 'k', 'value', vk FROM p
   UNION ALL SELECT 'angle', 'k', ak FROM p UNION ALL SELECT 'k', 'angle', ak FROM p UNION ALL SELECT x, x, 1 FROM (VALUES ('value'), ('angle'), ('k')) d(x))""")
def a18(spark, d):
    r = I.readings(spark, d).withColumn("k", F.when(F.col("event_id") % 3 != 0, F.col("k").cast("double")))
    return rounded(A.correlation_matrix(r, [], ["value", "angle", "k"]))


@query("a19_missing_sources", "SELECT o_custkey AS worm, count(DISTINCT o_orderstatus) AS n_sources FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) <> 3")
def a19(spark, d):
    return J.sources_missing(table(spark, d, "orders").withColumnRenamed("o_custkey", "worm"), "worm", "o_orderstatus", 3)


@query("a41_size_filter", "SELECT vec_id, label::BIGINT AS img FROM (SELECT vec_id, label, v, avg(v) OVER (PARTITION BY label) AS m FROM (SELECT vec_id, label, list_sum([abs(CAST(x AS DOUBLE)) for x in embedding]) AS v FROM embeddings)) WHERE v > m * 1.02")
def a41(spark, d):
    area = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("img"), area.alias("area"))
    return rounded(A.size_filter(e, "img", "area", 1.02).select("vec_id", "img"))


@query("a43_histogram", """WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1),
  b AS (SELECT e.event_type, least(CAST(floor((value - lo) * 30 / (hi - lo)) AS BIGINT), 29) AS bin FROM events e JOIN s USING (event_type))
  SELECT s.event_type, i AS bin, round(lo + i * ((hi - lo) / 30), 6) AS "left", count(b.bin) AS n, round(count(b.bin) / (any_value(s.n) * ((any_value(hi) - any_value(lo)) / 30)), 6) AS density
  FROM s CROSS JOIN range(30) r(i) LEFT JOIN b ON b.event_type = s.event_type AND b.bin = i GROUP BY s.event_type, i, lo, hi""")
def a43(spark, d):
    return rounded(A.histogram(table(spark, d, "events"), ["event_type"], "value"))


@query("a44_box_summary", """WITH q AS (SELECT l_returnflag AS condition, l_linestatus AS viscosity, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM (SELECT *, l_extendedprice * (1 - l_discount) AS x FROM lineitem) GROUP BY 1, 2),
  j AS (SELECT q.*, l_extendedprice * (1 - l_discount) AS x FROM lineitem JOIN q ON l_returnflag = condition AND l_linestatus = viscosity)
  SELECT condition, viscosity, round(q1, 3) AS q1, round(median, 3) AS median, round(q3, 3) AS q3,
    round(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), 3) AS low, round(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), 3) AS high, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM j GROUP BY ALL""")
def a44(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("viscosity"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return rounded(A.box_summary(li, ["condition", "viscosity"], "x"), 3)


@query("a45_axis_range", "SELECT event_type, round(min(value) - 0.1 * (max(value) - min(value)), 6) AS low, round(max(value) + 0.1 * (max(value) - min(value)), 6) AS high FROM events GROUP BY 1")
def a45(spark, d):
    return rounded(A.padded_range(table(spark, d, "events"), ["event_type"], "value"))


# ---------------------------------------------------------------- scaling


def _holes(spark, d):
    """Readings with nulls, and one condition made constant."""
    r = I.readings(spark, d)
    x = F.when(F.col("event_id") % 9 == 0, None).when(F.col("subject") % 10 == 3, F.lit(4.0)).otherwise(F.col("angle"))
    return r.select("event_id", "subject", "condition", "viscosity", x.alias("x"))


HOLES = f"""WITH {READ_SQL}, h AS (SELECT event_id, subject, condition, viscosity, CASE WHEN event_id % 9 = 0 THEN NULL WHEN subject % 10 = 3 THEN 4.0 ELSE angle END AS x FROM rd),
  w AS (SELECT *, min(x) OVER g AS lo, max(x) OVER g AS hi, min(x) OVER () AS glo, max(x) OVER () AS ghi, avg(x) OVER g AS m, stddev_samp(x) OVER g AS sd FROM h WINDOW g AS (PARTITION BY subject))"""

for _name, _fn, _sql in (
    ("n1_unit_range", lambda h: N.unit_range(h, ["subject"], "x", "y"), "CASE WHEN lo = hi THEN 0 ELSE (x - lo) / (hi - lo) END"),
    ("n2_signed_range", lambda h: N.signed_range(h, ["subject"], "x", "y"), "CASE WHEN lo = hi THEN 0 ELSE (x - lo) / (hi - lo) * 2 - 1 END"),
    ("n3_overall_range", lambda h: N.overall_range(h, "x", "y"), "CASE WHEN glo = ghi THEN 0 ELSE (x - glo) / (ghi - glo) END"),
    ("n4_centred_unit_range", lambda h: N.centred_unit_range(h, ["subject"], "x", "y"), "CASE WHEN x IS NOT NULL THEN CASE WHEN lo = hi THEN 0.5 ELSE (x - lo) / (hi - lo) END END"),
    ("n5_plain_range", lambda h: N.plain_range(h, ["subject"], "x", "y"), "CASE WHEN lo <> hi THEN (x - lo) / (hi - lo) END"),
    ("n6_share_of_max", lambda h: N.share_of_max(h, ["subject"], "x", "y"), "x / hi"),
    ("n7_baseline_change", lambda h: N.relative_to_baseline(h, "x", (F.col("condition") == "click") & (F.col("viscosity") == "v0"), "y"), "(x - (SELECT avg(x) FROM h WHERE condition = 'click' AND viscosity = 'v0')) / (SELECT avg(x) FROM h WHERE condition = 'click' AND viscosity = 'v0')"),
    ("n8_group_z_score", lambda h: N.z_score(h, ["subject"], "x", "y"), "CASE WHEN lo <> hi THEN (x - m) / sd END"),
    ("n9_overall_z_score", lambda h: N.z_score(h, [], "x", "y", True), "(x - (SELECT avg(x) FROM h)) / (SELECT stddev_pop(x) FROM h)"),
    ("n10_group_mean", lambda h: N.group_mean(h, ["subject"], "x", "y"), "m"),
):
    query(_name, f"{HOLES} SELECT event_id, round(CAST({_sql} AS DOUBLE), 6) AS y FROM w")(
        lambda spark, d, f=_fn: rounded(f(_holes(spark, d)).select("event_id", "y"))
    )


@query("n11_low_outliers", HOLES.replace("PARTITION BY subject)", "PARTITION BY viscosity, condition, subject)") + " SELECT event_id, coalesce(x < m - sd, false) AS turn, viscosity || '_' || condition || '_' || subject AS video_id FROM w")
def n11(spark, d):
    out = N.low_outliers(_holes(spark, d), ["viscosity", "condition", "subject"], "x", "turn", "video_id")
    return out.select("event_id", "turn", "video_id")
