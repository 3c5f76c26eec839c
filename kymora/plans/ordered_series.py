"""Ordered-series operators on the readings of each subject."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.operators import ordered as O
from kymora.operators import series as W
from kymora.plans import inputs as I
from kymora.plans.registry import query, rounded

KEY = ["subject"]
SER = f"WITH {I.SERIES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM series)"
WIN = "(PARTITION BY subject ORDER BY frame ROWS BETWEEN {} AND {})"


@query("w1_moving_mean", f"{SER} SELECT subject, frame, round(avg(angle) OVER {WIN.format('1 PRECEDING', '1 FOLLOWING')}, 6) AS smooth FROM n")
def w1(spark, d):
    return rounded(W.moving_mean(I.series(spark, d), KEY, "frame", "angle", 3, "smooth").select("subject", "frame", "smooth"))


@query("w2_moving_mean_raw_edges", f"{SER} SELECT subject, frame, round(CASE WHEN frame < 2 OR frame >= n - 2 THEN angle ELSE avg(angle) OVER {WIN.format('2 PRECEDING', '2 FOLLOWING')} END, 6) AS smooth FROM n")
def w2(spark, d):
    return rounded(W.moving_mean_raw_edges(I.series(spark, d), KEY, "frame", "angle", "smooth").select("subject", "frame", "smooth"))


def _padded(index_expr):
    """Median over 11 padded positions, looked up by position."""
    return (
        f"{SER}, p AS (SELECT a.subject, a.frame, {index_expr} AS at FROM n a, range(-5, 6) r(o)) "
        "SELECT p.subject, p.frame, round(quantile_cont(b.angle, 0.5), 6) AS smooth FROM p JOIN series b ON b.subject = p.subject AND b.frame = p.at GROUP BY 1, 2"
    )


@query("w3_median_mirror", _padded("CASE WHEN a.frame + o < 0 THEN -(a.frame + o) WHEN a.frame + o >= n THEN 2 * (n - 1) - (a.frame + o) ELSE a.frame + o END"))
def w3m(spark, d):
    return rounded(W.median_filter_edges(I.series(spark, d), KEY, "frame", "angle", 11, "mirror", "smooth").select("subject", "frame", "smooth"))


@query("w3_median_nearest", _padded("greatest(0, least(n - 1, a.frame + o))"))
def w3n(spark, d):
    return rounded(W.median_filter_edges(I.series(spark, d), KEY, "frame", "angle", 11, "nearest", "smooth").select("subject", "frame", "smooth"))


@query("w3_median_auto", f"""{SER} SELECT a.subject, a.frame, round(quantile_cont(b.angle, 0.5), 6) AS smooth FROM n a JOIN series b ON b.subject = a.subject AND
  CASE WHEN a.frame < 5 THEN b.frame < 2 * a.frame + 3 WHEN a.n - 1 - a.frame < 5 THEN b.frame > a.n - 1 - (2 * (a.n - 1 - a.frame) + 3) ELSE abs(b.frame - a.frame) <= 5 END GROUP BY 1, 2""")
def w3a(spark, d):
    return rounded(W.median_filter_edges(I.series(spark, d), KEY, "frame", "angle", 11, "auto", "smooth").select("subject", "frame", "smooth"))


@query("w4_median_zero_edges", f"""{SER} SELECT a.subject, a.frame, round(quantile_cont(coalesce(b.angle, 0), 0.5), 6) AS smooth FROM (SELECT * FROM n, range(-2, 3) r(o)) a LEFT JOIN series b ON b.subject = a.subject AND b.frame = a.frame + o GROUP BY 1, 2""")
def w4(spark, d):
    return rounded(W.median_filter_zero(I.series(spark, d), KEY, "frame", "angle", 5, "smooth").select("subject", "frame", "smooth"))


# The 11-point cubic smoothing weights, as published.
SG = "[-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]"


@query("w5_polynomial_smooth_inner", f"{SER}, s AS (SELECT a.subject, a.frame, sum(b.angle * {SG}[b.frame - a.frame + 6]) / 429 AS y FROM n a JOIN series b ON b.subject = a.subject AND abs(b.frame - a.frame) <= 5 WHERE a.frame >= 5 AND a.frame < a.n - 5 GROUP BY 1, 2) SELECT n.subject, n.frame, round(y, 6) AS angle_smooth FROM n LEFT JOIN s USING (subject, frame)")
def w5(spark, d):
    """All rows, with the values of inner points, which the published weights give."""
    out = W.with_size(W.polynomial_smooth(I.series(spark, d), KEY, "frame", ["angle"]), KEY)
    inner = (F.col("frame") >= 5) & (F.col("frame") < F.col(W.SIZE) - 5)
    return rounded(out.select("subject", "frame", F.when(inner, F.col("angle_smooth")).alias("angle_smooth")))


GRAM = """poly AS (SELECT t::DOUBLE AS t, 1.0 AS p0, t::DOUBLE AS p1, t * t - 10.0 AS p2, t * t * t - 17.8 * t AS p3 FROM range(-5, 6) r(t)),
  hat AS (SELECT a.t, b.t AS s, a.p0 * b.p0 / n0 + a.p1 * b.p1 / n1 + a.p2 * b.p2 / n2 + a.p3 * b.p3 / n3 AS w
    FROM poly a, poly b, (SELECT sum(p0 * p0) AS n0, sum(p1 * p1) AS n1, sum(p2 * p2) AS n2, sum(p3 * p3) AS n3 FROM poly) z)"""


FIT = f"""{SER}, {GRAM}, c AS (SELECT subject, frame, n, greatest(5, least(frame, n - 6)) AS mid FROM n),
  fit AS (SELECT c.subject, c.frame, sum(w * b.angle) AS y FROM c JOIN series b ON b.subject = c.subject AND abs(b.frame - c.mid) <= 5
    JOIN hat ON hat.t = c.frame - c.mid AND hat.s = b.frame - c.mid WHERE n >= 11 GROUP BY 1, 2)"""


@query("w5_polynomial_smooth_ends", f"{FIT} SELECT n.subject, n.frame, round(CASE WHEN n.frame < 5 OR n.frame >= n.n - 5 THEN y END, 6) AS angle_smooth FROM n LEFT JOIN fit USING (subject, frame)")
def w5b(spark, d):
    """All rows, with the values of the five points at each end, from the fit of the end window."""
    out = W.with_size(W.polynomial_smooth(I.series(spark, d), KEY, "frame", ["angle"]), KEY)
    end = (F.col("frame") < 5) | (F.col("frame") >= F.col(W.SIZE) - 5)
    return rounded(out.select("subject", "frame", F.when(end, F.col("angle_smooth")).alias("angle_smooth")))


@query("w5_polynomial_smooth", f"{FIT} SELECT n.subject, n.frame, round(y, 6) AS angle_smooth FROM n LEFT JOIN fit USING (subject, frame)")
def w5c(spark, d):
    """Inner points and ends; series shorter than a window have null values."""
    return rounded(W.polynomial_smooth(I.series(spark, d), KEY, "frame", ["angle"]).select("subject", "frame", "angle_smooth"))


@query("w6_gradient", f"""{SER}, g AS (SELECT subject, frame, angle, lag(angle) OVER w AS p, lead(angle) OVER w AS q FROM n WINDOW w AS (PARTITION BY subject ORDER BY frame))
  SELECT subject, frame, round(10 * CASE WHEN p IS NULL THEN q - angle WHEN q IS NULL THEN angle - p ELSE (q - p) / 2 END, 6) AS velocity FROM g""")
def w6(spark, d):
    return rounded(W.gradient(I.series(spark, d), KEY, "frame", ["angle"], 10.0, ["velocity"]).select("subject", "frame", "velocity"))


NOISE = """g AS (SELECT *, avg(v) OVER b AS mb, stddev_pop(v) OVER b AS sb, avg(v) OVER a AS ma, stddev_pop(v) OVER a AS sa FROM (SELECT *, value / 3 AS v FROM n)
    WINDOW b AS (PARTITION BY subject ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY subject ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
  h AS (SELECT *, CASE WHEN frame = 0 THEN CASE WHEN n > 3 AND abs(v - ma) > 15 AND sa < 10 THEN ma END WHEN frame = n - 1 THEN CASE WHEN abs(v - mb) > 15 AND sb < 10 THEN mb END
     WHEN abs(v - mb) > 15 AND abs(v - ma) > 15 AND sb < 10 AND sa < 10 THEN (mb / (sb + 1e-6) + ma / (sa + 1e-6)) / (1 / (sb + 1e-6) + 1 / (sa + 1e-6)) END AS x FROM g)"""


@query("w11_noise_peaks", f"""{SER}, {NOISE} SELECT subject, frame, round(coalesce(x, v), 5) AS v, round(v, 5) AS original_angle, x IS NOT NULL AS is_noise_peak, round(CASE WHEN x IS NULL THEN 0.0 ELSE abs(v - x) END, 5) AS peak_deviation,
  CAST(CASE WHEN x IS NULL THEN 0 WHEN frame < 3 THEN frame WHEN frame >= n - 3 THEN n - frame - 1 ELSE 3 END AS BIGINT) AS window_size_used FROM h""")
def w11(spark, d):
    """Noise-peak removal (W10) with its audit columns."""
    s = I.series(spark, d).select("subject", "frame", (F.col("value") / 3).alias("v"))
    return rounded(W.remove_noise_peaks(s, KEY, "frame", "v"), 5)


FAIL = "value < 12"


@query("w12_fill_failed_frames", f"""{SER}, e AS (SELECT subject, frame, CASE WHEN {FAIL} THEN 0 ELSE angle END AS a, CASE WHEN {FAIL} THEN 0.0 ELSE value / 170 END AS b, {FAIL} AS bad FROM (SELECT * REPLACE (frame + frame // 4 AS frame) FROM n) x),
  g AS (SELECT *, last_value(CASE WHEN NOT bad THEN {{'f': frame, 'a': a, 'b': b}} END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    first_value(CASE WHEN NOT bad THEN {{'f': frame, 'a': a, 'b': b}} END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM e),
  x AS (SELECT *, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN p.a * (1 - (frame - p.f) / (q.f - p.f)) + q.a * (frame - p.f) / (q.f - p.f) WHEN p IS NOT NULL THEN p.a * 0.9 ** (frame - p.f) WHEN q IS NOT NULL THEN q.a * 0.9 ** (q.f - frame) ELSE 0 END AS na,
    CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN p.b * (1 - (frame - p.f) / (q.f - p.f)) + q.b * (frame - p.f) / (q.f - p.f) WHEN p IS NOT NULL THEN p.b * 0.9 ** (frame - p.f) WHEN q IS NOT NULL THEN q.b * 0.9 ** (q.f - frame) ELSE 0 END AS nb FROM g)
  SELECT subject, frame, round(CASE WHEN bad THEN na ELSE a END, 6) AS angle_degrees, round(CASE WHEN bad THEN CASE WHEN abs(na) <= 3 THEN 0 ELSE nb END ELSE b END, 6) AS bend_location,
    CASE WHEN NOT bad THEN NULL WHEN p IS NOT NULL AND q IS NOT NULL THEN 'Interpolated between frames ' || p.f || ' and ' || q.f WHEN p IS NOT NULL THEN 'Decayed from previous frame ' || p.f WHEN q IS NOT NULL THEN 'Decayed from next frame ' || q.f ELSE 'No valid frames available for interpolation' END AS error FROM x""")
def w12(spark, d):
    bad = F.col("value") < 12
    s = I.series(spark, d).select(
        "subject", (F.col("frame") + F.floor(F.col("frame") / 4)).alias("frame"), F.when(bad, 0.0).otherwise(F.col("angle")).alias("angle_degrees"),
        F.when(bad, 0.0).otherwise(F.col("value") / 170).alias("bend_location"), F.when(bad, F.lit("Empty skeleton")).alias("error"),
    )
    return rounded(W.fill_failed_frames(s, KEY, "frame", ["angle_degrees", "bend_location"]))


RUN = """g AS (SELECT *, last_value(CASE WHEN NOT m THEN {{'i': frame, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    first_value(CASE WHEN NOT m THEN {{'i': frame, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM {src})
  SELECT subject, frame, round(CASE WHEN NOT m THEN v WHEN p IS NOT NULL AND q IS NOT NULL THEN p.v + (q.v - p.v) * (frame - p.i) / (q.i - p.i) WHEN p IS NOT NULL THEN p.v WHEN q IS NOT NULL THEN q.v ELSE v END, 6) AS bend_location FROM g"""


@query("w13_interpolate_straight_runs", f"{SER}, s AS (SELECT subject, frame, value AS v, abs(angle) <= 40 AS m FROM n), " + RUN.format(src="s"))
def w13(spark, d):
    s = I.series(spark, d).select("subject", "frame", F.col("value").alias("bend_location"), "angle")
    return rounded(W.interpolate_runs(s, KEY, "frame", F.abs("angle") <= 40, "bend_location").drop("angle"))


@query("w13_interpolate_bends", f"{SER}, s AS (SELECT subject, frame, CASE WHEN abs(angle) <= 40 THEN 0 ELSE value END AS v, abs(angle) > 40 AS m FROM n), " + RUN.format(src="s"))
def w13b(spark, d):
    s = I.series(spark, d).select("subject", "frame", F.col("value").alias("bend_location"), F.col("angle").alias("angle_degrees"))
    return rounded(W.interpolate_bends(s, KEY, "frame", 40.0).drop("angle_degrees"))


@query("w15_last_known_center", f"{SER} SELECT subject, frame, coalesce(last_value(CASE WHEN value > 60 THEN k END IGNORE NULLS) OVER {WIN.format('UNBOUNDED PRECEDING', 'CURRENT ROW')}, 50) AS center FROM n")
def w15(spark, d):
    s = I.series(spark, d)
    out = W.last_known(s, KEY, "frame", F.when(F.col("value") > 60, F.col("k")), F.lit(50), "center")
    return out.select("subject", "frame", "center")


@query("w17_interpolate_transforms", f"""{SER}, s AS (SELECT subject, frame, value > 15 AS ok, [angle, value] AS v FROM n),
  g AS (SELECT *, last_value(CASE WHEN ok THEN {{'i': frame, 'v': v}} END IGNORE NULLS) OVER {WIN.format('UNBOUNDED PRECEDING', '1 PRECEDING')} AS p, first_value(CASE WHEN ok THEN {{'i': frame, 'v': v}} END IGNORE NULLS) OVER {WIN.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS q FROM s),
  x AS (SELECT subject, frame, CASE WHEN ok THEN v WHEN p IS NOT NULL AND q IS NOT NULL THEN [p.v[1] + (q.v[1] - p.v[1]) * (frame - p.i) / (q.i - p.i), p.v[2] + (q.v[2] - p.v[2]) * (frame - p.i) / (q.i - p.i)] WHEN p IS NOT NULL THEN p.v WHEN q IS NOT NULL THEN q.v ELSE [1.0, 0.0] END AS m FROM g)
  SELECT subject, frame, round(m[1], 6) AS a, round(m[2], 6) AS b FROM x""")
def w17(spark, d):
    s = I.series(spark, d).select("subject", "frame", (F.col("value") > 15).alias("ok"), F.array("angle", "value").alias("m"))
    out = W.interpolate_arrays(s, KEY, "frame", F.col("ok"), "m", [1.0, 0.0])
    return rounded(out.select("subject", "frame", F.get("m", F.lit(0)).alias("a"), F.get("m", F.lit(1)).alias("b")))


@query("w18_correct_uncertain", f"{SER} SELECT subject, frame, round(CASE WHEN k / 100.0 < 0.7 THEN quantile_cont(angle, 0.5) OVER {WIN.format('5 PRECEDING', '5 FOLLOWING')} ELSE angle END, 6) AS angle FROM n")
def w18(spark, d):
    s = I.series(spark, d).select("subject", "frame", "angle", (F.col("k") / 100.0).alias("confidence"))
    return rounded(W.correct_uncertain(s, KEY, "frame", ["angle"], "confidence").drop("confidence"))


@query("w22_autocorrelation", f"""{SER}, d AS (SELECT subject, frame, n, angle - avg(angle) OVER (PARTITION BY subject) AS x FROM n)
  SELECT a.subject, a.frame - b.frame AS lag, round(sum(a.x * b.x) / (SELECT sum(x * x) FROM d z WHERE z.subject = a.subject), 6) AS r FROM d a JOIN d b ON a.subject = b.subject AND a.frame - b.frame BETWEEN 0 AND 50 GROUP BY 1, 2""")
def w22(spark, d):
    return rounded(W.autocorrelation(I.series(spark, d), KEY, "frame", "angle", 50))


@query("w22_lag_one_correlation", f"{SER} SELECT a.subject, round(corr(a.angle, b.angle), 6) AS r FROM n a JOIN n b ON a.subject = b.subject AND a.frame = b.frame + 1 GROUP BY 1")
def w22b(spark, d):
    return rounded(W.lag_one_correlation(I.series(spark, d), KEY, "frame", "angle"))


@query("w23_adjusted_p", f"""WITH {I.DE_SQL}, r AS (SELECT *, comparison_condition || reference_condition AS pair, row_number() OVER w AS rk, count(*) OVER (PARTITION BY comparison_condition, reference_condition) AS n FROM de WINDOW w AS (PARTITION BY comparison_condition, reference_condition ORDER BY pvalue, gene))
  SELECT gene, pair, round(least(1.0, min(pvalue * n / rk) OVER (PARTITION BY pair ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj FROM r""")
def w23(spark, d):
    de = I.gene_results(spark, d).withColumn("pair", F.concat("comparison_condition", "reference_condition"))
    return rounded(W.adjusted_p(de, ["pair"], "pvalue", ["gene"]).select("gene", "pair", "padj"))


@query("w8_runs", f"""{SER}, c AS (SELECT subject, frame, angle > 0 AS s, CASE WHEN lag(angle > 0) OVER (PARTITION BY subject ORDER BY frame) IS NOT DISTINCT FROM (angle > 0) THEN 0 ELSE 1 END AS ch FROM n)
  SELECT subject, frame, CAST(sum(ch) OVER {WIN.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS BIGINT) AS run_id FROM c""")
def w8(spark, d):
    return O.run_ids(I.series(spark, d).select("subject", "frame", "angle"), KEY, "frame", F.col("angle") > 0).select("subject", "frame", "run_id")
