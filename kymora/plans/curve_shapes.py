"""Curve, signal and motion operators on curves and series from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.functions import curves as C
from kymora.operators import masks as M
from kymora.operators import motion as MO
from kymora.operators import normalize as N
from kymora.operators import shape as SH
from kymora.operators import signal as G
from kymora.plans import inputs as I
from kymora.plans.ordered_series import GRAM, KEY, SER
from kymora.plans.pixels import SPARSE_SQL, WITH, sparse, sparse_index
from kymora.plans.registry import query, rounded, table

VF = "video_id, frame"
PTS = f"""{I.CURVE_POINTS_SQL},
  st AS (SELECT *, coalesce(sqrt((y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2), 0) AS d FROM curve_points WINDOW w AS (PARTITION BY {VF} ORDER BY pos)),
  cm AS (SELECT *, sum(d) OVER (PARTITION BY {VF} ORDER BY pos) AS cum, sum(d) OVER (PARTITION BY {VF}) AS len FROM st),
  nx AS (SELECT *, lead(cum) OVER w AS ncum, lead(y) OVER w AS ny, lead(x) OVER w AS nx FROM cm WINDOW w AS (PARTITION BY {VF} ORDER BY pos)),
  rs AS (SELECT video_id, frame, k, len, CASE WHEN ncum IS NULL THEN y ELSE y + (ny - y) * (t - cum) / (ncum - cum) END AS y, CASE WHEN ncum IS NULL THEN x ELSE x + (nx - x) * (t - cum) / (ncum - cum) END AS x
    FROM (SELECT *, CASE WHEN k = 99 THEN (SELECT max(cum) FROM cm c2 WHERE c2.video_id = nx.video_id AND c2.frame = nx.frame) ELSE len * k / 99.0 END AS t FROM nx, range(100) r(k)) WHERE cum <= t AND (ncum IS NULL OR t < ncum))"""


def _res(spark, d):
    c = I.curves(spark, d).select("video_id", "frame", C.resample(F.col("points"), 100).alias("r"))
    return c.select("video_id", "frame", F.col("r.ys").alias("ys"), F.col("r.xs").alias("xs"), C.zip_points(F.col("r.ys"), F.col("r.xs")).alias("p"))


@query("f11_length", f"WITH {PTS} SELECT {VF}, round(sum(d), 6) AS length FROM st GROUP BY {VF}")
def f11(spark, d):
    return rounded(I.curves(spark, d).select("video_id", "frame", C.length(F.col("points")).alias("length")))


@query("f12_resample", f"WITH {PTS} SELECT {VF}, k, round(y, 6) AS y, round(x, 6) AS x FROM rs")
def f12(spark, d):
    out = _res(spark, d).select("video_id", "frame", F.posexplode("p").alias("k", "q"))
    return rounded(out.select("video_id", "frame", "k", F.col("q.y").alias("y"), F.col("q.x").alias("x")))


HEAD = f"""WITH {PTS}, hp AS (SELECT {VF}, """ + ", ".join(f"max(y) FILTER (k = {k}) AS y{k}, max(x) FILTER (k = {k}) AS x{k}" for k in (0, 5, 8, 10, 15, 70, 99)) + f""" FROM rs GROUP BY {VF}),
  hc AS (""" + " UNION ALL ".join(f"SELECT {VF}, {k} AS h, y{k} - y0 AS hy, x{k} - x0 AS hx, y99 - y70 AS by_, x99 - x70 AS bx FROM hp" for k in (5, 8, 10, 15)) + f"""),
  ha AS (SELECT *, sqrt(hy * hy + hx * hx) AS hm, sqrt(by_ * by_ + bx * bx) AS bm FROM hc),
  hb AS (SELECT *, CASE WHEN by_ * hx - bx * hy < 0 THEN -1 ELSE 1 END * degrees(acos(greatest(-1, least(1, (hy * by_ + hx * bx) / (hm * bm))))) AS a FROM ha WHERE hm >= 5 AND bm >= 5),
  hx_ AS (SELECT {VF}, arg_max(a, {{'s': abs(a), 'h': -h}}) AS a, arg_max(hm, {{'s': abs(a), 'h': -h}}) AS hm, arg_max(bm, {{'s': abs(a), 'h': -h}}) AS bm FROM hb GROUP BY {VF})"""


@query("f13_head_angle", f"{HEAD} SELECT hp.video_id, hp.frame, round(coalesce(a, 0), 5) AS angle_degrees, round(coalesce(hm, 0), 5) AS head_mag, round(coalesce(bm, 0), 5) AS body_mag, CASE WHEN a IS NULL THEN 'No valid angle found with current parameters' END AS error FROM hp LEFT JOIN hx_ USING ({VF})")
def f13(spark, d):
    a = C.pick_head_angle(C.head_candidates(F.col("p")), F.lit(None).cast("double"))
    return rounded(_res(spark, d).select("video_id", "frame", a.alias("a")).select("video_id", "frame", "a.*"), 5)


FIXED = """fx AS (SELECT *, y{h} - y0 AS hy, x{h} - x0 AS hx, yl - y{b} AS by_, xl - x{b} AS bx FROM (SELECT video_id, frame, max(y) FILTER (k = 0) AS y0, max(x) FILTER (k = 0) AS x0, max(y) FILTER (k = {h}) AS y{h}, max(x) FILTER (k = {h}) AS x{h},
   max(y) FILTER (k = {b}) AS y{b}, max(x) FILTER (k = {b}) AS x{b}, max(y) FILTER (k = 99) AS yl, max(x) FILTER (k = 99) AS xl FROM rs GROUP BY 1, 2)),
   fa AS (SELECT *, CASE WHEN by_ * hx - bx * hy < 0 THEN -1 ELSE 1 END * degrees(acos(greatest(-1, least(1, (hy * by_ + hx * bx) / (sqrt(hy ** 2 + hx ** 2) * sqrt(by_ ** 2 + bx ** 2)))))) AS angle FROM fx)"""


@query("f14_fixed_head_angle", f"WITH {PTS}, {FIXED.format(h=15, b=60)} SELECT {VF}, round(angle, 5) AS angle, CASE WHEN by_ * hx - bx * hy > 0 THEN 'left' ELSE 'right' END AS direction FROM fa")
def f14(spark, d):
    f = C.fixed_head_angle(F.col("p"), 15, 40)
    return rounded(_res(spark, d).select("video_id", "frame", f.alias("f")).select("video_id", "frame", "f.angle", "f.direction"), 5)


def _fixed_series(spark, d):
    from kymora.operators.ordered import neighbour_columns

    f = _res(spark, d).select("video_id", "frame", "p", C.fixed_head_angle(F.col("p"), 15, 40).alias("f"))
    return neighbour_columns(f, ["video_id"], "frame", 1, {"prev": lambda w: F.lag("f").over(w)})


@query("f14_adaptive_head_angle", f"""WITH {PTS}, {FIXED.format(h=15, b=60)}, {FIXED.format(h=20, b=60).replace('fx', 'fx2').replace('fa AS', 'fa2 AS')}, g AS (SELECT *, lag(angle) OVER (PARTITION BY video_id ORDER BY frame) AS prev FROM fa)
  SELECT {VF}, round(CASE WHEN abs(g.angle - prev) > 20 THEN fa2.angle ELSE g.angle END, 5) AS angle, CASE WHEN abs(g.angle - prev) > 20 THEN 20 ELSE 15 END::BIGINT AS head_segment_length FROM g JOIN fa2 USING ({VF})""")
def f14b(spark, d):
    s = _fixed_series(spark, d)
    a = C.adaptive_head_angle(F.col("p"), F.col("prev.angle"), 15, 40)
    return rounded(s.select("video_id", "frame", a.alias("a")).select("video_id", "frame", "a.angle", "a.head_segment_length"), 5)


@query("f14_angle_diagnostics", f"""WITH {PTS}, {FIXED.format(h=15, b=60)}, g AS (SELECT *, lag(angle) OVER w AS pa, lag(hy) OVER w AS phy, lag(hx) OVER w AS phx, lag(by_) OVER w AS pby, lag(bx) OVER w AS pbx FROM fa WINDOW w AS (PARTITION BY video_id ORDER BY frame))
  SELECT {VF}, round(abs(angle - pa), 5) AS angle_change, coalesce(abs(angle - pa) > 150, false) AS possible_flip, round((hy * phy + hx * phx) / (sqrt(hy ** 2 + hx ** 2) * sqrt(phy ** 2 + phx ** 2)), 5) AS head_consistency,
   round((by_ * pby + bx * pbx) / (sqrt(by_ ** 2 + bx ** 2) * sqrt(pby ** 2 + pbx ** 2)), 5) AS body_consistency FROM g""")
def f14c(spark, d):
    s = _fixed_series(spark, d)
    return rounded(s.select("video_id", "frame", C.angle_diagnostics(F.col("f"), F.col("prev")).alias("q")).select("video_id", "frame", "q.*"), 5)


def _eigen(src, half, last, name):
    return f"""{name} AS (SELECT video_id, frame, i, vy, vx, c, (vy + vx) / 2 - sqrt(((vy - vx) / 2) ** 2 + c ** 2) AS small, (vy + vx) / 2 + sqrt(((vy - vx) / 2) ** 2 + c ** 2) AS large FROM (
     SELECT a.video_id, a.frame, a.i, var_pop(b.y) AS vy, var_pop(b.x) AS vx, covar_pop(b.y, b.x) AS c FROM (SELECT DISTINCT video_id, frame, i FROM {src}) a, range(-{half}, {half} + 1) r(o) JOIN {src} b ON b.video_id = a.video_id AND b.frame = a.frame AND b.i = greatest(0, least({last}, a.i + o)) GROUP BY ALL))"""


CURV = f"{I.CURVE_POINTS_SQL}, cp AS (SELECT video_id, frame, pos AS i, y, x FROM curve_points), {_eigen('cp', 4, 31, 'ev')}, cv AS (SELECT video_id, frame, i, small / (small + large) AS c FROM ev)"


@query("f15_curvature", f"WITH {CURV} SELECT {VF}, i, round(c, 6) AS curvature FROM cv")
def f15(spark, d):
    p = F.col("points")
    out = I.curves(spark, d).select("video_id", "frame", F.posexplode(C.curvature(C.ys(p), C.xs(p), 9)).alias("i", "curvature"))
    return rounded(out)


SMOOTH = f"""{PTS}, kw AS (SELECT o, exp(-0.5 * (o / 4.0) ** 2) / sum(exp(-0.5 * (o / 4.0) ** 2)) OVER () AS w FROM range(-16, 17) r(o)),
  sm AS (SELECT a.video_id, a.frame, a.k AS i, sum(w * b.y) AS y, sum(w * b.x) AS x FROM (SELECT * FROM rs, kw WHERE k < 40) a JOIN rs b ON b.video_id = a.video_id AND b.frame = a.frame
     AND b.k = CASE WHEN a.k + a.o < 0 THEN -(a.k + a.o) - 1 WHEN a.k + a.o > 39 THEN 79 - (a.k + a.o) ELSE a.k + a.o END GROUP BY ALL), {_eigen('sm', 12, 39, 'ev')}, hcv AS (SELECT video_id, frame, i, small / (large + 1e-10) AS c FROM ev)"""


@query("f15_head_curvature", f"WITH {SMOOTH} SELECT rs.video_id, rs.frame, k AS i, round(coalesce(c, 0), 6) AS curvature FROM rs LEFT JOIN hcv ON hcv.video_id = rs.video_id AND hcv.frame = rs.frame AND hcv.i = rs.k")
def f15b(spark, d):
    out = _res(spark, d).select("video_id", "frame", F.posexplode(C.head_curvature(F.col("ys"), F.col("xs"), 0.4)).alias("i", "curvature"))
    return rounded(out)


TURNS = f"""{CURV}, mi AS (SELECT video_id, frame, i, small, large, CASE WHEN c <> 0 THEN c WHEN vy <= vx THEN 1.0 ELSE 0.0 END AS my, CASE WHEN c <> 0 THEN small - vy WHEN vy <= vx THEN 0.0 ELSE 1.0 END AS mx FROM ev),
  tu AS (SELECT *, lag(my) OVER w AS py, lag(mx) OVER w AS px, lead(i) OVER w AS nxt FROM mi WINDOW w AS (PARTITION BY video_id, frame ORDER BY i))"""


@query("f15_signed_curvature", f"""WITH {TURNS} SELECT {VF}, i, round(CASE WHEN small + large > 0 THEN small / (small + large) ELSE 0 END
  * CASE WHEN py IS NULL OR nxt IS NULL THEN 1 ELSE sign(py * mx - px * my) * CASE WHEN py * my + px * mx < 0 THEN -1 ELSE 1 END END, 6) AS curvature FROM tu""")
def f15c(spark, d):
    p = F.col("points")
    return rounded(I.curves(spark, d).select("video_id", "frame", F.posexplode(C.signed_curvature(C.ys(p), C.xs(p), 9)).alias("i", "curvature")))


@query("f16_strongest_bend", f"WITH {SMOOTH}, b AS (SELECT video_id, frame, arg_max(i, {{'c': c, 'i': -i}}) AS i, max(c) AS c FROM hcv GROUP BY 1, 2) SELECT b.video_id, b.frame, round(b.i / 100.0, 6) AS bend_location, round(c, 6) AS bend_magnitude, round(y, 6) AS bend_position_y, round(x, 6) AS bend_position_x FROM b JOIN rs ON rs.video_id = b.video_id AND rs.frame = b.frame AND rs.k = b.i")
def f16(spark, d):
    r = _res(spark, d).withColumn("k", C.head_curvature(F.col("ys"), F.col("xs"), 0.4))
    return rounded(r.select("video_id", "frame", C.strongest_bend(F.col("p"), F.col("k")).alias("b")).select("video_id", "frame", "b.*"))


@query("f17_segment_angles", f"""WITH {PTS}, s AS (SELECT a.video_id, a.frame, a.k, b.y - a.y AS y1, b.x - a.x AS x1, c.y - b.y AS y2, c.x - b.x AS x2 FROM rs a JOIN rs b ON a.video_id = b.video_id AND a.frame = b.frame AND b.k = a.k + 20 JOIN rs c ON a.video_id = c.video_id AND a.frame = c.frame AND c.k = a.k + 40 WHERE a.k % 10 = 0 AND a.k < 60),
  g AS (SELECT *, (k + 20) / 100.0 AS p, CASE WHEN y1 * x2 - x1 * y2 > 0 THEN 1 ELSE -1 END * degrees(acos(greatest(-1, least(1, (y1 * y2 + x1 * x2) / (sqrt(y1 ** 2 + x1 ** 2) * sqrt(y2 ** 2 + x2 ** 2)))))) AS a FROM s)
  SELECT {VF}, round(arg_min(a, {{'d': round(abs(p - 0.33), 12), 'k': k}}), 5) AS angle, round(avg(abs(a)), 5) AS mean_angle FROM g GROUP BY {VF}""")
def f17(spark, d):
    r = _res(spark, d).withColumn("s", C.segment_angles(F.col("p"), 20))
    m = C.mean(F.transform("s", lambda a: F.abs(a["angle"])))
    return rounded(r.select("video_id", "frame", C.angle_near(F.col("s"), F.lit(0.33)).alias("angle"), m.alias("mean_angle")), 5)


OFFS = f"""{I.CURVE_POINTS_SQL}, ends AS (SELECT {VF}, arg_min(y, pos) AS y0, arg_min(x, pos) AS x0, arg_max(y, pos) AS y1, arg_max(x, pos) AS x1 FROM curve_points GROUP BY {VF}),
  off AS (SELECT p.video_id, p.frame, (y1 - y0) * (x - x0) - (x1 - x0) * (y - y0) AS cr, abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)) / sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2) AS d FROM curve_points p JOIN ends USING ({VF}))"""


@query("f18_swim_amplitude", f"WITH {OFFS} SELECT {VF}, round(max(d), 6) AS max_amplitude, round(avg(d), 6) AS avg_amplitude FROM off GROUP BY {VF}")
def f18(spark, d):
    top, avg = C.swim_amplitude(F.col("points"))
    return rounded(I.curves(spark, d).select("video_id", "frame", top.alias("max_amplitude"), avg.alias("avg_amplitude")))


CLASS = """cl AS (SELECT video_id, frame, CASE WHEN greatest(count(*) FILTER (cr >= 1e-10), count(*) FILTER (cr <= -1e-10)) / 32 >= 0.85 AND max(d) > 1.5 THEN 'C-shape' WHEN max(d) <= 1.5 THEN 'Straight'
   WHEN (max(cr) >= 1e-10)::INT + (min(cr) <= -1e-10)::INT + (min(abs(cr)) < 1e-10)::INT > 1 THEN 'S-shape' ELSE 'Unknown' END AS shape FROM off GROUP BY 1, 2)"""


@query("f19_shape_class", f"WITH {OFFS}, {CLASS} SELECT {VF}, shape FROM cl")
def f19(spark, d):
    return I.curves(spark, d).select("video_id", "frame", C.shape_class(F.col("points"), 1.5, 0.85).alias("shape"))


PEAK = f"pk AS (SELECT video_id, frame, count(*) AS n, min(i) AS a, max(i) AS z FROM (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS q FROM cv WINDOW w AS (PARTITION BY {VF} ORDER BY i)) WHERE c > p AND c > q GROUP BY 1, 2)"


@query("f20_wavelength", f"""WITH {CURV}, {PEAK}, {OFFS.replace(I.CURVE_POINTS_SQL + ', ', '')}, {CLASS}, st AS (SELECT *, coalesce(sqrt((y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2), 0) AS d FROM curve_points WINDOW w AS (PARTITION BY {VF} ORDER BY pos)), ln AS (SELECT {VF}, sum(d) AS len FROM st GROUP BY {VF}),
  wl AS (SELECT cl.video_id, cl.frame, len, CASE shape WHEN 'C-shape' THEN 2 * len WHEN 'Straight' THEN 4 * len WHEN 'S-shape' THEN CASE WHEN n > 1 THEN 2.0 * (z - a) / (n - 1) ELSE 0 END ELSE 0 END AS w FROM cl JOIN ln USING ({VF}) LEFT JOIN pk USING ({VF}))
  SELECT {VF}, round(w, 6) AS wavelength, round(CASE WHEN w <> 0 THEN len / w END, 6) AS wave_number, round(w / len, 6) AS normalized_wavelength FROM wl""")
def f20(spark, d):
    p = F.col("points")
    c = I.curves(spark, d).withColumn("k", C.curvature(C.ys(p), C.xs(p), 9)).withColumn("len", C.length(p))
    w = C.wavelength(C.shape_class(p, 1.5, 0.85), F.col("len"), C.strict_peaks(F.col("k")))
    c = c.withColumn("wavelength", w)
    return rounded(c.select("video_id", "frame", "wavelength", F.try_divide("len", "wavelength").alias("wave_number"), F.try_divide("wavelength", "len").alias("normalized_wavelength")))


@query("f20_crawl_wavelength", f"WITH {CURV}, {PEAK} SELECT f.video_id, f.frame, round(CASE WHEN n > 1 THEN 2.0 * (z - a) / (n - 1) ELSE 64 END, 6) AS wavelength FROM (SELECT DISTINCT {VF} FROM cv) f LEFT JOIN pk USING ({VF})")
def f20b(spark, d):
    p = F.col("points")
    c = I.curves(spark, d).withColumn("k", C.curvature(C.ys(p), C.xs(p), 9))
    return rounded(c.select("video_id", "frame", C.crawl_wavelength(p, C.strict_peaks(F.col("k"))).alias("wavelength")))


@query("f21_spatial_frequency", f"WITH {CURV}, ft AS (SELECT {VF}, k, round(sqrt(sum(c * cos(2 * pi() * k * i / 32)) ** 2 + sum(c * sin(2 * pi() * k * i / 32)) ** 2), 9) AS m FROM cv, range(1, 17) r(k) GROUP BY {VF}, k) SELECT {VF}, round(arg_max(k, {{'m': m, 'k': -k}}) / 32.0, 6) AS frequency FROM ft GROUP BY {VF}")
def f21(spark, d):
    p = F.col("points")
    return rounded(I.curves(spark, d).select("video_id", "frame", C.spatial_frequency(C.curvature(C.ys(p), C.xs(p), 9)).alias("frequency")))


@query("f30_profile_fit", """WITH v AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS y, i - 31.5 AS u FROM embeddings, range(64) r(i)), m AS (SELECT *, y - avg(y) OVER (PARTITION BY vec_id) AS c, abs(y - lag(y) OVER (PARTITION BY vec_id ORDER BY i)) AS t FROM v)
  SELECT vec_id, round((sum(c * c) - sum(c * u) ** 2 / sum(u * u) - sum(c * (u * u - 341.25)) ** 2 / sum((u * u - 341.25) ** 2)) / 64, 7) AS mse, round(sum(t), 6) AS variation FROM m GROUP BY 1""")
def f30(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    t = table(spark, d, "embeddings").select("vec_id", C.quadratic_fit_mse(e).alias("mse"), C.total_variation(e).alias("variation"))
    return t.select("vec_id", F.round("mse", 7).alias("mse"), F.round("variation", 6).alias("variation"))


@query("t6_head_first", f"WITH {I.CURVE_POINTS_SQL}, e AS (SELECT {VF}, arg_min(y, pos) AS y0, arg_max(y, pos) AS y1, arg_min(x, pos) AS x0, arg_max(x, pos) AS x1 FROM curve_points GROUP BY {VF}) SELECT {VF}, round(CASE WHEN y0 < y1 OR (y0 = y1 AND x0 < x1) THEN x0 ELSE x1 END, 6) AS head_x FROM e")
def t6(spark, d):
    flipped = F.when(F.col("frame") % 2 == 0, F.col("points")).otherwise(F.reverse("points"))
    return rounded(I.curves(spark, d).select("video_id", "frame", C.at(C.head_first(flipped), 0)["x"].alias("head_x")))


# One pixel for each column, so a pixel has a neighbour in the column before and behind at most, and tips end stretches of columns.
WALK = f"""WITH {I.PIXELS_SQL}, px AS (SELECT video_id, frame, x, arg_max(y, intensity) AS y FROM frame_pixels GROUP BY 1, 2, 3),
  br AS (SELECT *, CASE WHEN lag(x) OVER w = x - 1 AND abs(y - lag(y) OVER w) <= 1 THEN 0 ELSE 1 END AS b FROM px WINDOW w AS (PARTITION BY video_id, frame ORDER BY x)),
  st AS (SELECT *, sum(b) OVER (PARTITION BY video_id, frame ORDER BY x) AS c FROM br), le AS (SELECT *, count(*) OVER c AS len, min(x) OVER c AS x0, max(x) OVER c AS x1 FROM st WINDOW c AS (PARTITION BY video_id, frame, c)),
  po AS (SELECT * FROM (SELECT *, len > 1 AND (x = x0 OR x = x1) AS tip, bool_or(len > 1) OVER (PARTITION BY video_id, frame) AS tips FROM le) q WHERE tip OR NOT tips),
  fa AS (SELECT a.video_id, a.frame, a.x, a.y, max((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM po a JOIN po b ON a.video_id = b.video_id AND a.frame = b.frame GROUP BY 1, 2, 3, 4),
  s0 AS (SELECT video_id, frame, arg_max(x, {{'d': d, 'y': -y, 'x': -x}}) AS sx FROM fa GROUP BY 1, 2),
  on_ AS (SELECT le.*, sx, c = (SELECT c FROM le z WHERE z.video_id = le.video_id AND z.frame = le.frame AND z.x = sx) AS way FROM le JOIN s0 USING (video_id, frame)),
  en AS (SELECT video_id, frame, arg_max(y, abs(x - sx)) AS ey, arg_max(x, abs(x - sx)) AS ex FROM on_ WHERE way GROUP BY 1, 2),
  od AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY NOT way, CASE WHEN way THEN abs(x - sx) ELSE (x - ex) ** 2 + (y - ey) ** 2 END, y, x) - 1 AS pos, count(*) OVER (PARTITION BY video_id, frame) AS m FROM on_ JOIN en USING (video_id, frame)),
  hd AS (SELECT *, first_value(y) OVER w AS y0, first_value(x) OVER w AS x0_, last_value(y) OVER w AS y1, last_value(x) OVER w AS x1_ FROM od WINDOW w AS (PARTITION BY video_id, frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("t5_ordered_skeletons", f"{WALK} SELECT video_id, frame::BIGINT AS frame, 2 AS object_id, CASE WHEN y0 < y1 OR (y0 = y1 AND x0_ < x1_) THEN pos ELSE m - 1 - pos END AS pos, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM hd")
def t5(spark, d):
    """Skeleton pixels: per frame and column of the image, the brightest row."""
    p = I.frame_pixels(spark, d)
    px = p.groupBy("video_id", "frame", "x").agg(F.max_by("y", "intensity").alias("y")).select("video_id", "frame", F.lit(2).alias("object_id"), "y", "x")
    o = C.ordered_skeletons(px, M.MASK).select(*M.MASK, F.posexplode("points").alias("pos", "p"))
    return rounded(o.select(*M.MASK, "pos", F.col("p.y").alias("y"), F.col("p.x").alias("x")))


@query("a52_angle_statistics", """WITH r AS (SELECT 'v' || (user_id % 3) AS viscosity, (value * 7.0) % 240.0 - 120.0 AS angle, value FROM events), l AS (SELECT viscosity, 'angle' AS measure, angle AS v FROM r UNION ALL SELECT viscosity, 'value', value FROM r)
  SELECT viscosity, measure, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75 FROM l GROUP BY 1, 2""")
def a52(spark, d):
    return rounded(SH.angle_statistics(I.readings(spark, d), ["viscosity"], ["angle", "value"]))


# ---------------------------------------------------------------- signals

ZS = f"{SER}, z AS (SELECT subject, frame, n, (value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) AS v FROM n)"
SEG = """sg AS (SELECT DISTINCT subject, n, s FROM z, range(0, 400) r(s) WHERE s * 5 < n), sv AS (SELECT g.subject, g.n, s, o, v FROM (SELECT * FROM sg, range(30) r(o)) g JOIN z ON z.subject = g.subject AND z.frame = least(g.n - 1, s * 5 + o)),
  sd AS (SELECT *, (v - avg(v) OVER (PARTITION BY subject, s)) * (0.5 - 0.5 * cos(2 * pi() * o / 30)) AS w FROM sv),
  ps AS (SELECT subject, n, s, k, (sum(w * cos(2 * pi() * k * o / 30)) ** 2 + sum(w * sin(2 * pi() * k * o / 30)) ** 2) / (10 * 11.25) * CASE WHEN k IN (0, 15) THEN 1 ELSE 2 END AS p FROM sd, range(16) r(k) GROUP BY subject, n, s, k)"""


def _zser(spark, d):
    return N.z_score(I.series(spark, d), [], "value", "v", population=True)


@query("f22_mean_power", f"{ZS}, {SEG} SELECT subject, k, round(avg(p), 7) AS psd, round(k * 10 / 30.0, 6) AS f FROM ps WHERE s * 5 + 30 <= n GROUP BY subject, k")
def f22(spark, d):
    g = G.mean_power(G.segment_power(_zser(spark, d), KEY, "frame", "v", 10.0, 30, 25), KEY, 10.0, 30)
    return rounded(g.withColumn("psd", F.round("psd", 7)), 7).withColumn("f", F.round("f", 6))


DOM = """pm AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b, max(p) OVER (PARTITION BY subject, s) AS mx FROM ps WINDOW w AS (PARTITION BY subject, s ORDER BY k)),
  dm AS (SELECT subject, n, s, arg_max(k, p) AS top, arg_max(k, p) FILTER (p > a AND p > b AND p >= 0.1 * mx) AS peak FROM pm GROUP BY subject, n, s)"""


@query("f22_frame_frequency", f"""{ZS}, {SEG}, {DOM}, fr AS (SELECT subject, s, coalesce(peak, top) / 3.0 AS f FROM dm), l AS (SELECT z.subject, z.frame, least(frame // 5, (SELECT max(s) FROM fr WHERE fr.subject = z.subject)) AS s FROM z)
  SELECT l.subject, l.frame, round(CASE WHEN b.f IS NULL THEN a.f ELSE a.f + (b.f - a.f) * (l.frame - l.s * 5) / 5.0 END, 6) AS frequency FROM l JOIN fr a ON a.subject = l.subject AND a.s = l.s LEFT JOIN fr b ON b.subject = l.subject AND b.s = l.s + 1""")
def f22b(spark, d):
    z = _zser(spark, d)
    seg = G.segment_power(z, KEY, "frame", "v", 10.0, 30, 25)
    return rounded(G.frame_frequency(z.select("subject", "frame"), seg, KEY, "frame", 10.0, 30, 25))


@query("f22_frame_frequency_no_tail", f"""{ZS}, {SEG}, {DOM}, fr AS (SELECT subject, s, coalesce(peak, 0) / 3.0 AS f FROM dm WHERE s * 5 < n - 30), l AS (SELECT z.subject, z.frame, least(frame // 5, (SELECT max(s) FROM fr WHERE fr.subject = z.subject)) AS s FROM z)
  SELECT l.subject, l.frame, round(CASE WHEN b.f IS NULL THEN a.f ELSE a.f + (b.f - a.f) * (l.frame - l.s * 5) / 5.0 END, 6) AS frequency FROM l LEFT JOIN fr a ON a.subject = l.subject AND a.s = l.s LEFT JOIN fr b ON b.subject = l.subject AND b.s = l.s + 1""")
def f22c(spark, d):
    z = _zser(spark, d)
    seg = G.segment_power(z, KEY, "frame", "v", 10.0, 30, 25)
    return rounded(G.frame_frequency(z.select("subject", "frame"), seg, KEY, "frame", 10.0, 30, 25, tail=False))


DFT = f"""{SER}, ft AS (SELECT subject, n, k, sum(angle * cos(2 * pi() * ((k * frame) % n) / n)) AS re, sum(angle * sin(2 * pi() * ((k * frame) % n) / n)) AS im FROM (SELECT subject, frame, angle, n FROM n), range(0, 400) r(k) WHERE k <= n // 2 GROUP BY subject, n, k)"""


@query("f28_fourier_magnitudes", f"{DFT} SELECT subject, n, k, round(2 * sqrt(re ** 2 + im ** 2) / n, 8) AS magnitude FROM ft WHERE k < n // 2")
def f28(spark, d):
    return rounded(G.magnitudes(G.spectrum(I.series(spark, d), KEY, "frame", "angle")), 8)


@query("f28_blocked_spectrum", f"{DFT} SELECT subject, n, k, round(2 * sqrt(re ** 2 + im ** 2) / n, 8) AS magnitude FROM ft WHERE k < n // 2")
def f28b(spark, d):
    """The same split into columns and rows of 16 values, as long series are."""
    return rounded(G.magnitudes(G.spectrum(I.series(spark, d), KEY, "frame", "angle", 4)), 8)


@query("f28_periodogram", f"""{SER}, c AS (SELECT subject, n, frame, angle - avg(angle) OVER (PARTITION BY subject) AS v FROM n), ft AS (SELECT subject, n, k, sum(v * cos(2 * pi() * ((k * frame) % n) / n)) AS re, sum(v * sin(2 * pi() * ((k * frame) % n) / n)) AS im FROM c, range(0, 400) r(k) WHERE k <= n // 2 GROUP BY subject, n, k)
  SELECT subject, n, k, round(5.0 * k / n, 3) AS f, round((re ** 2 + im ** 2) / (5 * n) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END, 3) AS psd FROM ft""")
def f28c(spark, d):
    return rounded(G.periodogram(I.series(spark, d), KEY, "frame", "angle", 5.0), 3)


WAVES = f"""{SER}, ps AS (SELECT s, o, exp(-((o / s) ** 2)) / sqrt(pi() * s) AS a, 2 * pi() * o / s AS b FROM (SELECT CAST(s AS DOUBLE) AS s, CAST(o AS DOUBLE) AS o FROM range(1, 128) r(s), range(-1016, 1017) q(o) WHERE abs(o) <= 8 * s) x),
  wv AS (SELECT c.subject, c.frame, s, sqrt(sum(a * cos(b) * t.angle) ** 2 + sum(a * sin(b) * t.angle) ** 2) AS m FROM n c JOIN n t USING (subject) JOIN ps ON o = t.frame - c.frame GROUP BY 1, 2, 3)"""


@query("f29_wavelet_range", f"{WAVES} SELECT subject, CAST(s AS BIGINT) AS scale, round(max(m), 5) AS largest, round(avg(m), 5) AS mean FROM wv GROUP BY 1, 2")
def f29(spark, d):
    """Largest and mean wavelet magnitude per subject and scale."""
    w = G.wavelet_magnitudes(I.series(spark, d), KEY, "frame", "angle", 127)
    rows = w.select("subject", F.posexplode("magnitudes").alias("scale", "m"))
    return rounded(rows.groupBy("subject", (F.col("scale") + 1).alias("scale")).agg(F.max("m").alias("largest"), F.avg("m").alias("mean")), 5)


@query("f23_local_peaks", f"{SER}, g AS (SELECT subject, frame, k, lag(k) OVER w AS p, lead(k) OVER w AS q FROM n WINDOW w AS (PARTITION BY subject ORDER BY frame)), r AS (SELECT *, sum(CASE WHEN p IS NULL OR k <> p THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY frame) AS run FROM g), "
       "u AS (SELECT subject, run, any_value(k) AS k, min(frame) AS a, max(frame) AS b FROM r GROUP BY 1, 2), v AS (SELECT *, lag(k) OVER w AS p, lead(k) OVER w AS q FROM u WINDOW w AS (PARTITION BY subject ORDER BY run)) SELECT subject, CAST((a + b) // 2 AS BIGINT) AS frame, k AS height FROM v WHERE k > p AND k > q")
def f23(spark, d):
    return G.local_peaks(I.series(spark, d), KEY, "frame", "k")


@query("f23_prominences", f"""{SER}, g AS (SELECT subject, frame, angle, lag(angle) OVER w AS p, lead(angle) OVER w AS q FROM n WINDOW w AS (PARTITION BY subject ORDER BY frame)), pk AS (SELECT subject, frame, angle AS h FROM g WHERE angle > p AND angle > q),
  lf AS (SELECT pk.subject, pk.frame, max(s.frame) FILTER (s.angle > h AND s.frame < pk.frame) AS l, min(s.frame) FILTER (s.angle > h AND s.frame > pk.frame) AS r, any_value(h) AS h FROM pk JOIN series s USING (subject) GROUP BY 1, 2)
  , sb AS (SELECT pk.subject, pk.frame, any_value(lf.h) AS h, min(s.angle) FILTER (s.frame <= pk.frame AND s.frame > coalesce(l, -1)) AS a, min(s.angle) FILTER (s.frame >= pk.frame AND s.frame < coalesce(r, 1000000)) AS b FROM pk JOIN lf USING (subject, frame) JOIN series s ON s.subject = pk.subject GROUP BY 1, 2)
  SELECT subject, frame, round(h, 6) AS height, round(h - greatest(a, b), 6) AS prominence FROM sb""".replace("JOIN series s USING (subject)", "JOIN (SELECT subject, frame, angle FROM series) s ON s.subject = pk.subject"))
def f23b(spark, d):
    """Blocks of 16 values, so that the search over blocks is at work."""
    s = I.series(spark, d)
    return rounded(G.with_prominence(G.local_peaks(s, KEY, "frame", "angle"), s, KEY, "frame", "angle", 16))


BENDS = f"""{DFT}, sg AS (SELECT subject, sign, frame, angle * sign AS v FROM n, (VALUES (1), (-1)) t(sign)),
  g AS (SELECT *, lag(v) OVER w AS p FROM sg WINDOW w AS (PARTITION BY subject, sign ORDER BY frame)),
  rn AS (SELECT *, sum(CASE WHEN p IS NULL OR v <> p THEN 1 ELSE 0 END) OVER (PARTITION BY subject, sign ORDER BY frame) AS run FROM g),
  u AS (SELECT subject, sign, run, any_value(v) AS v, min(frame) AS a, max(frame) AS b FROM rn GROUP BY 1, 2, 3),
  pk AS (SELECT subject, sign, (a + b) // 2 AS frame, v AS h FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM u WINDOW w AS (PARTITION BY subject, sign ORDER BY run)) x WHERE v > p AND v > q),
  kp AS (SELECT subject, sign, unnest(list_reduce(list([CAST(frame AS BIGINT)] ORDER BY h DESC, frame DESC), lambda acc, f: CASE WHEN len(list_filter(acc, lambda k: abs(k - f[1]) < 8)) > 0 THEN acc ELSE list_concat(acc, f) END)) AS frame FROM pk GROUP BY 1, 2),
  lf AS (SELECT kp.subject, kp.sign, kp.frame, any_value(pk.h) AS h, max(s.frame) FILTER (s.v > pk.h AND s.frame < kp.frame) AS l, min(s.frame) FILTER (s.v > pk.h AND s.frame > kp.frame) AS r FROM kp JOIN pk USING (subject, sign, frame) JOIN sg s ON s.subject = kp.subject AND s.sign = kp.sign GROUP BY 1, 2, 3),
  pr AS (SELECT lf.subject, lf.sign, lf.frame, any_value(h) AS h, any_value(h) - greatest(min(s.v) FILTER (s.frame <= lf.frame AND s.frame > coalesce(l, -1)), min(s.v) FILTER (s.frame >= lf.frame AND s.frame < coalesce(r, 1000000))) AS d FROM lf JOIN sg s ON s.subject = lf.subject AND s.sign = lf.sign GROUP BY 1, 2, 3),
  e AS (SELECT pr.subject, pr.sign, pr.frame, h * pr.sign AS h FROM pr JOIN (SELECT subject, stddev_pop(angle) / 3 AS t FROM n GROUP BY 1) z USING (subject) WHERE d >= t),
  ag AS (SELECT subject, count(*) FILTER (sign > 0) AS num_peaks, count(*) FILTER (sign < 0) AS num_troughs, avg(h) FILTER (sign > 0) AS avg_peak_depth, avg(h) FILTER (sign < 0) AS avg_trough_depth, max(h) FILTER (sign > 0) AS max_peak_depth, min(h) FILTER (sign < 0) AS max_trough_depth, (count(*) - 1) * 10.0 / nullif(max(frame) - min(frame), 0) AS f FROM e GROUP BY 1),
  dm AS (SELECT subject, arg_max(k * 10.0 / n, {{'p': round(re ** 2 + im ** 2, 9), 'k': -k}}) AS dominant_freq FROM ft WHERE k > 0 GROUP BY 1)"""


@query("f24_head_bends", f"{BENDS} SELECT x.subject, coalesce(num_peaks, 0) AS num_peaks, coalesce(num_troughs, 0) AS num_troughs, round(avg_peak_depth, 6) AS avg_peak_depth, round(avg_trough_depth, 6) AS avg_trough_depth, round(max_peak_depth, 6) AS max_peak_depth, round(max_trough_depth, 6) AS max_trough_depth, round(coalesce(f, 0), 6) AS avg_bend_frequency, round(dominant_freq, 6) AS dominant_freq FROM (SELECT DISTINCT subject FROM n) x LEFT JOIN ag USING (subject) LEFT JOIN dm USING (subject)")
def f24(spark, d):
    return rounded(G.head_bends(I.series(spark, d), KEY, "frame", "angle", 10.0))


XC = f"""{SER}, d AS (SELECT subject, frame, angle - avg(angle) OVER w AS a, value - avg(value) OVER w AS b, sqrt(var_pop(angle) OVER w * var_pop(value) OVER w) * n AS nm FROM n WINDOW w AS (PARTITION BY subject)),
  xc AS (SELECT p.subject, p.frame - q.frame AS lag, sum(p.a * q.b) / any_value(p.nm) AS r FROM d p JOIN d q ON p.subject = q.subject GROUP BY 1, 2)"""


@query("w20_strongest_lag", f"{XC} SELECT subject, round(arg_max(r, {{'r': round(abs(r), 12), 'l': -lag}}), 6) AS max_corr, arg_max(lag, {{'r': round(abs(r), 12), 'l': -lag}}) AS max_lag FROM xc GROUP BY 1")
def w20(spark, d):
    c = G.cross_correlogram(I.series(spark, d), KEY, "frame", "angle", "value", 5)
    return rounded(G.strongest_lag(c, KEY))


@query("w21_mean_correlogram", f"{XC}, v AS (SELECT 'v' || (subject % 3) AS strain, subject, lag, r FROM xc), k AS (SELECT strain, subject, count(*) AS n FROM v GROUP BY 1, 2), f AS (SELECT strain, arg_min(n, subject) AS n FROM k GROUP BY 1) SELECT v.strain, lag, round(avg(r), 6) AS r FROM v JOIN k USING (strain, subject) JOIN f ON f.strain = v.strain AND f.n = k.n GROUP BY 1, 2")
def w21(spark, d):
    s = I.series(spark, d).withColumnRenamed("viscosity", "strain")
    c = G.cross_correlogram(s, ["strain", "subject"], "frame", "angle", "value")
    return rounded(G.mean_correlogram(c, "strain", "subject"))


# ---------------------------------------------------------------- motion


@query("a38_path_metrics", f"""{SER}, t AS (SELECT *, sqrt((angle - lag(angle) OVER w) ** 2 + (value - lag(value) OVER w) ** 2) AS s, sqrt((angle - first_value(angle) OVER w) ** 2 + (value - first_value(value) OVER w) ** 2) AS a FROM n WINDOW w AS (PARTITION BY subject ORDER BY frame))
  SELECT subject, round(sum(s), 6) AS total_distance, round(max(a), 6) AS max_distance, arg_max(frame, {{'a': a, 'f': -frame}}) AS furthest_frame, count(*) AS n_frames, round(sum(s) / count(*), 6) AS avg_speed, round(coalesce(sum(s) / nullif(arg_max(a, frame), 0), 0), 6) AS sinuosity FROM t GROUP BY 1""")
def a38(spark, d):
    return rounded(MO.path_metrics(I.series(spark, d), KEY, "frame", "angle", "value"))


def _grad(c):
    return f"10 * CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END"


MOT = f"""{SER}, v AS (SELECT *, {_grad('angle')} AS vx, {_grad('value')} AS vy, k - 50.0 AS ox, value - 20.0 AS oy FROM n WINDOW w AS (PARTITION BY subject ORDER BY frame)),
  f0 AS (SELECT *, sqrt(vx ** 2 + vy ** 2) AS raw_speed, degrees(acos(greatest(-1, least(1, vx / sqrt(vx ** 2 + vy ** 2) * ox / sqrt(ox ** 2 + oy ** 2) + vy / sqrt(vx ** 2 + vy ** 2) * oy / sqrt(ox ** 2 + oy ** 2))))) AS raw_angle FROM v),
  fm AS (SELECT a.subject, a.frame, quantile_cont(coalesce(b.raw_speed, 0), 0.5) AS speed, quantile_cont(coalesce(b.raw_angle, 0), 0.5) AS ang FROM (SELECT * FROM f0, range(-2, 3) r(o)) a LEFT JOIN f0 b ON b.subject = a.subject AND b.frame = a.frame + o GROUP BY 1, 2),
  mv AS (SELECT *, CASE WHEN avg(speed) OVER w < 25 THEN 'stationary' WHEN avg(abs(ang)) OVER w < 90 THEN 'forward' ELSE 'backward' END AS movement FROM fm WINDOW w AS (PARTITION BY subject ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def _moves(spark, d):
    from kymora.operators.series import gradient

    s = gradient(I.series(spark, d).withColumnRenamed("angle", "heading"), KEY, "frame", ["heading", "value"], 10.0, ["vx", "vy"])
    s = s.withColumns({"ox": F.col("k") - 50.0, "oy": F.col("value") - 20.0})
    return MO.windowed_class(MO.heading_features(s, KEY, "frame"), KEY, "frame", 25.0, 90.0)


@query("f27_heading_features", f"{MOT} SELECT subject, frame, round(speed, 5) AS speed, round(ang, 5) AS angle FROM fm")
def f27(spark, d):
    return rounded(_moves(spark, d).select("subject", "frame", "speed", "angle"), 5)


@query("w7_windowed_class", f"{MOT} SELECT subject, frame, movement FROM mv")
def w7(spark, d):
    return _moves(spark, d).select("subject", "frame", "movement")


@query("a39_class_means", f"{MOT} SELECT mv.subject, count(*) FILTER (movement = 'forward') AS forward_frames, count(*) FILTER (movement = 'backward') AS backward_frames, count(*) FILTER (movement = 'stationary') AS stationary_frames, " + ", ".join(
    f"round(coalesce(avg({v}) FILTER (movement = '{k}'), 0), 7) AS {k}_{v}" for k in ("forward", "backward") for v in ("vx", "vy", "raw_speed")) + " FROM mv JOIN f0 ON f0.subject = mv.subject AND f0.frame = mv.frame GROUP BY 1")
def a39(spark, d):
    return rounded(MO.class_means(_moves(spark, d), KEY, "movement", ["vx", "vy", "raw_speed"]), 7)


@query("a40_bouts", f"""{MOT}, c AS (SELECT *, CASE WHEN lag(movement) OVER w IS NOT DISTINCT FROM movement THEN 0 ELSE 1 END AS ch FROM mv WINDOW w AS (PARTITION BY subject ORDER BY frame)), r AS (SELECT *, sum(ch) OVER (PARTITION BY subject ORDER BY frame) AS run FROM c),
  b AS (SELECT subject, run, any_value(movement) AS movement, count(*) AS len FROM r GROUP BY 1, 2 HAVING any_value(movement) <> 'stationary')
  SELECT subject, count(*) FILTER (movement = 'forward') AS forward_bouts, round(coalesce(avg(len) FILTER (movement = 'forward'), 0), 6) AS avg_forward_bout_length, count(*) FILTER (movement = 'backward') AS backward_bouts, round(coalesce(avg(len) FILTER (movement = 'backward'), 0), 6) AS avg_backward_bout_length FROM b GROUP BY 1""")
def a40(spark, d):
    return rounded(MO.bout_summary(MO.bouts(_moves(spark, d), KEY, "frame", "movement"), KEY, "movement"))


@query("w9_midbody_class", f"""{SER}, p AS (SELECT *, angle - lag(angle) OVER w AS hx, value - lag(value) OVER w AS hy, k - lag(k) OVER w AS mx, k / 2 - lag(k / 2) OVER w AS my FROM n WINDOW w AS (PARTITION BY subject ORDER BY frame)),
  c0 AS (SELECT *, CASE WHEN frame > 0 THEN CASE WHEN sqrt(hx ** 2 + hy ** 2) < 9 THEN 0 WHEN hx * mx + hy * my > 0 THEN 1 ELSE 2 END END AS c FROM p), c1 AS (SELECT subject, frame, coalesce(c, lead(c) OVER (PARTITION BY subject ORDER BY frame)) AS c FROM c0)
  SELECT a.subject, a.frame, ['stationary', 'forward', 'backward'][CAST(quantile_cont(coalesce(b.c, 0), 0.5) AS INT) + 1] AS movement FROM (SELECT * FROM c1, range(-2, 3) r(o)) a LEFT JOIN c1 b ON b.subject = a.subject AND b.frame = a.frame + o GROUP BY 1, 2""")
def w9(spark, d):
    s = I.series(spark, d).select("subject", "frame", F.col("angle").alias("head_x"), F.col("value").alias("head_y"), F.col("k").alias("mid_x"), (F.col("k") / 2).alias("mid_y"))
    return MO.midbody_class(s, KEY, "frame", 5, 9.0).select("subject", "frame", "movement")


def _ends(spark, d):
    return I.series(spark, d).select("subject", "frame", F.col("angle").alias("ax"), F.col("value").alias("ay"), F.col("k").cast("double").alias("bx"), (F.col("value") / 2).alias("by"))


@query("j20_endpoint_identity", f"""{SER}, p AS (SELECT subject, frame, angle AS ax, value AS ay, k AS bx, value / 2 AS cy, lag(angle) OVER w AS pax, lag(value) OVER w AS pay, lag(k) OVER w AS pbx, lag(value / 2) OVER w AS pby FROM n WINDOW w AS (PARTITION BY subject ORDER BY frame)),
  x AS (SELECT *, CASE WHEN sqrt((ax - pbx) ** 2 + (ay - pby) ** 2) + sqrt((bx - pax) ** 2 + (cy - pay) ** 2) < sqrt((ax - pax) ** 2 + (ay - pay) ** 2) + sqrt((bx - pbx) ** 2 + (cy - pby) ** 2) THEN 1 ELSE 0 END AS s FROM p)
  SELECT subject, frame, sum(s) OVER (PARTITION BY subject ORDER BY frame) % 2 = 1 AS swapped FROM x""")
def j20(spark, d):
    return MO.endpoint_identity(_ends(spark, d), KEY, "frame").select("subject", "frame", "swapped")


HEADS = f"""{SER.replace("WITH", "WITH RECURSIVE", 1)}, p AS (SELECT *, lag(ax) OVER w AS pax, lag(ay) OVER w AS pay, lag(bx) OVER w AS pbx, lag(cy) OVER w AS pby
    FROM (SELECT subject, frame, z.n AS size, angle AS ax, value AS ay, CAST(k AS DOUBLE) AS bx, value / 2 AS cy FROM n z) q WINDOW w AS (PARTITION BY subject ORDER BY frame)),
  x AS (SELECT *, CASE WHEN sqrt((ax - pbx) ** 2 + (ay - pby) ** 2) + sqrt((bx - pax) ** 2 + (cy - pay) ** 2) < sqrt((ax - pax) ** 2 + (ay - pay) ** 2) + sqrt((bx - pbx) ** 2 + (cy - pby) ** 2) THEN 1 ELSE 0 END AS s FROM p),
  y AS (SELECT *, CAST(sum(s) OVER (PARTITION BY subject ORDER BY frame) % 2 AS INT) AS sw FROM x),
  tr AS (SELECT *, CASE sw WHEN 1 THEN bx ELSE ax END AS t0x, CASE sw WHEN 1 THEN cy ELSE ay END AS t0y, CASE sw WHEN 1 THEN ax ELSE bx END AS t1x, CASE sw WHEN 1 THEN ay ELSE cy END AS t1y FROM y),
  mv AS (SELECT *, coalesce(abs(t0x - lag(t0x) OVER w) + abs(t0y - lag(t0y) OVER w), 0) AS s0, coalesce(abs(t1x - lag(t1x) OVER w) + abs(t1y - lag(t1y) OVER w), 0) AS s1 FROM tr WINDOW w AS (PARTITION BY subject ORDER BY frame)),
  wi AS (SELECT *, least(size, greatest(0, frame - 5) + 10) AS f1, CASE WHEN greatest(0, frame - 5) + 10 >= size THEN greatest(0, size - 10) ELSE greatest(0, frame - 5) END AS f0 FROM mv),
  ca AS (SELECT a.subject, a.frame, a.ax, a.ay, a.bx, a.cy, a.sw, round(sum(CASE WHEN b.frame > a.f0 THEN b.s0 ELSE 0 END), 9) AS m0, round(sum(CASE WHEN b.frame > a.f0 THEN b.s1 ELSE 0 END), 9) AS m1, max(CASE WHEN b.frame = a.f0 THEN b.sw END) AS base
    FROM wi a JOIN mv b ON b.subject = a.subject AND b.frame >= a.f0 AND b.frame < a.f1 GROUP BY ALL),
  cd AS (SELECT subject, frame, ax, ay, bx, cy, abs(sw - CASE WHEN m0 > m1 THEN 0 WHEN m0 < m1 THEN 1 ELSE base END) AS c FROM ca),
  h AS (SELECT subject, frame, c AS head, 0.9 AS confidence, CASE c WHEN 0 THEN ax ELSE bx END AS hx, CASE c WHEN 0 THEN ay ELSE cy END AS hy FROM cd WHERE frame = 0
    UNION ALL SELECT subject, frame, pick, CASE WHEN NOT leap THEN 0.8 WHEN frame >= 5 THEN 0.7 ELSE 0.5 END, CASE pick WHEN 0 THEN ax ELSE bx END, CASE pick WHEN 0 THEN ay ELSE cy END
    FROM (SELECT *, CASE WHEN leap AND frame >= 5 THEN CASE WHEN da <= db THEN 0 ELSE 1 END ELSE c END AS pick
      FROM (SELECT *, CASE c WHEN 0 THEN da ELSE db END > 25 AS leap FROM (SELECT cd.*, sqrt((ax - hx) ** 2 + (ay - hy) ** 2) AS da, sqrt((bx - hx) ** 2 + (cy - hy) ** 2) AS db FROM h JOIN cd ON cd.subject = h.subject AND cd.frame = h.frame + 1) u) v) w)"""


@query("w19_head_identification", f"{HEADS} SELECT subject, frame, CAST(head AS BIGINT) AS head, CAST(confidence AS DOUBLE) AS confidence FROM h")
def w19(spark, d):
    return rounded(MO.head_identification(_ends(spark, d), KEY, "frame").select("subject", "frame", "head", "confidence"))


TOTALS = f"""{SER}, {GRAM}, c0 AS (SELECT subject, frame, n, greatest(5, least(frame, n - 6)) AS mid FROM n),
  ft AS (SELECT c0.subject, c0.frame, sum(w * b.angle) AS sx, sum(w * b.value) AS sy FROM c0 JOIN series b ON b.subject = c0.subject AND abs(b.frame - c0.mid) <= 5 JOIN hat ON hat.t = c0.frame - c0.mid AND hat.s = b.frame - c0.mid WHERE n >= 11 GROUP BY 1, 2),
  sm AS (SELECT n.subject, n.frame, sx, sy, angle + k / 10 - angle AS ox, value + 1 - value AS oy FROM n LEFT JOIN ft ON ft.subject = n.subject AND ft.frame = n.frame),
  v AS (SELECT *, {_grad('sx')} AS vx, {_grad('sy')} AS vy FROM sm WINDOW w AS (PARTITION BY subject ORDER BY frame)),
  f0 AS (SELECT *, {_grad('vx')} AS ax, {_grad('vy')} AS ay, sqrt(vx ** 2 + vy ** 2) AS raw_speed, degrees(acos(greatest(-1, least(1, vx / sqrt(vx ** 2 + vy ** 2) * ox / sqrt(ox ** 2 + oy ** 2) + vy / sqrt(vx ** 2 + vy ** 2) * oy / sqrt(ox ** 2 + oy ** 2))))) AS raw_angle FROM v WINDOW w AS (PARTITION BY subject ORDER BY frame)),
  fm AS (SELECT a.subject, a.frame, quantile_cont(coalesce(b.raw_speed, 0), 0.5) AS speed, quantile_cont(coalesce(b.raw_angle, 0), 0.5) AS ang FROM (SELECT * FROM f0, range(-2, 3) r(o)) a LEFT JOIN f0 b ON b.subject = a.subject AND b.frame = a.frame + o GROUP BY 1, 2),
  mv AS (SELECT *, CASE WHEN avg(speed) OVER w < 0 THEN 'stationary' WHEN avg(abs(ang)) OVER w < 100 THEN 'forward' ELSE 'backward' END AS movement FROM fm WINDOW w AS (PARTITION BY subject ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  t AS (SELECT *, sqrt((sx - lag(sx) OVER w) ** 2 + (sy - lag(sy) OVER w) ** 2) AS s, sqrt((sx - first_value(sx) OVER w) ** 2 + (sy - first_value(sy) OVER w) ** 2) AS a FROM sm WINDOW w AS (PARTITION BY subject ORDER BY frame)),
  pm AS (SELECT subject, round(sum(s), 5) AS total_distance, round(max(a), 5) AS max_distance, arg_max(frame, {{'a': a, 'f': -frame}}) AS furthest_frame, count(*) AS n_frames, round(sum(s) / count(*), 5) AS avg_speed, round(coalesce(sum(s) / nullif(arg_max(a, frame), 0), 0), 5) AS sinuosity FROM t GROUP BY 1),
  cm AS (SELECT mv.subject, count(*) FILTER (movement = 'forward') AS forward_frames, count(*) FILTER (movement = 'backward') AS backward_frames, count(*) FILTER (movement = 'stationary') AS stationary_frames, """ + ", ".join(
    f"round(coalesce(avg({v}) FILTER (movement = '{k}'), 0), 5) AS {k}_{v}" for k in ("forward", "backward") for v in ("vx", "vy", "ax", "ay", "raw_speed")) + """ FROM mv JOIN f0 ON f0.subject = mv.subject AND f0.frame = mv.frame GROUP BY 1),
  ch AS (SELECT *, CASE WHEN lag(movement) OVER w IS NOT DISTINCT FROM movement THEN 0 ELSE 1 END AS ch FROM mv WINDOW w AS (PARTITION BY subject ORDER BY frame)), ru AS (SELECT *, sum(ch) OVER (PARTITION BY subject ORDER BY frame) AS run FROM ch),
  bo AS (SELECT subject, run, any_value(movement) AS movement, count(*) AS len FROM ru GROUP BY 1, 2 HAVING any_value(movement) <> 'stationary'),
  bs AS (SELECT subject, count(*) FILTER (movement = 'forward') AS forward_bouts, round(coalesce(avg(len) FILTER (movement = 'forward'), 0), 5) AS avg_forward_bout_length, count(*) FILTER (movement = 'backward') AS backward_bouts, round(coalesce(avg(len) FILTER (movement = 'backward'), 0), 5) AS avg_backward_bout_length FROM bo GROUP BY 1)"""


@query("t3_movement_totals", f"{TOTALS} SELECT * FROM pm LEFT JOIN cm USING (subject) LEFT JOIN bs USING (subject)")
def t3(spark, d):
    s = I.series(spark, d).select(
        "subject", "frame", F.col("angle").alias("x"), F.col("value").alias("y"), (F.col("angle") + F.col("k") / 10).alias("head_x"),
        (F.col("value") + 1).alias("head_y"), F.col("angle").alias("neck_x"), F.col("value").alias("neck_y"),
    )
    return rounded(MO.movement(s, KEY, "frame")[1], 5)


RING = """rg AS (SELECT DISTINCT p.video_id, p.frame, p.object_id, p.y + dy AS y, p.x + dx AS x FROM sparse p, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx) WHERE p.y + dy BETWEEN 0 AND 15 AND p.x + dx BETWEEN 0 AND 15),
  rn AS (SELECT * FROM rg ANTI JOIN sparse USING (video_id, frame, object_id, y, x))"""


@query("j24_tip_points", f"""{SPARSE_SQL}, {RING}, pr AS (SELECT a.video_id, a.frame, a.object_id, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2, row_number() OVER (PARTITION BY a.video_id, a.frame, a.object_id ORDER BY (a.y - b.y) ** 2 + (a.x - b.x) ** 2 DESC, a.y, a.x, b.y, b.x) AS rk FROM rn a JOIN rn b ON a.video_id = b.video_id AND a.frame = b.frame AND a.object_id = b.object_id)
  SELECT video_id, frame::BIGINT AS frame, object_id::BIGINT AS object_id, CAST(y1 AS BIGINT) AS y1, CAST(x1 AS BIGINT) AS x1, CAST(y2 AS BIGINT) AS y2, CAST(x2 AS BIGINT) AS x2 FROM pr WHERE rk = 1""")
def j24(spark, d):
    return rounded(C.tip_points(sparse(spark, d), sparse_index(spark, d), M.MASK))


HULL = """WITH b AS (SELECT DISTINCT l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
  ex AS (SELECT g, x, min(y) AS lo, max(y) AS hi FROM b GROUP BY 1, 2), en AS (SELECT g, min(x) AS x0, max(x) AS x1 FROM ex GROUP BY 1),
  cut AS (SELECT DISTINCT p.g, p.x, (c.x - a.x) * (p.lo - a.lo) - (c.lo - a.lo) * (p.x - a.x) >= 0 AS no_lo, (c.x - a.x) * (p.hi - a.hi) - (c.hi - a.hi) * (p.x - a.x) <= 0 AS no_hi FROM ex p JOIN ex a ON a.g = p.g AND a.x < p.x JOIN ex c ON c.g = p.g AND c.x > p.x),
  bad AS (SELECT g, x, bool_or(no_lo) AS no_lo, bool_or(no_hi) AS no_hi FROM cut GROUP BY 1, 2),
  pt AS (SELECT ex.g, ex.x, lo AS y, 0 AS part FROM ex JOIN en USING (g) LEFT JOIN bad USING (g, x) WHERE NOT coalesce(no_lo, false) AND NOT (ex.x = x1 AND lo = hi)
    UNION ALL SELECT ex.g, ex.x, hi, 1 FROM ex JOIN en USING (g) LEFT JOIN bad USING (g, x) WHERE NOT coalesce(no_hi, false) AND NOT (ex.x = x0 AND lo = hi)),
  nu AS (SELECT g, x, y, row_number() OVER (PARTITION BY g ORDER BY part, CASE part WHEN 0 THEN x ELSE -x END) - 1 AS corner FROM pt)"""


@query("t16_hull_corners", f"{HULL} SELECT g AS l_returnflag, round(x, 6) AS l_quantity, round(y, 6) AS l_extendedprice, corner FROM nu UNION ALL SELECT g, round(x, 6), round(y, 6), (SELECT count(*) FROM nu m WHERE m.g = nu.g) FROM nu WHERE corner = 0")
def t16(spark, d):
    h = C.convex_hull(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rounded(h)


METRIC = ["max_amplitude", "avg_amplitude", "wavelength", "worm_length", "wave_number", "normalized_wavelength"]
POSTURE = f"""WITH {CURV}, {PEAK}, {OFFS.replace(I.CURVE_POINTS_SQL + ', ', '')}, {CLASS.replace('0.85', '0.98')},
  st AS (SELECT *, coalesce(sqrt((y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2), 0) AS d FROM curve_points WINDOW w AS (PARTITION BY {VF} ORDER BY pos)), ln AS (SELECT {VF}, sum(d) AS len FROM st GROUP BY {VF}),
  wl AS (SELECT cl.video_id, cl.frame, shape, len, CASE shape WHEN 'C-shape' THEN 2 * len WHEN 'Straight' THEN 4 * len WHEN 'S-shape' THEN CASE WHEN n > 1 THEN 2.0 * (z - a) / (n - 1) ELSE 0 END ELSE 0 END AS w FROM cl JOIN ln USING ({VF}) LEFT JOIN pk USING ({VF})),
  am AS (SELECT {VF}, max(d) AS max_amplitude, avg(d) AS avg_amplitude FROM off GROUP BY {VF}), mc AS (SELECT {VF}, avg(c) AS mean_curvature FROM cv GROUP BY {VF}),
  fq AS (SELECT {VF}, k, round(sqrt(sum(c * cos(2 * pi() * k * i / 32)) ** 2 + sum(c * sin(2 * pi() * k * i / 32)) ** 2), 9) AS m FROM cv, range(1, 17) r(k) GROUP BY {VF}, k), sq AS (SELECT {VF}, arg_max(k, {{'m': m, 'k': -k}}) / 32.0 AS dominant_spatial_freq FROM fq GROUP BY {VF}),
  base AS (SELECT video_id, frame, shape, max_amplitude, avg_amplitude, len AS worm_length, w AS wavelength, CASE WHEN w <> 0 THEN len / w END AS wave_number, w / len AS normalized_wavelength, dominant_spatial_freq, mean_curvature,
    count(*) OVER v AS n, (mean_curvature - avg(mean_curvature) OVER v) / stddev_pop(mean_curvature) OVER v AS z FROM wl JOIN am USING ({VF}) JOIN mc USING ({VF}) JOIN sq USING ({VF}) WINDOW v AS (PARTITION BY video_id)),
  sg AS (SELECT DISTINCT video_id, n, s FROM base, range(0, 1000) r(s) WHERE s * 10 < n), sv AS (SELECT g.video_id, g.n, s, o, z AS v FROM (SELECT * FROM sg, range(20) r(o)) g JOIN base ON base.video_id = g.video_id AND base.frame = least(g.n - 1, s * 10 + o)),
  sd AS (SELECT *, (v - avg(v) OVER (PARTITION BY video_id, s)) * (0.5 - 0.5 * cos(2 * pi() * o / 20)) AS w FROM sv),
  ps AS (SELECT video_id, n, s, k, (sum(w * cos(2 * pi() * k * o / 20)) ** 2 + sum(w * sin(2 * pi() * k * o / 20)) ** 2) / 75.0 * CASE WHEN k IN (0, 10) THEN 1 ELSE 2 END AS p FROM sd, range(11) r(k) GROUP BY video_id, n, s, k),
  pm AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b, max(p) OVER (PARTITION BY video_id, s) AS mx FROM ps WINDOW w AS (PARTITION BY video_id, s ORDER BY k)),
  dm AS (SELECT video_id, n, s, coalesce(arg_max(k, p) FILTER (p > a AND p > b AND p >= 0.1 * mx), 0) / 2.0 AS f FROM pm WHERE s * 10 < n - 20 GROUP BY video_id, n, s),
  l AS (SELECT video_id, frame, least(frame // 10, (SELECT max(s) FROM dm WHERE dm.video_id = base.video_id)) AS s FROM base),
  fr AS (SELECT l.video_id, l.frame, CASE WHEN b.f IS NULL THEN a.f ELSE a.f + (b.f - a.f) * (l.frame - l.s * 10) / 10.0 END AS frequency FROM l LEFT JOIN dm a ON a.video_id = l.video_id AND a.s = l.s LEFT JOIN dm b ON b.video_id = l.video_id AND b.s = l.s + 1),
  {GRAM}, c0 AS (SELECT video_id, frame, n, greatest(5, least(frame, n - 6)) AS mid FROM base),
  sm AS (SELECT c0.video_id, c0.frame, {", ".join(f"sum(hat.w * b.{m}) AS {m}_smooth" for m in METRIC)} FROM c0 JOIN base b ON b.video_id = c0.video_id AND abs(b.frame - c0.mid) <= 5 JOIN hat ON hat.t = c0.frame - c0.mid AND hat.s = b.frame - c0.mid WHERE c0.n >= 11 GROUP BY 1, 2)"""


@query("t2_posture_series", f"{POSTURE} SELECT {VF}, shape, dominant_spatial_freq, {', '.join(f'round({m}, 6) AS {m}, round({m}_smooth, 6) AS {m}_smooth' for m in METRIC)}, round(mean_curvature, 6) AS mean_curvature, round(z, 6) AS curvature_time_series, round(frequency, 6) AS frequency FROM base JOIN fr USING ({VF}) LEFT JOIN sm USING ({VF})")
def t2(spark, d):
    return rounded(SH.posture_series(I.curves(spark, d), ["video_id"], "frame", 10.0, 2.0, 1.0, window=9, threshold=1.5))


ANGLES = f"""{HEAD}, {SMOOTH.replace(PTS + ', ', '')}, bd AS (SELECT video_id, frame, arg_max(i, {{'c': c, 'i': -i}}) AS i, max(c) AS c FROM hcv GROUP BY 1, 2),
  be AS (SELECT bd.video_id, bd.frame, bd.i / 100.0 AS l, c AS m, y, x FROM bd JOIN rs ON rs.video_id = bd.video_id AND rs.frame = bd.frame AND rs.k = bd.i),
  z0 AS (SELECT hp.video_id, hp.frame, a FROM hp LEFT JOIN hx_ USING ({VF})),
  z1 AS (SELECT *, last_value(CASE WHEN a IS NOT NULL THEN {{'f': frame, 'a': a}} END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    first_value(CASE WHEN a IS NOT NULL THEN {{'f': frame, 'a': a}} END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM z0),
  z2 AS (SELECT video_id, frame, CASE WHEN a IS NOT NULL THEN a WHEN p IS NOT NULL AND q IS NOT NULL THEN p.a * (1 - (frame - p.f) / (q.f - p.f)) + q.a * ((frame - p.f) / (q.f - p.f)) WHEN p IS NOT NULL THEN p.a * 0.9 ** (frame - p.f) WHEN q IS NOT NULL THEN q.a * 0.9 ** (q.f - frame) ELSE 0 END AS v FROM z1),
  z3 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM z2),
  z4 AS (SELECT *, avg(v) OVER b AS mb, stddev_pop(v) OVER b AS sb, avg(v) OVER a AS ma, stddev_pop(v) OVER a AS sa FROM z3
    WINDOW b AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
  z5 AS (SELECT *, CASE WHEN i = 0 THEN CASE WHEN n > 3 AND abs(v - ma) > 50 AND sa < 10 THEN ma END WHEN i = n - 1 THEN CASE WHEN abs(v - mb) > 50 AND sb < 10 THEN mb END
    WHEN abs(v - mb) > 50 AND abs(v - ma) > 50 AND sb < 10 AND sa < 10 THEN (mb / (sb + 1e-6) + ma / (sa + 1e-6)) / (1 / (sb + 1e-6) + 1 / (sa + 1e-6)) END AS x FROM z4),
  z6 AS (SELECT *, lag(w) OVER o AS prev, avg(w) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w3 FROM (SELECT *, coalesce(x, v) AS w FROM z5) q WINDOW o AS (PARTITION BY video_id ORDER BY i)),
  pc AS (SELECT z6.video_id, z6.frame, arg_max(hb.a, {{'s': abs(hb.a), 'h': -h}}) AS a, arg_max(hm, {{'s': abs(hb.a), 'h': -h}}) AS hm, arg_max(bm, {{'s': abs(hb.a), 'h': -h}}) AS bm FROM z6 JOIN hb USING ({VF}) WHERE hb.a <> 0 AND (prev IS NULL OR abs(hb.a - prev) <= 25) GROUP BY 1, 2),
  an AS (SELECT z6.*, pc.a, hm, bm, l, m, be.y AS by_, be.x AS bx, abs(w) <= 3 OR abs(coalesce(pc.a, prev, 0)) <= 3 AS flat FROM z6 JOIN be USING ({VF}) LEFT JOIN pc USING ({VF}))"""


@query("t1_head_angle_series", f"""{ANGLES} SELECT {VF}, round(w, 5) AS angle_degrees, round(CASE WHEN flat THEN 0 ELSE l END, 5) AS bend_location, round(CASE WHEN flat THEN 0 ELSE m END, 5) AS bend_magnitude, round(CASE WHEN flat THEN 0 ELSE by_ END, 5) AS bend_position_y,
  round(CASE WHEN flat THEN 0 ELSE bx END, 5) AS bend_position_x, round(coalesce(hm, 0), 5) AS head_mag, round(coalesce(bm, 0), 5) AS body_mag, x IS NOT NULL AS is_noise_peak, round(CASE WHEN x IS NULL THEN 0 ELSE abs(v - x) END, 5) AS peak_deviation,
  CAST(CASE WHEN x IS NULL THEN 0 WHEN i < 3 THEN i WHEN i >= n - 3 THEN n - i - 1 ELSE 3 END AS BIGINT) AS window_size_used, abs(w) <= 3 AS is_straight, CASE WHEN a IS NULL THEN 'No valid angle found with current parameters' END AS error, a IS NULL AS has_warning, round(w3, 5) AS angle_degrees_smoothed_3frame FROM an""")
def t1(spark, d):
    return rounded(SH.head_angles(I.curves(spark, d), ["video_id"], "frame"), 5)
