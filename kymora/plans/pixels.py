"""Mask and pixel operators on frames tiled from the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.operators import masks as M
from kymora.operators import ordered as O
from kymora.plans import inputs as I
from kymora.plans.registry import query, rounded, table

MK = "video_id, frame::BIGINT AS frame, object_id::BIGINT AS object_id"
MKG = "video_id, frame, object_id"
WITH = f"WITH {I.MASKS_SQL}"

# Sparse masks for distance work: object 3 bright spots, object 4 dark spots.
SPARSE_SQL = f"""WITH {I.PIXELS_SQL}, sparse AS (SELECT video_id, frame, 3 AS object_id, y, x FROM frame_pixels WHERE intensity > 0.24
  UNION ALL SELECT video_id, frame, 4, y, x FROM frame_pixels WHERE intensity < -0.24)"""


def sparse(spark, d):
    v = F.col("intensity")
    kind = F.when(v > 0.24, 3).when(v < -0.24, 4)
    p = I.frame_pixels(spark, d).withColumn("object_id", kind)
    return p.filter("object_id IS NOT NULL").select(*M.MASK, *M.POS)


def sparse_index(spark, d):
    return I.mask_index(spark, d).filter("object_id > 2")


@query("a25_mask_geometry", f"""{WITH} SELECT {MK}, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, CAST(trunc(avg(y)) AS BIGINT) AS cy_int, CAST(trunc(avg(x)) AS BIGINT) AS cx_int,
  CAST(min(y) AS BIGINT) AS y0, CAST(min(x) AS BIGINT) AS x0, CAST(max(y) AS BIGINT) AS y1, CAST(max(x) AS BIGINT) AS x1, CAST((min(y) + max(y)) // 2 AS BIGINT) AS my, CAST((min(x) + max(x)) // 2 AS BIGINT) AS mx
  FROM mask_pixels GROUP BY {MKG}""")
def a25(spark, d):
    g = M.mask_geometry(I.mask_pixels(spark, d))
    return rounded(g.drop("major_axis", "minor_axis", "elongation", "theta", "orientation"))


MOM = f"""g AS (SELECT {MKG}, count(*) AS area, avg(x) AS cx, avg(y) AS cy, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(x, y) AS c FROM mask_pixels GROUP BY ALL),
  e AS (SELECT *, (vx + vy) / 2 AS h, sqrt(((vx - vy) / 2) ** 2 + c ** 2) AS r, CASE WHEN vx <> vy THEN 0.5 * atan2(2 * c, vx - vy) ELSE 0 END AS theta FROM g)"""


@query("a46_elongation", f"{WITH}, {MOM} SELECT {MK}, area, round(4 * sqrt(h + r), 5) AS major_axis, round(4 * sqrt(greatest(h - r, 0)), 5) AS minor_axis, round(CASE WHEN h - r > 1e-9 THEN sqrt(h + r) / sqrt(h - r) END, 5) AS elongation FROM e WHERE area > 5")
def a46(spark, d):
    g = M.mask_geometry(I.mask_pixels(spark, d)).filter("area > 5")
    return rounded(g.select(*M.MASK, "area", "major_axis", "minor_axis", "elongation"), 5)


@query("a47_orientation", f"{WITH}, {MOM} SELECT {MK}, round(degrees(theta), 4) AS orientation FROM e")
def a47(spark, d):
    return rounded(M.mask_geometry(I.mask_pixels(spark, d)).select(*M.MASK, "orientation"), 4)


@query("a26_intensity_stats", f"""{WITH}, j AS (SELECT m.*, intensity FROM mask_pixels m JOIN frame_pixels USING (video_id, frame, y, x)),
  r AS (SELECT {MKG}, round(intensity, 1) AS q, count(*) AS n FROM j GROUP BY ALL), md AS (SELECT {MKG}, arg_max(q, {{'n': n, 'q': -q}}) AS mode FROM r GROUP BY ALL),
  s AS (SELECT {MKG}, avg(round(intensity, 1)) AS mean, stddev_pop(round(intensity, 1)) AS std, quantile_cont(round(intensity, 1), 0.5) AS median, min(round(intensity, 1)) AS min, max(round(intensity, 1)) AS max, count(*) AS n FROM j GROUP BY ALL)
  SELECT i.video_id, i.frame::BIGINT AS frame, i.object_id::BIGINT AS object_id, round(mean, 8) AS mean, round(std, 8) AS std, round(median, 8) AS median, min, max, mode, coalesce(n, 0) AS pixel_count
  FROM mask_index i LEFT JOIN s USING ({MKG}) LEFT JOIN md USING ({MKG})""")
def a26(spark, d):
    values = I.frame_pixels(spark, d).withColumn("intensity", F.round("intensity", 1))
    return rounded(M.intensity_stats(I.mask_index(spark, d), I.mask_pixels(spark, d), values), 8)


@query("a27_top_share_means", f"""{WITH}, j AS (SELECT m.*, intensity, row_number() OVER (PARTITION BY {MKG} ORDER BY intensity DESC) AS rn, count(*) OVER (PARTITION BY {MKG}) AS n FROM mask_pixels m JOIN frame_pixels USING (video_id, frame, y, x))
  SELECT {MK}, """ + ", ".join(f"round(avg(intensity) FILTER (rn <= greatest(1, round_even(n * {s}, 0))), 6) AS top{p}" for p, s in ((25, 0.25), (10, 0.10), (1, 0.01))) + f" FROM j GROUP BY {MKG}")
def a27(spark, d):
    return rounded(M.top_share_mean(I.mask_pixels(spark, d), I.frame_pixels(spark, d), "intensity", {"top25": 0.25, "top10": 0.10, "top1": 0.01}))


# Multipliers of the sampling order that SQL can repeat.
RANK_SQL = "(y * 7919 + x * 104729) % 10007"


def _rank():
    return (F.col("y") * 7919 + F.col("x") * 104729) % 10007


BG = f"""m4 AS (SELECT * FROM mask_pixels),
  bg AS (SELECT * FROM frame_pixels p WHERE NOT EXISTS (SELECT 1 FROM m4 WHERE m4.video_id = p.video_id AND m4.frame = p.frame AND (m4.y - p.y) ** 2 + (m4.x - p.x) ** 2 < 1.44)),
  lvl AS (SELECT video_id, frame, avg(intensity) AS b FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY {RANK_SQL}, y, x) AS rn FROM bg) WHERE rn <= 5 GROUP BY 1, 2)"""


@query("a28_background_level", f"{WITH}, {BG} SELECT video_id, frame::BIGINT AS frame, round(b, 6) AS background_intensity FROM lvl")
def a28(spark, d):
    return rounded(M.background_level(I.mask_index(spark, d), I.mask_pixels(spark, d), I.frame_pixels(spark, d), ["intensity"], 1.2, 5, _rank()))


@query("a29_background_corrected", f"""{WITH}, {BG}, s AS (SELECT {MKG}, avg(intensity) AS m, count(*) AS n FROM mask_pixels JOIN frame_pixels USING (video_id, frame, y, x) GROUP BY ALL)
  SELECT i.video_id, i.frame::BIGINT AS frame, i.object_id::BIGINT AS object_id, round(m - b, 6) AS mean_bg_corrected, coalesce(n, 0) AS pixel_count FROM mask_index i LEFT JOIN s USING ({MKG}) LEFT JOIN lvl USING (video_id, frame)""")
def a29(spark, d):
    px, index, values = I.mask_pixels(spark, d), I.mask_index(spark, d), I.frame_pixels(spark, d)
    bg = M.background_level(index, px, values, ["intensity"], 1.2, 5, _rank())
    out = M.background_corrected(M.intensity_stats(index, px, values), bg)
    return rounded(out.select(*M.MASK, "mean_bg_corrected", "pixel_count"))


@query("a30_colour_features", f"""WITH {I.PIXELS_SQL}, c AS (SELECT *, round(intensity + 1.0, 3) AS r, round(intensity * intensity + 1.0, 3) AS g, round(1.5 - intensity, 3) AS b FROM frame_pixels),
  mask_pixels AS (SELECT video_id, frame, 1 AS object_id, y, x FROM frame_pixels WHERE abs(intensity) > 0.17),
  bg AS (SELECT * FROM c p WHERE y BETWEEN 2 AND 13 AND x BETWEEN 2 AND 13 AND NOT EXISTS (SELECT 1 FROM mask_pixels m WHERE m.video_id = p.video_id AND m.frame = p.frame AND (m.y - p.y) ** 2 + (m.x - p.x) ** 2 < 4)),
  lvl AS (SELECT video_id, frame, avg(r) AS br, avg(g) AS bgg, avg(b) AS bb FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY {RANK_SQL}, y, x) AS rn FROM bg) WHERE rn <= 5 GROUP BY 1, 2),
  red AS (SELECT m.video_id, m.frame, m.object_id, (r / br - (g / bgg + b / bb) / 2) / (r / br) AS v FROM mask_pixels m JOIN c USING (video_id, frame, y, x) JOIN lvl USING (video_id, frame))
  SELECT {MK}, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std FROM red GROUP BY {MKG}""")
def a30(spark, d):
    v = F.col("intensity")
    values = I.frame_pixels(spark, d).withColumns({"r": F.round(v + 1.0, 3), "g": F.round(v * v + 1.0, 3), "b": F.round(1.5 - v, 3)})
    px = I.frame_pixels(spark, d).filter(F.abs(v) > 0.17).select(*M.FRAME, F.lit(1).alias("object_id"), *M.POS)
    bg = M.background_level(I.mask_index(spark, d), px, values, ["r", "g", "b"], 2.0, 5, _rank(), margin=2)
    return rounded(M.colour_features(px, values, bg))


@query("a31_body_side", f"""{WITH}, f AS (SELECT video_id, min(frame) AS frame FROM mask_index GROUP BY 1),
  c AS (SELECT video_id, avg(x) FILTER (object_id = 4) AS a, avg(x) FILTER (object_id = 2) AS b FROM mask_pixels JOIN f USING (video_id, frame) GROUP BY 1)
  SELECT f.video_id, CASE WHEN a IS NULL OR b IS NULL THEN 'object missing in first frame' WHEN a < b THEN 'left' ELSE 'right' END AS side_position FROM f LEFT JOIN c USING (video_id)""")
def a31(spark, d):
    return M.body_side(I.mask_pixels(spark, d), I.mask_index(spark, d))


OVER = f"""ov AS (SELECT a.video_id, a.frame, a.object_id AS a, b.object_id AS b, count(*) AS n FROM mask_pixels a JOIN mask_pixels b USING (video_id, frame, y, x) WHERE a.object_id < b.object_id GROUP BY ALL),
  ar AS (SELECT {MKG}, count(*) AS area FROM mask_pixels GROUP BY ALL)"""


@query("j12_overlap_pairs", f"""{WITH}, {OVER} SELECT ov.video_id, ov.frame::BIGINT AS frame, a::BIGINT AS a, b::BIGINT AS b, n, x.area AS area_a, z.area AS area_b, round(n / (x.area + z.area - n), 6) AS iou
  FROM ov JOIN ar x ON x.video_id = ov.video_id AND x.frame = ov.frame AND x.object_id = a JOIN ar z ON z.video_id = ov.video_id AND z.frame = ov.frame AND z.object_id = b""")
def j12(spark, d):
    return rounded(M.overlap_pairs(I.mask_pixels(spark, d)))


@query("j14_distant_pairs", f"""{SPARSE_SQL}, b AS (SELECT video_id, frame FROM sparse GROUP BY 1, 2 HAVING count(DISTINCT object_id) = 2)
  SELECT video_id, frame::BIGINT AS frame FROM b WHERE NOT EXISTS (SELECT 1 FROM sparse p JOIN sparse q ON p.video_id = q.video_id AND p.frame = q.frame WHERE p.object_id = 3 AND q.object_id = 4 AND p.video_id = b.video_id AND p.frame = b.frame AND abs(p.y - q.y) + abs(p.x - q.x) <= 2)""")
def j14(spark, d):
    return rounded(M.distant_pairs(sparse_index(spark, d), sparse(spark, d), 3, 4, 1))


def _pair(mine, theirs, dist):
    return f"""d{mine} AS (SELECT p.video_id, p.frame, p.object_id, p.y, p.x, min(CASE WHEN (p.y - q.y) ** 2 + (p.x - q.x) ** 2 < {dist * dist} THEN (p.y - q.y) ** 2 + (p.x - q.x) ** 2 END) AS d2
       FROM sparse p LEFT JOIN sparse q ON q.video_id = p.video_id AND q.frame = p.frame AND q.object_id = {theirs} WHERE p.object_id = {mine} GROUP BY ALL),
     r{mine} AS (SELECT *, count(*) FILTER (d2 IS NULL) OVER w AS kept, row_number() OVER (PARTITION BY {MKG} ORDER BY coalesce(d2, 1e9) DESC) AS rn FROM d{mine} WINDOW w AS (PARTITION BY {MKG})),
     l{mine} AS (SELECT *, min(CASE WHEN rn <= 4 THEN coalesce(d2, 1e9) END) OVER (PARTITION BY {MKG}) AS lim FROM r{mine})"""


@query("j15_separate_pair", f"{SPARSE_SQL}, {_pair(3, 4, 3)}, {_pair(4, 3, 3)} " + " UNION ALL ".join(
    f"SELECT {MK}, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM l{i} WHERE CASE WHEN kept >= 4 THEN d2 IS NULL ELSE coalesce(d2, 1e9) >= lim END" for i in (3, 4)))
def j15(spark, d):
    return rounded(M.separate_pair(sparse(spark, d), 3, 4, 3.0, 4))


MOVE = f"""rk AS (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM (SELECT DISTINCT video_id, frame FROM mask_index)),
  p AS (SELECT m.*, r FROM mask_pixels m JOIN rk USING (video_id, frame)), ar AS (SELECT video_id, r, object_id, count(*) AS area FROM p GROUP BY ALL),
  o AS (SELECT a.video_id, a.r, a.object_id, b.r - a.r AS k, count(*) AS c FROM p a JOIN p b ON a.video_id = b.video_id AND a.object_id = b.object_id AND a.y = b.y AND a.x = b.x AND abs(a.r - b.r) BETWEEN 1 AND 3 GROUP BY ALL),
  s AS (SELECT i.video_id, i.frame, i.object_id, ar.area, """ + ", ".join(
    f"CASE WHEN rk.r + ({k}) BETWEEN 1 AND rk.n THEN coalesce((SELECT c FROM o WHERE o.video_id = i.video_id AND o.r = rk.r AND o.object_id = i.object_id AND o.k = {k}), 0) / ar.area END AS {n}"
    for k, n in ((-3, "prev3"), (-2, "prev2"), (-1, "prev1"), (1, "next1"), (2, "next2"), (3, "next3"))
) + """ FROM mask_index i JOIN rk USING (video_id, frame) LEFT JOIN ar ON ar.video_id = i.video_id AND ar.r = rk.r AND ar.object_id = i.object_id),
  mv AS (SELECT *, area IS NULL AS is_empty, CASE WHEN area IS NULL THEN false WHEN object_id = 2 THEN coalesce(least(prev3, prev2, prev1, next1, next2, next3) >= 0.1, true)
     ELSE coalesce(prev1 >= 0.25, true) AND coalesce(next1 >= 0.25, true) AND (prev3 IS NULL OR least(prev3, prev2, prev1) >= 0.1) AND (next3 IS NULL OR least(next3, next2, next1) >= 0.1) END AS passes,
     CASE WHEN area IS NULL THEN false ELSE coalesce(least(prev3, prev2, prev1, next1, next2, next3) = 0, false) END AS has_zero FROM s)"""


@query("j16_local_movement", f"{WITH}, {MOVE} SELECT {MK}, is_empty, passes, has_zero, " + ", ".join(f"round({n}, 6) AS {n}" for n in ("prev3", "prev2", "prev1", "next1", "next2", "next3")) + " FROM mv")
def j16(spark, d):
    return rounded(M.local_movement(I.mask_index(spark, d), I.mask_pixels(spark, d)))


@query("a34_movement_summary", f"{WITH}, {MOVE} SELECT video_id, object_id::BIGINT AS object_id, count(*) AS total_frames, count(*) FILTER (passes) AS passing, count(*) FILTER (is_empty) AS empty, count(*) FILTER (NOT is_empty AND NOT passes) AS failing, count(*) FILTER (NOT is_empty AND NOT passes AND has_zero) AS zero_overlap FROM mv GROUP BY 1, 2")
def a34(spark, d):
    return rounded(M.movement_summary(M.local_movement(I.mask_index(spark, d), I.mask_pixels(spark, d))))


# Whole masks in frames with a margin of 4 pixels below and to the right, in which templates can shift both ways.
ALIGN = f"""g AS (SELECT {MKG}, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM mask_pixels GROUP BY ALL),
  t AS (SELECT video_id, object_id, arg_max({{'f': frame, 'cy': cy, 'cx': cx, 'y0': y0, 'x0': x0, 'y1': y1, 'x1': x1}}, {{'a': area, 'f': -frame}}) AS t FROM g GROUP BY 1, 2),
  c AS (SELECT g.video_id, g.frame, g.object_id, t.t, dy, dx, CAST(trunc(g.cy - t.t.cy) AS BIGINT) + dy AS sy, CAST(trunc(g.cx - t.t.cx) AS BIGINT) + dx AS sx, g.cy - t.t.cy AS fy, g.cx - t.t.cx AS fx FROM g JOIN t USING (video_id, object_id), range(-2, 3) a(dy), range(-2, 3) b(dx)),
  s AS (SELECT *, row_number() OVER (PARTITION BY {MKG} ORDER BY round((sy - fy) ** 2 + (sx - fx) ** 2, 9), dy, dx) AS rn FROM c WHERE t.y0 + sy >= 0 AND t.x0 + sx >= 0 AND t.y1 + sy < 20 AND t.x1 + sx < 20),
  aligned AS (SELECT s.video_id, s.frame, s.object_id, p.y + sy AS y, p.x + sx AS x FROM s JOIN mask_pixels p ON p.video_id = s.video_id AND p.object_id = s.object_id AND p.frame = s.t.f WHERE rn = 1)"""


def _wide(spark, d):
    return I.mask_index(spark, d).withColumns({"height": F.lit(20), "width": F.lit(20)})


@query("j17_align_template", f"{WITH}, {ALIGN} SELECT {MK}, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM aligned")
def j17(spark, d):
    return rounded(M.align_template(_wide(spark, d), I.mask_pixels(spark, d)))


def _chain():
    parts, src = [], "aligned"
    for n, (a, b) in enumerate(((2, 3), (2, 4), (3, 4))):
        parts.append(f"""i{n} AS (SELECT *, row_number() OVER (PARTITION BY {MKG} ORDER BY y, x) AS idx FROM {src}),
          h{n} AS (SELECT a.video_id, a.idx AS ia, b.idx AS ib FROM i{n} a JOIN i{n} b USING (video_id, frame, y, x) WHERE a.object_id = {a} AND b.object_id = {b}),
          k{n} AS (SELECT video_id, frame, object_id, y, x FROM i{n} z WHERE NOT EXISTS (SELECT 1 FROM h{n} h WHERE h.video_id = z.video_id AND ((z.object_id = {a} AND h.ia = z.idx) OR (z.object_id = {b} AND h.ib = z.idx))))""")
        src = f"k{n}"
    return ", ".join(parts)


@query("j18_relative_overlaps", f"{WITH}, {ALIGN}, {_chain()} SELECT {MK}, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM k2")
def j18(spark, d):
    aligned = M.align_template(_wide(spark, d), I.mask_pixels(spark, d))
    return rounded(M.remove_relative_overlaps(aligned, [(2, 3), (2, 4), (3, 4)]))


@query("j18_uneven_sizes", f"{WITH}, n AS (SELECT {MKG}, count(*) AS n FROM mask_pixels GROUP BY ALL) SELECT video_id, object_id::BIGINT AS object_id, min(n) AS smallest, max(n) AS largest FROM n GROUP BY 1, 2 HAVING min(n) <> max(n)")
def j18b(spark, d):
    return rounded(M.uneven_sizes(I.mask_pixels(spark, d)))


@query("w14_fill_missing_masks", f"""{WITH}, st AS (SELECT i.video_id, i.frame, i.object_id, count(p.y) AS area FROM mask_index i LEFT JOIN mask_pixels p USING ({MKG}) GROUP BY ALL),
  g AS (SELECT *, last_value(CASE WHEN area > 0 THEN frame END IGNORE NULLS) OVER (PARTITION BY video_id, object_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    first_value(CASE WHEN area > 0 THEN frame END IGNORE NULLS) OVER (PARTITION BY video_id, object_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM st),
  need AS (SELECT {MKG}, p AS sf, CASE WHEN n IS NULL THEN 1.0 ELSE (n - frame) / (n - p) END AS w FROM g WHERE area = 0 AND p IS NOT NULL UNION ALL SELECT {MKG}, n, CASE WHEN p IS NULL THEN 1.0 ELSE (frame - p) / (n - p) END FROM g WHERE area = 0 AND n IS NOT NULL),
  f AS (SELECT need.video_id, need.frame, need.object_id, m.y, m.x FROM need JOIN mask_pixels m ON m.video_id = need.video_id AND m.object_id = need.object_id AND m.frame = need.sf GROUP BY ALL HAVING sum(w) > 0.5)
  SELECT {MK}, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM (SELECT * FROM mask_pixels UNION ALL SELECT * FROM f)""")
def w14(spark, d):
    return rounded(M.fill_missing_masks(I.mask_index(spark, d), I.mask_pixels(spark, d), [2, 3, 4]))


CROP = f"""f AS (SELECT DISTINCT video_id, frame FROM mask_index), b AS (SELECT video_id, frame, (min(x) + max(x)) // 2 AS cx, (min(y) + max(y)) // 2 AS cy FROM mask_pixels WHERE object_id = 4 GROUP BY 1, 2),
  c AS (SELECT f.video_id, f.frame, b.cx IS NULL AS e, coalesce(b.cx, 8) AS cx, coalesce(b.cy, 8) AS cy FROM f LEFT JOIN b USING (video_id, frame)),
  m AS (SELECT video_id, frame, CASE WHEN bool_or(e) OVER w THEN CAST(sum(cx) OVER w AS BIGINT) // count(*) OVER w ELSE cx END AS cx, CASE WHEN bool_or(e) OVER w THEN CAST(sum(cy) OVER w AS BIGINT) // count(*) OVER w ELSE cy END AS cy FROM c WINDOW w AS (PARTITION BY video_id)),
  l AS (SELECT *, greatest(0, cx - 3) AS l0, greatest(0, cy - 3) AS t0 FROM m), r AS (SELECT *, least(16, l0 + 6) AS r0, least(16, t0 + 6) AS b0 FROM l)"""


@query("w16_crop_windows", f"{WITH}, {CROP} SELECT video_id, frame::BIGINT AS frame, CAST(CASE WHEN r0 = 16 THEN r0 - 6 ELSE l0 END AS BIGINT) AS x0, CAST(CASE WHEN b0 = 16 THEN b0 - 6 ELSE t0 END AS BIGINT) AS y0, CAST(r0 AS BIGINT) AS x1, CAST(b0 AS BIGINT) AS y1 FROM r")
def w16(spark, d):
    """The window follows object 4, which some frames do not show."""
    return rounded(M.crop_windows(I.mask_index(spark, d), I.mask_pixels(spark, d).filter("object_id = 4"), 6))


@query("a32_mask_problems", f"""{WITH}, {OVER}, z AS (SELECT i.*, coalesce(area, 0) AS area FROM mask_index i LEFT JOIN ar USING ({MKG})),
  k AS (SELECT video_id, frame, CASE WHEN area = 0 THEN 'empty' WHEN area >= 115 THEN 'high' WHEN area <= 60 THEN 'low' END AS category FROM z UNION ALL SELECT video_id, frame, 'overlapping' FROM ov),
  p AS (SELECT video_id, frame, category, count(*) AS n FROM k WHERE category IS NOT NULL GROUP BY ALL), b AS (SELECT video_id, count(DISTINCT frame) AS nb FROM p GROUP BY 1), t AS (SELECT video_id, count(DISTINCT frame) AS nt FROM mask_index GROUP BY 1)
  SELECT p.video_id, category, max(n) AS worst_n, CAST(arg_max(frame, {{'n': n, 'f': -frame}}) AS BIGINT) AS worst_frame, count(*) AS n_frames, round(100.0 * any_value(nb) / any_value(nt), 6) AS problem_share FROM p JOIN b USING (video_id) JOIN t USING (video_id) GROUP BY 1, 2""")
def a32(spark, d):
    index = I.mask_index(spark, d)
    problems = M.mask_problems(index, I.mask_pixels(spark, d), 115, 60, (3, 4), 10)
    return rounded(M.problem_summary(index, problems))


@query("a33_missing_and_empty", f"""{WITH}, ix AS (SELECT * REPLACE (CASE WHEN object_id = 3 AND frame % 5 = 1 THEN 13 ELSE object_id END AS object_id) FROM mask_index), a AS (SELECT {MKG}, count(*) AS area FROM mask_pixels GROUP BY ALL)
  SELECT w.video_id, w.frame::BIGINT AS frame, w.object_id::BIGINT AS object_id, CASE WHEN ix.height IS NULL THEN 'missing' ELSE 'empty' END AS state FROM mask_index w LEFT JOIN ix USING ({MKG}) LEFT JOIN a USING ({MKG}) WHERE ix.height IS NULL OR a.area IS NULL""")
def a33(spark, d):
    index = I.mask_index(spark, d)
    part = index.withColumn("object_id", F.when((F.col("object_id") == 3) & (F.col("frame") % 5 == 1), 13).otherwise(F.col("object_id")))
    return rounded(M.missing_and_empty(index.select(*M.FRAME).distinct(), part, I.mask_pixels(spark, d), [2, 3, 4]))


@query("a36_average_mask", f"""{WITH}, n AS (SELECT video_id, count(DISTINCT frame) AS n FROM mask_index GROUP BY 1)
  SELECT video_id, object_id::BIGINT AS object_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM mask_pixels JOIN n USING (video_id) GROUP BY ALL HAVING count(DISTINCT frame) / any_value(n.n) >= 0.4""".replace("GROUP BY ALL HAVING", "GROUP BY video_id, object_id, y, x HAVING"))
def a36(spark, d):
    return rounded(M.average_mask(I.mask_pixels(spark, d), I.mask_index(spark, d), 0.4))


@query("a37_extent_box", f"{WITH} SELECT video_id, object_id::BIGINT AS object_id, CAST(greatest(min(y) - 2, 0) AS BIGINT) AS y0, CAST(greatest(min(x) - 2, 0) AS BIGINT) AS x0, CAST(max(y) + 2 AS BIGINT) AS y1, CAST(max(x) + 2 AS BIGINT) AS x1 FROM mask_pixels GROUP BY video_id, object_id")
def a37(spark, d):
    return rounded(M.extent_box(I.mask_pixels(spark, d), ["video_id", "object_id"], 2))


BRIGHT = """q AS (SELECT video_id, frame, quantile_cont(intensity, 0.85) AS t FROM frame_pixels GROUP BY 1, 2),
  bc AS (SELECT video_id, frame, CAST(trunc(sum(x * intensity) / sum(intensity)) AS BIGINT) AS cx, CAST(trunc(sum(y * intensity) / sum(intensity)) AS BIGINT) AS cy FROM frame_pixels JOIN q USING (video_id, frame) WHERE intensity >= t GROUP BY 1, 2)"""


@query("a48_bright_centroid", f"WITH {I.PIXELS_SQL}, {BRIGHT} SELECT video_id, frame::BIGINT AS frame, cx, cy FROM bc")
def a48(spark, d):
    return rounded(M.bright_centroid(I.frame_pixels(spark, d)))


@query("a49_alignment_offsets", f"WITH {I.PIXELS_SQL}, {BRIGHT} SELECT video_id, frame::BIGINT AS frame, quantile_cont(cx, 0.5) OVER w - cx AS dx, quantile_cont(cy, 0.5) OVER w - cy AS dy FROM bc WINDOW w AS (PARTITION BY video_id)")
def a49(spark, d):
    return rounded(M.median_offsets(M.bright_centroid(I.frame_pixels(spark, d))))


@query("f34_rectification", f"""{WITH}, {MOM}, r AS (SELECT video_id, object_id, arg_min(cx, frame) AS rx, arg_min(cy, frame) AS ry, arg_min(theta, frame) AS rt FROM e GROUP BY 1, 2)
  SELECT {MK}, round(CASE WHEN area > 90 THEN greatest(-0.8, least(0.8, rx - cx)) ELSE 0 END, 5) AS dx, round(CASE WHEN area > 90 THEN greatest(-0.8, least(0.8, ry - cy)) ELSE 0 END, 5) AS dy,
   round(CASE WHEN area > 90 THEN greatest(-pi() / 8, least(pi() / 8, atan2(sin(rt - theta), cos(rt - theta)))) ELSE 0 END, 4) AS turn FROM e JOIN r USING (video_id, object_id)""")
def f34(spark, d):
    out = M.rectify(I.mask_pixels(spark, d), 90, 0.8)
    return rounded(out.withColumn("turn", F.round("turn", 4)), 5)


@query("f33_rescale_8bit", f"WITH {I.PIXELS_SQL}, b AS (SELECT *, min(intensity) OVER w AS lo, max(intensity) OVER w AS hi FROM frame_pixels WINDOW w AS (PARTITION BY video_id)) SELECT video_id, frame::BIGINT AS frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(trunc((intensity - lo) * 255 / (hi - lo)) AS BIGINT) AS level FROM b")
def f33(spark, d):
    out = M.rescale_8bit(I.frame_pixels(spark, d), ["video_id"], "intensity", "level")
    return rounded(out.select(*M.FRAME, *M.POS, "level"))


@query("a50_stability_score", f"WITH {I.PIXELS_SQL} SELECT video_id, frame::BIGINT AS frame, round(count(*) FILTER (intensity > 0.05 + 0.03) / count(*) FILTER (intensity > 0.05 - 0.03), 6) AS stability FROM frame_pixels GROUP BY 1, 2")
def a50(spark, d):
    return rounded(M.stability_score(I.frame_pixels(spark, d), M.FRAME, "intensity", 0.05, 0.03))


@query("a51_point_statistics", f"{WITH}, n AS (SELECT {MKG}, count(*) AS n FROM mask_pixels GROUP BY ALL) SELECT video_id, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, quantile_cont(n, 0.5) AS median FROM n GROUP BY 1")
def a51(spark, d):
    return rounded(M.point_statistics(I.mask_pixels(spark, d)))


# Connected components in SQL: spread the smallest pixel id by recursion.
def _cc(src, diag, name="cc"):
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if diag else "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    return f"""{name} AS (SELECT video_id, frame, object_id, y, x, min(root) AS component FROM (
       WITH RECURSIVE walk AS (SELECT {MKG}, y, x, y * 1048576 + x AS root FROM {src}
          UNION SELECT b.video_id, b.frame, b.object_id, b.y, b.x, a.root FROM walk a JOIN {src} b ON a.video_id = b.video_id AND a.frame = b.frame AND a.object_id = b.object_id AND {near}) SELECT * FROM walk) GROUP BY ALL)"""


def _cc2(src, diag, name="cc"):
    return _cc(src, diag, name).replace("GROUP BY ALL)", "GROUP BY video_id, frame, object_id, y, x)")


PXO = "CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x"


@query("t9_components_four", f"{WITH}, {_cc2('mask_pixels', False)} SELECT {MK}, {PXO}, CAST(component AS BIGINT) AS component FROM cc")
def t9(spark, d):
    """Tiles of five pixels, so that the joining of tiles is at work."""
    return rounded(M.components(I.mask_pixels(spark, d), M.MASK, False, 5))


@query("t9_components_eight", f"{SPARSE_SQL}, {_cc2('sparse', True)} SELECT {MK}, {PXO}, CAST(component AS BIGINT) AS component FROM cc")
def t9b(spark, d):
    return rounded(M.components(sparse(spark, d), M.MASK, True, 3))


SZ = "sz AS (SELECT video_id, frame, object_id, component, count(*) AS size FROM cc GROUP BY ALL)"
BEST = "best AS (SELECT video_id, frame, object_id, arg_max(component, {'s': size, 'c': -component}) AS component, max(size) AS top FROM sz GROUP BY ALL)"


@query("t10_keep_largest", f"{WITH}, {_cc2('mask_pixels', False)}, {SZ}, {BEST} SELECT {MK}, {PXO} FROM cc SEMI JOIN best USING (video_id, frame, object_id, component)")
def t10(spark, d):
    return rounded(M.keep_largest(I.mask_pixels(spark, d)))


@query("t10_keep_larger_than", f"{WITH}, {_cc2('mask_pixels', False)}, {SZ} SELECT {MK}, {PXO} FROM cc SEMI JOIN (SELECT * FROM sz WHERE size > 6) q USING (video_id, frame, object_id, component)")
def t10b(spark, d):
    return rounded(M.keep_larger_than(I.mask_pixels(spark, d), 6))


OUT = f"outside AS (SELECT i.video_id, i.frame, i.object_id, y, x FROM mask_index i, range(16) a(y), range(16) b(x) ANTI JOIN mask_pixels p USING (video_id, frame, object_id, y, x))".replace(
    "FROM mask_index i, range(16) a(y), range(16) b(x) ANTI JOIN", "FROM (SELECT * FROM mask_index, range(16) a(y), range(16) b(x)) i ANTI JOIN")


@query("t11_fill_small_holes", f"{WITH}, {OUT}, {_cc2('outside', True)}, {SZ} SELECT {MK}, {PXO} FROM (SELECT {MKG}, y, x FROM mask_pixels UNION ALL SELECT {MKG}, y, x FROM cc SEMI JOIN (SELECT * FROM sz WHERE size < 4) q USING (video_id, frame, object_id, component))")
def t11(spark, d):
    return rounded(M.fill_small_holes(I.mask_index(spark, d), I.mask_pixels(spark, d), 4))


@query("t11_drop_small_islands", f"{SPARSE_SQL}, {_cc2('sparse', True)}, {SZ}, {BEST} SELECT {MK}, {PXO} FROM cc SEMI JOIN (SELECT video_id, frame, object_id, component FROM sz WHERE size >= 3 UNION SELECT video_id, frame, object_id, component FROM best WHERE top < 3) q USING (video_id, frame, object_id, component)")
def t11b(spark, d):
    return rounded(M.drop_small_islands(sparse(spark, d), 3))


@query("t18_fill_score_holes", f"{WITH}, {OUT}, {_cc2('outside', True)}, {SZ} SELECT {MK}, {PXO} FROM (SELECT {MKG}, y, x FROM mask_pixels UNION ALL SELECT {MKG}, y, x FROM cc SEMI JOIN (SELECT * FROM sz WHERE size <= 2) q USING (video_id, frame, object_id, component))")
def t18(spark, d):
    return rounded(M.fill_small_holes(I.mask_index(spark, d), I.mask_pixels(spark, d), 2, inclusive=True))


@query("a35_component_statistics", f"{WITH}, {_cc2('mask_pixels', False)}, {SZ}, k AS (SELECT video_id, frame, object_id, count(*) AS k FROM sz GROUP BY ALL), dc AS (SELECT video_id, object_id, count(*) FILTER (k > 1) AS discontinuous_frames FROM k GROUP BY 1, 2) "
       "SELECT video_id, object_id::BIGINT AS object_id, round(avg(size), 6) AS mean, min(size) AS min, max(size) AS max, round(stddev_pop(size), 6) AS std, quantile_cont(size, 0.5) AS median, any_value(discontinuous_frames) AS discontinuous_frames FROM sz JOIN dc USING (video_id, object_id) GROUP BY 1, 2")
def a35(spark, d):
    return rounded(M.component_statistics(M.components(I.mask_pixels(spark, d))))


@query("t8_remove_shared", f"{WITH}, s AS (SELECT video_id, frame, y, x FROM mask_pixels GROUP BY ALL HAVING count(*) > 1) SELECT {MK}, {PXO} FROM mask_pixels ANTI JOIN s USING (video_id, frame, y, x)".replace("GROUP BY ALL HAVING", "GROUP BY video_id, frame, y, x HAVING"))
def t8(spark, d):
    return rounded(M.remove_shared(I.mask_pixels(spark, d)))


CLEAN = f"""{SPARSE_SQL.replace('sparse AS', 'dots AS')}, {_cc2('dots', False)}, {SZ}, {BEST}, lg AS (SELECT {MKG}, y, x FROM cc SEMI JOIN best USING (video_id, frame, object_id, component)),
  sparse AS (SELECT * FROM lg), {_pair(3, 4, 3)}, {_pair(4, 3, 3)}, fin AS (""" + " UNION ALL ".join(f"SELECT {MKG}, y, x FROM l{i} WHERE CASE WHEN kept >= 4 THEN d2 IS NULL ELSE coalesce(d2, 1e9) >= lim END" for i in (3, 4)) + """),
  al AS (SELECT *, 'input' AS step FROM (SELECT video_id, frame, object_id FROM dots) UNION ALL SELECT video_id, frame, object_id, 'largest' FROM lg UNION ALL SELECT video_id, frame, object_id, 'unshared' FROM lg UNION ALL SELECT video_id, frame, object_id, 'separated' FROM fin)"""


@query("t12_clean_masks_audit", f"{CLEAN} SELECT {MK}, " + ", ".join(f"count(*) FILTER (step = '{s}') AS {s}" for s in ("input", "largest", "unshared", "separated")) + f" FROM al GROUP BY {MKG}")
def t12(spark, d):
    return rounded(M.clean_masks(sparse(spark, d), (3, 4), 3.0, 4)[1])


@query("t13_boundary", f"""{WITH}, g AS (SELECT i.video_id, i.frame, i.object_id, gy AS y, gx AS x FROM mask_index i, range(16) a(gy), range(16) b(gx)),
  v AS (SELECT g.*, c.y IS NOT NULL AS c, e.y IS NOT NULL AS e, s.y IS NOT NULL AS s, q.y IS NOT NULL AS q FROM g """ + " ".join(
    f"LEFT JOIN mask_pixels {n} ON {n}.video_id = g.video_id AND {n}.frame = g.frame AND {n}.object_id = g.object_id AND {n}.y = g.y + {dy} AND {n}.x = g.x + {dx}" for n, dy, dx in (("c", 0, 0), ("e", 0, 1), ("s", 1, 0), ("q", 1, 1))) +
  f""") SELECT {MK}, {PXO} FROM v WHERE CASE WHEN y = 15 AND x = 15 THEN false WHEN y = 15 THEN c <> e WHEN x = 15 THEN c <> s ELSE c <> e OR c <> s OR c <> q END""")
def t13(spark, d):
    return rounded(M.boundary(I.mask_pixels(spark, d), I.mask_index(spark, d)))


@query("t17_label_map", f"{WITH} SELECT video_id, frame::BIGINT AS frame, {PXO}, min(object_id)::BIGINT AS object_id FROM mask_pixels GROUP BY video_id, frame, y, x")
def t17(spark, d):
    return rounded(M.label_map(I.mask_pixels(spark, d)))


@query("t4_truncate_top", f"{WITH} SELECT {MK}, {PXO} FROM (SELECT *, min(y) OVER (PARTITION BY {MKG}) AS t FROM mask_pixels) WHERE y <= t + 6")
def t4(spark, d):
    return rounded(M.truncate_top(I.mask_pixels(spark, d), 6))


@query("t4_trim_bottom", f"{WITH} SELECT {MK}, {PXO} FROM (SELECT *, min(y) OVER (PARTITION BY {MKG}) AS t, max(y) OVER (PARTITION BY {MKG}) AS b FROM mask_pixels) WHERE y < b - least(10, floor((b - t) * 0.1))")
def t4b(spark, d):
    return rounded(M.trim_bottom(I.mask_pixels(spark, d)))


@query("t7_skeleton_nodes", f"{SPARSE_SQL}, n AS (SELECT a.video_id, a.frame, a.object_id, a.y, a.x, count(b.y) AS n FROM sparse a LEFT JOIN sparse b ON a.video_id = b.video_id AND a.frame = b.frame AND a.object_id = b.object_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY ALL) SELECT {MK}, {PXO}, CASE WHEN n = 1 THEN 'endpoint' ELSE 'junction' END AS kind FROM n WHERE n = 1 OR n > 2")
def t7(spark, d):
    return rounded(M.skeleton_nodes(sparse(spark, d)))


RLE = f"""p AS (SELECT {MKG}, x * 16 + y AS p, row_number() OVER (PARTITION BY {MKG} ORDER BY x * 16 + y) AS rn FROM mask_pixels), r AS (SELECT {MKG}, min(p) AS s, count(*) AS n FROM p GROUP BY {MKG}, p - rn),
  q AS (SELECT *, s - coalesce(lag(s + n) OVER (PARTITION BY {MKG} ORDER BY s), 0) AS gap FROM r), agg AS (SELECT {MKG}, flatten(list([CAST(gap AS BIGINT), n] ORDER BY s)) AS c, max(s + n) AS e FROM q GROUP BY {MKG})"""


@query("f31_run_lengths", f"{WITH}, {RLE} SELECT i.video_id, i.frame::BIGINT AS frame, i.object_id::BIGINT AS object_id, CASE WHEN c IS NULL THEN [256] WHEN e < 256 THEN list_append(c, CAST(256 - e AS BIGINT)) ELSE c END AS counts FROM mask_index i LEFT JOIN agg USING ({MKG})")
def f31(spark, d):
    return rounded(M.run_lengths(I.mask_index(spark, d), I.mask_pixels(spark, d)).drop("size"))


@query("f31_pixels_of_runs", f"{WITH} SELECT {MK}, {PXO} FROM mask_pixels")
def f31b(spark, d):
    return rounded(M.pixels_of_runs(M.run_lengths(I.mask_index(spark, d), I.mask_pixels(spark, d))))


@query("f31_area_of_runs", f"{WITH} SELECT i.video_id, i.frame::BIGINT AS frame, i.object_id::BIGINT AS object_id, count(p.y) AS area FROM mask_index i LEFT JOIN mask_pixels p USING ({MKG}) GROUP BY i.video_id, i.frame, i.object_id")
def f31c(spark, d):
    r = M.run_lengths(I.mask_index(spark, d), I.mask_pixels(spark, d))
    return rounded(r.select(*M.MASK, M.area_of_runs(F.col("counts")).alias("area")))


def _bd(src, out):
    return f"""g{out} AS (SELECT f.video_id, f.frame, o.object_id, gy AS y, gx AS x FROM fr f, (VALUES (2), (3), (4)) o(object_id), range(16) a(gy), range(16) b(gx)),
      v{out} AS (SELECT g.*, c.y IS NOT NULL AS c, e.y IS NOT NULL AS e, s.y IS NOT NULL AS s, q.y IS NOT NULL AS q FROM g{out} g """ + " ".join(
        f"LEFT JOIN {src} {n} ON {n}.video_id = g.video_id AND {n}.frame = g.frame AND {n}.object_id = g.object_id AND {n}.y = g.y + {dy} AND {n}.x = g.x + {dx}" for n, dy, dx in (("c", 0, 0), ("e", 0, 1), ("s", 1, 0), ("q", 1, 1))) + f"""),
      {out} AS (SELECT {MKG}, y, x FROM v{out} WHERE CASE WHEN y = 15 AND x = 15 THEN false WHEN y = 15 THEN c <> e WHEN x = 15 THEN c <> s ELSE c <> e OR c <> s OR c <> q END)"""


SCORE = f"""{WITH}, fr AS (SELECT DISTINCT video_id, frame FROM (SELECT *, min(frame) OVER w AS f0, max(frame) OVER w AS f1 FROM mask_index WINDOW w AS (PARTITION BY video_id)) WHERE frame > f0 AND frame < f1),
  tr AS (SELECT * FROM mask_pixels SEMI JOIN fr USING (video_id, frame)), pr AS (SELECT * FROM (SELECT video_id, CASE WHEN frame % 6 = 2 THEN frame + 1000 ELSE frame END AS frame, object_id, y, (x + 1) % 16 AS x FROM mask_pixels) SEMI JOIN fr USING (video_id, frame)),
  sn AS (SELECT video_id, object_id, min(frame) AS f, max(g) AS g FROM (SELECT *, 1 AS g FROM tr UNION ALL SELECT *, 0 FROM pr) GROUP BY 1, 2),
  grid AS (SELECT fr.video_id, fr.frame, sn.object_id FROM fr JOIN sn ON sn.video_id = fr.video_id AND fr.frame >= sn.f AND sn.g = 1),
  cell AS (SELECT {MKG}, y, x, max(g) AS g, max(m) AS m FROM (SELECT *, 1 AS g, 0 AS m FROM tr UNION ALL SELECT *, 0, 1 FROM pr) GROUP BY {MKG}, y, x), sm AS (SELECT {MKG}, sum(g * m) AS i, count(*) AS u FROM cell GROUP BY {MKG}),
  {_bd('tr', 'bt')}, {_bd('pr', 'bp')},
  mt AS (SELECT bt.video_id, bt.frame, bt.object_id, count(DISTINCT bt.y * 100 + bt.x) AS k FROM bt JOIN bp ON bt.video_id = bp.video_id AND bt.frame = bp.frame AND bt.object_id = bp.object_id AND (bt.y - bp.y) ** 2 + (bt.x - bp.x) ** 2 <= 1 GROUP BY 1, 2, 3),
  mp AS (SELECT bp.video_id, bp.frame, bp.object_id, count(DISTINCT bp.y * 100 + bp.x) AS k FROM bp JOIN bt ON bt.video_id = bp.video_id AND bt.frame = bp.frame AND bt.object_id = bp.object_id AND (bt.y - bp.y) ** 2 + (bt.x - bp.x) ** 2 <= 1 GROUP BY 1, 2, 3),
  nt AS (SELECT {MKG}, count(*) AS n FROM bt GROUP BY {MKG}), np AS (SELECT {MKG}, count(*) AS n FROM bp GROUP BY {MKG}),
  pr2 AS (SELECT grid.*, CASE WHEN u IS NULL THEN 1.0 ELSE i / u END AS iou, CASE WHEN np.n IS NULL THEN 1.0 WHEN nt.n IS NULL THEN 0.0 ELSE coalesce(mp.k, 0) / np.n END AS p, CASE WHEN nt.n IS NULL THEN 1.0 WHEN np.n IS NULL THEN 0.0 ELSE coalesce(mt.k, 0) / nt.n END AS r
    FROM grid LEFT JOIN sm USING ({MKG}) LEFT JOIN nt USING ({MKG}) LEFT JOIN np USING ({MKG}) LEFT JOIN mt USING ({MKG}) LEFT JOIN mp USING ({MKG})),
  sc AS (SELECT {MKG}, iou, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr2)"""


def _scores(spark, d):
    """Whole masks against themselves moved on by a pixel, around the border; every sixth frame moves out of the recording."""
    px = I.mask_pixels(spark, d)
    away = F.when(F.col("frame") % 6 == 2, F.col("frame") + 1000).otherwise(F.col("frame"))
    pred = px.withColumns({"frame": away, "x": (F.col("x") + 1) % 16})
    return M.segmentation_scores(I.mask_index(spark, d), px, pred, 0.008)


@query("a42_segmentation_scores", f"{SCORE} SELECT {MK}, round(iou, 6) AS iou, round(f, 6) AS boundary_f FROM sc")
def a42(spark, d):
    return rounded(_scores(spark, d))


@query("a42_score_summary", f"{SCORE}, pe AS (SELECT video_id, object_id, avg(iou) * 100 AS j, avg(f) * 100 AS f FROM sc GROUP BY 1, 2), al AS (SELECT * FROM pe UNION ALL SELECT NULL, NULL, avg(j), avg(f) FROM pe) SELECT video_id, object_id::BIGINT AS object_id, round(j, 6) AS j, round(f, 6) AS f, round((j + f) / 2, 6) AS jf FROM al")
def a42b(spark, d):
    return rounded(M.score_summary(_scores(spark, d)))
