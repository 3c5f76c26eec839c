"""Order-dependent selections, merges and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.operators import greedy as GR
from kymora.operators import masks as M
from kymora.operators import tracks as TR
from kymora.plans import inputs as I
from kymora.plans.pixels import BEST, BRIGHT, MK, MKG, OUT, PXO, SZ, WITH, _cc2
from kymora.plans.registry import query, rounded, table

# Overlapping masks for graph work: nested intensity levels on both sides of zero.
NEST = f"""WITH {I.PIXELS_SQL}, nest AS (SELECT video_id, frame, o AS object_id, y, x FROM frame_pixels, range(1, 7) r(o) WHERE CASE WHEN o <= 3 THEN intensity > 0.05 * o ELSE intensity < -0.05 * (o - 3) END AND (o + frame) % 4 <> 0)"""


def nested(spark, d):
    p = I.frame_pixels(spark, d).withColumn("object_id", F.explode(F.array(*[F.lit(i) for i in range(1, 7)])))
    o, v = F.col("object_id"), F.col("intensity")
    hit = F.when(o <= 3, v > 0.05 * o).otherwise(v < -0.05 * (o - 3))
    return p.filter(hit & ((o + F.col("frame")) % 4 != 0)).select(*M.MASK, *M.POS)


GROUPS = f"""ar AS (SELECT {MKG}, count(*) AS area FROM nest GROUP BY {MKG}), ed AS (SELECT DISTINCT a.video_id, a.frame, a.object_id AS a, b.object_id AS b FROM nest a JOIN nest b USING (video_id, frame, y, x) WHERE a.object_id <> b.object_id),
  gp AS (SELECT video_id, frame, object_id, min(root) AS g FROM (WITH RECURSIVE w AS (SELECT {MKG}, object_id AS root FROM ar UNION SELECT e.video_id, e.frame, e.b, w.root FROM w JOIN ed e ON e.video_id = w.video_id AND e.frame = w.frame AND e.a = w.object_id) SELECT * FROM w) GROUP BY 1, 2, 3)"""


@query("j13_largest_of_overlapping", f"{NEST}, {GROUPS} SELECT gp.video_id, gp.frame::BIGINT AS frame, g::BIGINT AS \"group\", CAST(arg_max(object_id, {{'a': area, 'o': -object_id}}) AS BIGINT) AS object_id, max(area) AS area FROM gp JOIN ar USING ({MKG}) GROUP BY 1, 2, 3")
def j13(spark, d):
    return rounded(GR.largest_of_overlapping(nested(spark, d)))


MERGE = f"""{NEST.replace("WITH", "WITH RECURSIVE", 1)}, mk AS (SELECT video_id, frame, object_id, list(CAST(y * 100 + x AS BIGINT)) AS px FROM nest GROUP BY 1, 2, 3),
  st AS (SELECT video_id, frame, list({{'id': CAST(object_id AS BIGINT), 'px': px}} ORDER BY object_id) AS rest, CAST(NULL AS STRUCT(id BIGINT, px BIGINT[])) AS done FROM mk GROUP BY 1, 2
    UNION ALL SELECT video_id, frame, m.rest, {{'id': m.id, 'px': m.px}} FROM (
      SELECT video_id, frame, list_reduce(list_transform(rest, lambda r: {{'id': r.id, 'px': r.px, 'rest': CAST([] AS STRUCT(id BIGINT, px BIGINT[])[])}}),
        lambda a, e: CASE WHEN len(list_intersect(a.px, e.px)) / least(len(a.px), len(e.px)) > 0.95 THEN {{'id': a.id, 'px': list_distinct(list_concat(a.px, e.px)), 'rest': a.rest}} ELSE {{'id': a.id, 'px': a.px, 'rest': list_append(a.rest, {{'id': e.id, 'px': e.px}})}} END) AS m
      FROM st WHERE len(rest) > 0) q)"""


@query("j23_merge_overlapping", f"{MERGE} SELECT video_id, frame::BIGINT AS frame, id AS object_id, p // 100 AS y, p % 100 AS x FROM (SELECT video_id, frame, done.id AS id, unnest(done.px) AS p FROM st WHERE done IS NOT NULL AND len(done.px) >= 25) z")
def j23(spark, d):
    return rounded(GR.merge_overlapping(nested(spark, d), 0.95, 25))


SOLID = f"""{WITH}, {OUT}, held AS (SELECT * FROM outside SEMI JOIN mask_pixels USING (video_id, frame, object_id)), {_cc2('held', False, 'hc')},
  shut AS (SELECT DISTINCT video_id, frame, object_id FROM (SELECT video_id, frame, object_id, component FROM hc GROUP BY ALL HAVING NOT bool_or(y IN (0, 15) OR x IN (0, 15))) q),
  solid AS (SELECT * FROM mask_pixels ANTI JOIN shut USING (video_id, frame, object_id)), {_cc2('solid', True)}, {SZ}, {BEST}"""


@query("j23_solid_masks", f"{SOLID} SELECT {MK}, {PXO} FROM cc SEMI JOIN best USING (video_id, frame, object_id, component)")
def j23b(spark, d):
    return rounded(GR.solid_masks(I.mask_index(spark, d), I.mask_pixels(spark, d)))


@query("o5_spot_candidates", f"WITH {I.PIXELS_SQL}, t AS (SELECT video_id, frame, quantile_cont(intensity, 0.85) AS t FROM frame_pixels GROUP BY 1, 2) SELECT p.video_id, p.frame::BIGINT AS frame, CAST(p.y AS BIGINT) AS y, CAST(p.x AS BIGINT) AS x FROM frame_pixels p JOIN t USING (video_id, frame) WHERE intensity >= t AND NOT EXISTS (SELECT 1 FROM frame_pixels q WHERE q.video_id = p.video_id AND q.frame = p.frame AND q.y - p.y BETWEEN -2 AND 1 AND q.x - p.x BETWEEN -2 AND 1 AND q.intensity > p.intensity)")
def o5a(spark, d):
    return rounded(GR.spot_candidates(I.frame_pixels(spark, d), 4).select(*M.FRAME, *M.POS))


_FAR = "(c.y - {0}.y) ** 2 + (c.x - {0}.x) ** 2 >= 16"
SPOTS = f"""WITH {I.PIXELS_SQL}, t AS (SELECT video_id, frame, quantile_cont(intensity, 0.85) AS t FROM frame_pixels GROUP BY 1, 2),
  c AS (SELECT p.video_id, p.frame, p.y, p.x, row_number() OVER (PARTITION BY p.video_id, p.frame ORDER BY p.intensity DESC, p.y DESC, p.x DESC) AS r FROM frame_pixels p JOIN t USING (video_id, frame) WHERE intensity >= t
    AND NOT EXISTS (SELECT 1 FROM frame_pixels q WHERE q.video_id = p.video_id AND q.frame = p.frame AND q.y - p.y BETWEEN -2 AND 1 AND q.x - p.x BETWEEN -2 AND 1 AND q.intensity > p.intensity)),
  s0 AS (SELECT * FROM c WHERE r = 1),
  s1 AS (SELECT c.* FROM c JOIN s0 USING (video_id, frame) WHERE {_FAR.format("s0")} QUALIFY row_number() OVER (PARTITION BY c.video_id, c.frame ORDER BY c.r) = 1),
  s2 AS (SELECT c.* FROM c JOIN s0 USING (video_id, frame) JOIN s1 USING (video_id, frame) WHERE c.r > s1.r AND {_FAR.format("s0")} AND {_FAR.format("s1")} QUALIFY row_number() OVER (PARTITION BY c.video_id, c.frame ORDER BY c.r) = 1),
  spots AS (SELECT *, 0 AS spot FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2)"""


@query("o5_bright_spots", f"{SPOTS} SELECT video_id, frame::BIGINT AS frame, spot::BIGINT AS spot, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM spots")
def o5(spark, d):
    return rounded(GR.bright_spots(I.frame_pixels(spark, d), 3, 4))


def _boxes(spark, d):
    k, s = F.col("l_partkey"), F.col("l_quantity")
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image"), k.alias("box")).agg(F.max("l_extendedprice").alias("score"), F.max(s).alias("q"))
    x0, y0 = F.col("box") % 97 * 2.0, F.floor(F.col("box") / 97) * 9.0
    return li.select("image", "box", "score", x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("q")).alias("x1"), (y0 + 30 + F.col("q") / 2).alias("y1"))


BOXES = """WITH b AS (SELECT l_suppkey AS image, l_partkey AS box, max(l_extendedprice) AS score, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
  bx AS (SELECT image, box, score, box % 97 * 2.0 AS x0, (box // 97) * 9.0 AS y0, box % 97 * 2.0 + 20 + q AS x1, (box // 97) * 9.0 + 30 + q / 2 AS y1 FROM b),
  pr AS (SELECT a.image, a.box AS w, b.box AS l, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
    FROM bx a JOIN bx b ON a.image = b.image AND (a.score > b.score OR (a.score = b.score AND a.box < b.box))),
  ls AS (SELECT image, l AS box, list(w) AS w FROM pr WHERE i > 0.7 * (s - i) GROUP BY 1, 2),
  el AS (SELECT image, list({'b': bx.box, 'w': coalesce(ls.w, []), 'k': CAST([] AS BIGINT[])} ORDER BY score DESC, bx.box) AS e FROM bx LEFT JOIN ls USING (image, box) GROUP BY 1),
  dn AS (SELECT image, list_reduce(list_concat([{'b': CAST(-1 AS BIGINT), 'w': CAST([] AS BIGINT[]), 'k': CAST([] AS BIGINT[])}], e), lambda a, x: {'b': x.b, 'w': x.w, 'k': CASE WHEN list_has_any(a.k, x.w) THEN a.k ELSE list_append(a.k, x.b) END}).k AS k FROM el)"""


@query("o6_box_suppression", f"{BOXES} SELECT image, unnest(k) AS box FROM dn")
def o6(spark, d):
    return rounded(GR.box_nms(_boxes(spark, d), ["image"], "box", "score", 0.7).select("image", "box"))


TRACKS = f"""{SPOTS.replace("WITH", "WITH RECURSIVE", 1)},
  fs AS (SELECT video_id, frame, list({{'d': 0.0::DOUBLE, 's': CAST(spot AS BIGINT), 'y': CAST(y AS DOUBLE), 'x': CAST(x AS DOUBLE)}} ORDER BY spot) AS sp, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS step FROM spots
    WHERE video_id IN (SELECT s.video_id FROM spots s JOIN (SELECT video_id, min(frame) AS frame FROM frame_pixels GROUP BY 1) z USING (video_id, frame)) GROUP BY 1, 2),
  el AS (SELECT video_id, frame, step, sp, CAST([] AS STRUCT(y DOUBLE, x DOUBLE, f BIGINT, s BIGINT)[]) AS none, CAST([] AS STRUCT(spot BIGINT, f BIGINT, s BIGINT)[]) AS said FROM fs),
  tk AS (SELECT video_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS frame, none AS tr, said AS o FROM el WHERE step = 1
    UNION ALL SELECT video_id, step, frame, list_concat(a.tr, list_transform(a.fr, lambda s: {{'y': s.y, 'x': s.x, 'f': frame, 's': s.s}})), list_concat(a.o, list_transform(a.fr, lambda s: {{'spot': s.s, 'f': frame, 's': s.s}}))
    FROM (SELECT el.video_id, el.step, CAST(el.frame AS BIGINT) AS frame, list_reduce(list_concat([{{'tr': none, 'fr': sp, 'o': said}}], list_transform(tk.tr, lambda t: {{'tr': [t], 'fr': CAST([] AS STRUCT(d DOUBLE, s BIGINT, y DOUBLE, x DOUBLE)[]), 'o': said}})),
      lambda a, e: CASE WHEN len(list_filter(a.fr, lambda s: (s.y - e.tr[1].y) ** 2 + (s.x - e.tr[1].x) ** 2 < 9)) = 0 THEN {{'tr': list_concat(a.tr, e.tr), 'fr': a.fr, 'o': a.o}}
        ELSE list_transform([list_min(list_transform(list_filter(a.fr, lambda s: (s.y - e.tr[1].y) ** 2 + (s.x - e.tr[1].x) ** 2 < 9), lambda s: {{'d': (s.y - e.tr[1].y) ** 2 + (s.x - e.tr[1].x) ** 2, 's': s.s, 'y': s.y, 'x': s.x}}))],
          lambda m: {{'tr': list_append(a.tr, {{'y': m.y, 'x': m.x, 'f': e.tr[1].f, 's': e.tr[1].s}}), 'fr': list_filter(a.fr, lambda s: s.s <> m.s), 'o': list_append(a.o, {{'spot': m.s, 'f': e.tr[1].f, 's': e.tr[1].s}})}})[1] END) AS a
      FROM tk JOIN el ON el.video_id = tk.video_id AND el.step = tk.step + 1) q),
  tracks AS (SELECT t.video_id, t.frame, o.spot, o.f AS start_frame, o.s AS start_spot, s.y, s.x FROM (SELECT video_id, frame, unnest(o) AS o FROM tk) t JOIN spots s ON s.video_id = t.video_id AND s.frame = t.frame AND s.spot = t.o.spot)"""


@query("j19_spot_tracks", f"{TRACKS} SELECT video_id, frame, spot, start_frame, start_spot, round(CAST(y AS DOUBLE), 6) AS y, round(CAST(x AS DOUBLE), 6) AS x FROM tracks")
def j19(spark, d):
    spots = GR.bright_spots(I.frame_pixels(spark, d), 3, 4)
    return rounded(TR.track_spots(spots, I.mask_index(spark, d).select(*M.FRAME).distinct(), 3.0))


OFFSETS = f"""{TRACKS}, {BRIGHT}, back AS (SELECT video_id, frame, quantile_cont(cx, 0.5) OVER w - cx AS dx, quantile_cont(cy, 0.5) OVER w - cy AS dy FROM bc WINDOW w AS (PARTITION BY video_id)),
  rf AS (SELECT video_id, start_frame, start_spot, median(x) AS rx, median(y) AS ry FROM tracks GROUP BY 1, 2, 3),
  up AS (SELECT video_id, row_number() OVER w AS k, sum(rx) OVER w AS rx, sum(ry) OVER w AS ry FROM rf WINDOW w AS (PARTITION BY video_id ORDER BY start_frame, start_spot)),
  se AS (SELECT video_id, frame, count(*) AS k, sum(x) AS sx, sum(y) AS sy FROM tracks GROUP BY 1, 2),
  ow AS (SELECT se.video_id, se.frame, (rx - sx) / se.k AS dx, (ry - sy) / se.k AS dy FROM se JOIN up ON up.video_id = se.video_id AND up.k = se.k),
  fr AS (SELECT DISTINCT video_id, frame FROM frame_pixels)"""


@query("j19_feature_offsets", f"""{OFFSETS} SELECT fr.video_id, fr.frame::BIGINT AS frame, round(CAST(coalesce(CASE WHEN fr.video_id IN (SELECT video_id FROM tracks) THEN ow.dx ELSE back.dx END, 0) AS DOUBLE), 6) AS dx,
  round(CAST(coalesce(CASE WHEN fr.video_id IN (SELECT video_id FROM tracks) THEN ow.dy ELSE back.dy END, 0) AS DOUBLE), 6) AS dy FROM fr LEFT JOIN ow ON ow.video_id = fr.video_id AND ow.frame = fr.frame LEFT JOIN back ON back.video_id = fr.video_id AND back.frame = fr.frame""")
def j19b(spark, d):
    values, frames = I.frame_pixels(spark, d), I.mask_index(spark, d).select(*M.FRAME).distinct()
    tracks = TR.track_spots(GR.bright_spots(values, 3, 4), frames, 3.0)
    return rounded(TR.feature_offsets(tracks, frames, M.median_offsets(M.bright_centroid(values))))
