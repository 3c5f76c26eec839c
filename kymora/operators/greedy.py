"""Selections and merges that depend on order: spots, boxes, overlapping masks, tracks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.functions.scalar import pixel_code
from kymora.operators.boxes import BEATEN, COPY, CORNERS, OWN, SHARED, beaten_in_batch, reach_of, suppressed
from kymora.operators.graph import connected_components, gone_after
from kymora.operators.masks import FRAME, MASK, POS, SHIFT, components, empty_pixels, keep_largest, overlap_pairs
from kymora.session import cut_lineage, release_shuffles, stored


def spot_candidates(values: DataFrame, size: int = 10, percentile: float = 0.85) -> DataFrame:
    """Pixels that are the largest in their window and among the brightest of the frame."""
    lo, hi = -(size // 2), size - size // 2 - 1
    across = Window.partitionBy(*FRAME, "y").orderBy("x").rangeBetween(lo, hi)
    down = Window.partitionBy(*FRAME, "x").orderBy("y").rangeBetween(lo, hi)
    v = values.withColumn("__m", F.max("intensity").over(across)).withColumn("__m", F.max("__m").over(down))
    cut = values.groupBy(*FRAME).agg(F.percentile("intensity", F.lit(percentile)).alias("__t"))
    return v.join(cut, FRAME).filter((F.col("intensity") == F.col("__m")) & (F.col("intensity") >= F.col("__t"))).drop("__m", "__t")


def _pick(y, x, k: int, distance: float) -> list[int]:
    kept: list[int] = []
    for i in range(len(y)):
        if all(math.hypot(y[i] - y[j], x[i] - x[j]) >= distance for j in kept):
            kept.append(i)
            if len(kept) == k:
                break
    return kept


def bright_spots(values: DataFrame, k: int = 3, distance: int = 10, percentile: float = 0.85) -> DataFrame:
    """Up to k brightest spots per frame, none nearer than ``distance`` to a brighter one.

    One group is the candidates of one frame, at most its pixels.  Equal intensities go
    in reverse raster order.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pick(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([_pick(a, b, k, distance) for a, b in zip(y, x)])

    c = spot_candidates(values, distance, percentile)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("intensity")).alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))))
    g = c.groupBy(*FRAME).agg(rows.alias("r"))
    g = g.withColumn("p", pick(F.transform("r", lambda s: (-s["ny"]).cast("double")), F.transform("r", lambda s: (-s["nx"]).cast("double"))))
    out = g.select(*FRAME, "r", F.posexplode("p").alias("spot", "i"))
    s = F.get("r", F.col("i"))
    return out.select(*FRAME, "spot", (-s["ny"]).alias("y"), (-s["nx"]).alias("x"))


#: Side of a place in cells of its largest boxes; boxes of a place are settled at once.
CELLS = 64


def box_nms(boxes: DataFrame, group: Sequence[str], box_id: str, score: str, threshold: float, cells: int = CELLS) -> DataFrame:
    """Greedy suppression of boxes (x0, y0, x1, y1) by score; ties go to the smaller id, null scores come last.

    Of equal boxes only the best can stay.  IoU over t forces sizes within a factor 1/t, so a box meets boxes of its own
    level of sizes and the next ones; its centre lies within (1 - t) of its own side if t is a half or more (else of half
    its side and (1/2 - t) of the other one).  A place is a square of ``cells`` x ``cells`` cells for some levels of sizes: a
    box goes to its own place and, as a copy, to the others it can reach.  Pairs are found and settled inside a place, none
    of them is stored; what depends on boxes of other places is settled in rounds.  Boxes without a finite area stay.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    # rows of a group that follow each other take less room in files and shuffles
    near = boxes.sortWithinPartitions(F.xxhash64(*group, F.lit(0)), "y0", "x0")
    numbered = stored(near.withColumn("node", F.monotonically_increasing_id()), "boxes")
    release_shuffles(boxes.sparkSession)
    gone = gone_after(_first_round(numbered, group, box_id, score, threshold, cells))
    release_shuffles(boxes.sparkSession)
    return numbered.join(gone, "node", "left_anti").drop("node")


def _first_round(numbered: DataFrame, group: Sequence[str], box_id: str, score: str, threshold: float, cells: int) -> DataFrame:
    """Send boxes to places and settle each place: what is known of boxes, and the conditions that stay open."""
    base = 1.0 / threshold
    span = max(1, math.floor(math.log(16) / math.log(base)))
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in CORNERS)
    measured = reduce(lambda a, b: a & b, [F.abs(c) < math.inf for c in (x0, y0, x1, y1)])
    rows = numbered.filter(measured & (x1 > x0) & (y1 > y0)).select(
        *group, "node", F.coalesce(F.col(score).cast("double"), F.lit(-math.inf)).alias("__s"), F.col(box_id).alias("__i"), *[F.col(c).cast("double").alias(f"__{c}") for c in CORNERS]
    )
    # nested types are hashed as text, and nulls by place
    same = [x for c in group for x in (F.col(c).isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if _nested(rows, c) else F.col(c))]
    again = F.lit(False)
    if not _nested(rows, "__i"):
        # it depends on the batch; said to be deterministic, it would run for a filter, too
        again = F.arrow_udf(beaten_in_batch, T.BooleanType()).asNondeterministic()(F.xxhash64(*same, F.lit(0)), F.xxhash64(F.lit(1), *same), *[f"__{c}" for c in CORNERS], "__s", "__i", "node")
    h, w = F.col("__y1") - F.col("__y0"), F.col("__x1") - F.col("__x0")
    rows = rows.withColumn("__again", again).withColumns({"__lv": F.floor(F.log(F.greatest(w, h)) / math.log(base)), "__cy": (F.col("__y0") + F.col("__y1")) / 2, "__cx": (F.col("__x0") + F.col("__x1")) / 2})
    band = lambda level: F.floor(level / span)
    lv, b = F.col("__lv"), F.col("__b")
    bands = F.array_distinct(F.array(band(lv - 1), band(lv), band(lv + 1)))
    # a box that an equal one beats goes anywhere, only to be told
    rows = rows.withColumns({"__n": F.size(bands), "__bs": F.when(F.col("__again"), F.array(F.lit(None).cast("long"))).otherwise(bands)}).withColumn("__b", F.explode("__bs"))
    side = 2 * max(1 - threshold, 0.5) * cells * F.pow(F.lit(base), (b + 1) * span)
    most = F.pow(F.lit(base), lv + F.when(b < band(lv), 0).otherwise(2))
    own = b == band(lv)
    for c, size in (("y", h), ("x", w)):
        # a little more than the way, for rounding
        reach = 1.000001 * reach_of(size, most, threshold, F.least, lambda x, y, z: F.when(x, y).otherwise(z))
        centre = F.col(f"__c{c}")
        rows = rows.withColumns({f"__l{c}": F.coalesce(F.floor((centre - reach) / side), "node"), f"__h{c}": F.coalesce(F.floor((centre + reach) / side), "node"), f"__o{c}": F.floor(centre / side)})
        rows = rows.withColumn(f"__t{c}", F.explode(F.sequence(f"__l{c}", f"__h{c}")))
        own &= F.col(f"__t{c}") == F.col(f"__o{c}")
    shared = (F.col("__n") > 1) | (F.col("__ly") < F.col("__hy")) | (F.col("__lx") < F.col("__hx"))
    kind = F.when(b.isNull(), BEATEN).when(own & shared, SHARED).when(own, OWN).otherwise(COPY).cast("byte")
    place = ["__b", "__ty", "__tx", *group]
    sent = rows.select(*place, kind.alias("kind"), "node", F.col("__s").alias("score"), F.col("__i").alias("id"), *[F.col(f"__{c}").alias(c) for c in CORNERS]).repartition(*place)
    ids = F.rank().over(Window.partitionBy(*place).orderBy("id")) if _nested(rows, "__i") else F.col("id")
    at = [b.isNull(), "__b", "__ty", "__tx", *same]
    dealt = sent.select(F.xxhash64(*at).alias("p1"), F.xxhash64(F.lit(1), *at).alias("p2"), "kind", "node", "score", ids.alias("id"), *CORNERS)
    dealt = dealt.sortWithinPartitions("p1", "p2", (F.col("y0") + F.col("y1")) / 2)
    return cut_lineage(dealt.mapInArrow(suppressed(threshold), "block long, node long, known int, winner long, flip int, alone boolean"))


def _nested(df: DataFrame, c: str) -> bool:
    return not isinstance(df.schema[c].dataType, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def overlap_groups(px: DataFrame) -> DataFrame:
    """Group of overlapping masks each mask belongs to."""
    node = lambda c: F.struct(*[F.col(k) for k in FRAME], F.col(c).alias("object_id"))
    masks = px.select(*MASK).distinct().select(node("object_id").alias("node"))
    pairs = overlap_pairs(px).select(node("a").alias("a"), node("b").alias("b"))
    lab = connected_components(masks, pairs)
    return lab.select("node.*", F.col("label.object_id").alias("group"))


def largest_of_overlapping(px: DataFrame) -> DataFrame:
    """The largest mask of each group of overlapping masks; the smaller id on ties."""
    areas = px.groupBy(*MASK).agg(F.count(F.lit(1)).alias("area"))
    g = overlap_groups(px).join(areas, MASK)
    return g.groupBy(*FRAME, "group").agg(
        F.max_by("object_id", F.struct("area", -F.col("object_id"))).alias("object_id"), F.max("area").alias("area")
    )


def merge_overlapping(px: DataFrame, share: float = 0.95, min_area: int = 25) -> DataFrame:
    """Union masks that cover more than ``share`` of the smaller one, in id order.

    Masks that do not touch cannot meet, so each group of overlapping masks of a frame is
    merged by itself.
    """
    g = px.join(overlap_groups(px), MASK).select(*FRAME, "group", "object_id", pixel_code(F.col("y"), F.col("x")).alias("c"))
    fields = [f for f in px.schema.fields if f.name in MASK]
    schema = T.StructType([*fields, T.StructField("c", T.LongType())])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, owner = np.unique(pdf["object_id"].to_numpy(), return_inverse=True)
        order = np.argsort(pdf["c"].to_numpy(), kind="stable")
        code, owner = pdf["c"].to_numpy()[order], owner[order]
        masks = [code[owner == k] for k in range(len(ids))]

        def met(pixels: np.ndarray) -> np.ndarray:
            """How many of ``pixels`` each mask covers, from the places where they stand among all pixels."""
            low, high = np.searchsorted(code, pixels, "left"), np.searchsorted(code, pixels, "right")
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            return np.bincount(owner[at], minlength=len(ids))

        gone, out = np.zeros(len(ids), bool), []
        for k in range(len(ids)):
            if gone[k]:
                continue
            cur, both = masks[k], met(masks[k])
            for j in range(k + 1, len(ids)):
                if not gone[j] and both[j] / min(cur.size, masks[j].size) > share:
                    new = np.setdiff1d(masks[j], cur, assume_unique=True)
                    cur, both, gone[j] = np.union1d(cur, new), both + met(new), True
            out.append(pd.DataFrame({"object_id": ids[k], "c": cur}))
        res = pd.concat(out, ignore_index=True)
        return res.assign(video_id=pdf["video_id"].iloc[0], frame=pdf["frame"].iloc[0])[[*MASK, "c"]]

    m = g.groupBy(*FRAME, "group").applyInPandas(merge, schema)
    big = m.groupBy(*MASK).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_area)
    m = m.join(big, MASK, "left_semi")
    return m.select(*MASK, F.floor(F.col("c") / SHIFT).cast("int").alias("y"), (F.col("c") % SHIFT).cast("int").alias("x"))


def solid_masks(index: DataFrame, px: DataFrame) -> DataFrame:
    """Largest part of each mask that encloses no background."""
    border = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)
    size = index.select(*MASK, "height", "width")
    bg = components(empty_pixels(index.join(px.select(*MASK).distinct(), MASK, "left_semi"), px)).join(size, MASK)
    closed = bg.groupBy(*MASK, "component").agg(F.max(border).alias("open")).filter("NOT open").select(*MASK).distinct()
    return keep_largest(px.join(closed, MASK, "left_anti"), MASK, diagonal=True)
