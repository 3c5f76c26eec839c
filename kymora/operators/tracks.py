"""Spots followed over the frames of a recording, and the shifts of frames that tracks show."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.operators.graph import connected_components
from kymora.operators.masks import FRAME
from kymora.operators.ordered import CHUNK, running_total, width_bucket, with_row_index

TRACK = T.StructType().add("start_frame", T.LongType()).add("start_spot", T.LongType())

Cell = tuple[int, int]
#: Place, number in its frame, and the last frame in which its surroundings show a spot.
Spot = tuple[float, float, int, int]


class Live:
    """Tracks that a later spot may still join, in a grid of squares as wide as a track can jump."""

    def __init__(self, reach: float):
        self.reach, self.began = reach, 0
        self.tracks: dict[int, tuple[Cell, float, float, int, int, int]] = {}
        self.grid: dict[Cell, set[int]] = {}
        self.ends: list[tuple[int, int]] = []

    def cell(self, y: float, x: float) -> Cell:
        return math.floor(y / self.reach), math.floor(x / self.reach)

    def _around(self, at: Cell) -> Iterator[Cell]:
        return ((at[0] + a, at[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1))

    def _leave(self, track: int) -> None:
        at = self.tracks[track][0]
        self.grid[at].remove(track)
        if not self.grid[at]:
            del self.grid[at]

    def _place(self, track: int, y: float, x: float, until: int, start: tuple[int, int]) -> None:
        at = self.cell(y, x)
        self.tracks[track] = (at, y, x, until, *start)
        self.grid.setdefault(at, set()).add(track)
        heapq.heappush(self.ends, (until, track))

    def retire(self, frame: int) -> None:
        """Forget tracks whose surroundings show no spot from ``frame`` on."""
        while self.ends and self.ends[0][0] < frame:
            until, track = heapq.heappop(self.ends)
            if track in self.tracks and self.tracks[track][3] == until:
                self._leave(track)
                del self.tracks[track]

    def follow(self, frame: int, spots: Sequence[Spot]) -> list[tuple[int, int]]:
        """First frame and spot of the track of each spot: tracks in the order they began take their nearest free spot."""
        self.retire(frame)
        here: dict[Cell, list[int]] = {}
        for j, (y, x, *_) in enumerate(spots):
            here.setdefault(self.cell(y, x), []).append(j)
        close = {t for at in here for near in self._around(at) for t in self.grid.get(near, ())}
        taken: list[tuple[int, int] | None] = [None] * len(spots)
        for track in sorted(close):
            at, y, x, _, *start = self.tracks[track]
            best = min(
                ((d, j) for near in self._around(at) for j in here.get(near, ()) if taken[j] is None and (d := (spots[j][0] - y) ** 2 + (spots[j][1] - x) ** 2) < self.reach**2),
                default=None,
            )
            if best:
                y, x, _, until = spots[best[1]]
                taken[best[1]] = tuple(start)
                self._leave(track)
                self._place(track, y, x, until, tuple(start))
        for j, (y, x, spot, until) in enumerate(spots):
            if taken[j] is None:
                taken[j] = (frame, spot)
                self._place(self.began, y, x, until, (frame, spot))
                self.began += 1
        return taken


def track_spots(spots: DataFrame, frames: DataFrame, max_distance: float = 20.0) -> DataFrame:
    """Link spots (video_id, frame, spot, y, x) over frames.

    Tracks take their nearest free spot in the order they began; spots left over begin
    new tracks.  A recording whose first frame shows no spot gives no tracks.

    Spots nearer than the limit lie in the same or in touching squares of that size, so
    separate clusters of squares never interact and are followed apart.  Within a
    cluster the frames are streamed in order.  A task holds the last places of live tracks in a grid: a spot meets
    only tracks around it, and a track is dropped after the last frame with a spot in its square or one beside it.
    """
    first = frames.groupBy("video_id").agg(F.min("frame").alias("frame"))
    begun = first.join(spots.select(*FRAME).distinct(), FRAME, "left_semi").select("video_id")
    s = spots.join(begun, "video_id", "left_semi").select(
        "video_id", F.col("frame").cast("long").alias("frame"), F.col("spot").cast("long").alias("spot"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")
    )
    square = ["video_id", "__gy", "__gx"]
    s = s.withColumns({"__gy": F.floor(F.col("y") / max_distance), "__gx": F.floor(F.col("x") / max_distance)})
    cells = s.groupBy(*square).agg(F.max("frame").alias("__last"))
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    seen = cells.withColumn("__m", F.explode(moves))
    seen = seen.select("video_id", (F.col("__gy") + F.col("__m.a")).alias("__gy"), (F.col("__gx") + F.col("__m.b")).alias("__gx"), "__last")
    until = seen.groupBy(*square).agg(F.max("__last").alias("until"))

    node = lambda y, x: F.struct("video_id", y.alias("gy"), x.alias("gx"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = cells.withColumn("m", F.explode(steps))
    ahead = ahead.select(node(F.col("__gy"), F.col("__gx")).alias("a"), node(F.col("__gy") + F.col("m.a"), F.col("__gx") + F.col("m.b")).alias("b"))
    here = cells.select(node(F.col("__gy"), F.col("__gx")).alias("node"))
    edges = ahead.join(here, ahead["b"] == here["node"]).select("a", "b")
    lab = connected_components(here, edges).select("node.video_id", F.col("node.gy").alias("__gy"), F.col("node.gx").alias("__gx"), F.struct("label.gy", "label.gx").alias("cluster"))
    s = s.join(lab.join(until, square), square)
    s = s.select("video_id", F.col("cluster.gy").alias("cy"), F.col("cluster.gx").alias("cx"), "frame", "spot", "y", "x", "until")
    keys = ["video_id", "cy", "cx"]
    s = s.repartition(*keys).sortWithinPartitions(*keys, "frame", "spot")
    schema = T.StructType([*s.schema.fields, *TRACK.fields])

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, frame, rows = None, None, []
        live = Live(max_distance)

        def close() -> list[tuple]:
            """Report the rows of one finished frame."""
            found = live.follow(frame, [(r[5], r[6], r[4], r[7]) for r in rows])
            return [(*r, *start) for r, start in zip(rows, found, strict=True)]

        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False, name=None):
                if (r[:3], r[3]) != (key, frame):
                    if rows:
                        done += close()
                        rows = []
                    if r[:3] != key:
                        live = Live(max_distance)
                    key, frame = r[:3], r[3]
                rows.append(r)
            if done:
                yield pd.DataFrame(done, columns=schema.names)
        if rows:
            yield pd.DataFrame(close(), columns=schema.names)

    return s.mapInPandas(follow, schema).drop("cy", "cx", "until")


def feature_offsets(tracks: DataFrame, frames: DataFrame, fallback: DataFrame) -> DataFrame:
    """Shift of each frame that brings its tracked spots to their usual places.

    A track's reference is the median of its places.  With k spots in a frame, the shift is the mean of the
    first k references (tracks in order of their start) minus the mean of the spots; 0 where there is none.
    Videos without a track take their shifts (dx, dy) from ``fallback``.
    """
    track = ["video_id", "start_frame", "start_spot"]
    refs = tracks.groupBy(*track).agg(F.median("x").alias("rx"), F.median("y").alias("ry"))
    refs = with_row_index(refs, ["video_id"], ["start_frame", "start_spot"], width_bucket(F.col("start_frame"), CHUNK), "__i")
    for c in ("rx", "ry"):
        refs = running_total(refs, ["video_id"], ["__i"], width_bucket(F.col("__i"), CHUNK), F.col(c), f"__{c}")
    refs = refs.select("video_id", (F.col("__i") + 1).alias("__k"), "__rx", "__ry")
    seen = tracks.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("__k"), F.sum("x").alias("__sx"), F.sum("y").alias("__sy"))
    shift = lambda r, s: (F.col(r) - F.col(s)) / F.col("__k")
    own = seen.join(refs, ["video_id", "__k"]).select(*FRAME, shift("__rx", "__sx").alias("__dx"), shift("__ry", "__sy").alias("__dy"))
    tracked = tracks.select("video_id", F.lit(True).alias("__t")).distinct()
    out = frames.select(*FRAME).distinct().join(tracked, "video_id", "left").join(own, FRAME, "left").join(fallback.select(*FRAME, "dx", "dy"), FRAME, "left")
    pick = lambda c: F.coalesce(F.when(F.col("__t"), F.col(f"__{c}")).otherwise(F.col(c)), F.lit(0.0)).cast("double").alias(c)
    return out.select(*FRAME, pick("dx"), pick("dy"))
