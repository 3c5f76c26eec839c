"""Box suppression: disk it takes, steps of any size, dense places, odd ids and boxes."""

import datetime
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kymora.operators import boxes as B
from kymora.operators import greedy
from kymora.operators.greedy import box_nms
from kymora.session import checkpoint_dir, release_shuffles

BOX = "id long, score double, x0 double, y0 double, x1 double, y1 double"


def _iou(a, b):
    iw, ih = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    i = max(iw, 0.0) * max(ih, 0.0)
    return i / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i)


def _kept(boxes, threshold):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[1], b[0])):
        if all(_iou(b, k) <= threshold for k in kept):
            kept.append(b)
    return sorted(b[0] for b in kept)


def _random(n, seed, reach=40):
    rng = np.random.default_rng(seed)
    at, size, score = rng.integers(0, reach, (n, 2)), rng.integers(3, 60, (n, 2)), rng.integers(0, 50, n)
    boxes = [(i, float(score[i]), *map(float, at[i]), *map(float, at[i] + size[i])) for i in range(n)]
    return boxes + [(n + i, 9.0, 5.0, 5.0, 25.0 + i % 3, 25.0) for i in range(n // 2)]


def _bytes(spark, folder):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size())) + sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(folder) for f in fs)


def test_disk_of_a_box(spark):
    """Copies of a box for every cell, once two thirds of what was written, do not reach the disk: 451 bytes a box before, 94 now."""
    n = 100_000
    x, y = F.rand(1) * 200, F.rand(2) * 1900
    df = spark.range(n).select((F.col("id") % 170).alias("g"), "id", F.rand(3).alias("score"), x.alias("x0"), y.alias("y0"), (x + 20 + F.rand(4) * 50).alias("x1"), (y + 30 + F.rand(5) * 25).alias("y1"))
    folder = checkpoint_dir(spark).removeprefix("file:")
    release_shuffles(spark)
    most, seen = _bytes(spark, folder), []
    once = greedy.gone_after
    greedy.gone_after = lambda step: seen.append(_bytes(spark, folder)) or once(step)
    # as in large tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        box_nms(df, ["g"], "id", "score", 0.7)
    finally:
        greedy.gone_after = once
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < seen[0] - most < 180 * n


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7, 0.9])
@pytest.mark.parametrize("boxes_a_step,pairs,alone", [(1, 5, 1), (37, 100, 3), (37, 10**6, 3), (10**6, 50, 1)])
def test_steps_of_any_size(monkeypatch, threshold, boxes_a_step, pairs, alone):
    """Two places, each with copies of the other's boxes; what stays open is settled afterwards, best first."""
    for name, value in (("STEP_BOXES", boxes_a_step), ("STEP_PAIRS", pairs), ("STEP_ALONE", alone)):
        monkeypatch.setattr(B, name, value)
    boxes = _random(120, 4, 60)
    rows = sorted((p, (b[3] + b[5]) / 2, B.SHARED if b[0] % 2 == p else B.COPY, b) for p in (0, 1) for b in boxes)
    columns = {"p1": [r[0] for r in rows], "p2": [7 for _ in rows], "kind": pa.array([r[2] for r in rows], pa.int8()), "node": [r[3][0] for r in rows], "score": [r[3][1] for r in rows], "id": [r[3][0] for r in rows]}
    columns |= {c: [r[3][2 + i] for r in rows] for i, c in enumerate(B.CORNERS)}
    out = pa.Table.from_batches(B.suppressed(threshold)(iter(pa.table(columns).to_batches(max_chunksize=7)))).to_pylist()
    stays = {r["node"]: r["known"] for r in out if r["known"] is not None}
    assert len(stays) == sum(r["known"] is not None for r in out)
    waits = {}
    for r in out:
        if r["known"] is None:
            waits.setdefault(r["node"], []).append((r["winner"], r["flip"]))
    assert not set(waits) & set(stays) and len(waits) + len(stays) == len(boxes)

    def stay(node):
        if node not in stays:
            stays[node] = int(not any(stay(w) ^ f for w, f in waits[node]))
        return stays[node]

    assert sorted(b[0] for b in boxes if stay(b[0])) == _kept(boxes, threshold)


def test_many_near_copies_meet_only_what_may_stay():
    """30 000 boxes on one spot: all pairs would be 450 million."""
    n = 30_000
    rng = np.random.default_rng(3)
    x, y, zero = rng.random(n), np.sort(rng.random(n)), np.zeros(n, np.int64)
    t = pa.table({"p1": zero, "p2": zero, "kind": np.ones(n, np.int8), "node": np.arange(n), "score": rng.random(n), "id": np.arange(n), "x0": x, "y0": y, "x1": x + 20, "y1": y + 20, "state": np.full(n, -1, np.int8)})
    looked = []

    class Step(B._Step):
        def settled(self, box, a, b):
            looked.append(len(a))
            return super().settled(box, a, b)

    step = Step(t, 0.7, True)
    assert step.result().num_rows == n - 1 and (step.state == 1).sum() == 1
    assert sum(looked) < 60_000_000


@pytest.mark.parametrize("kind", ["string", "struct", "date"])
def test_ids_of_any_type_and_odd_boxes(spark, kind):
    boxes = _random(150, 5)
    name = {"string": F.format_string("%05d", "id"), "struct": F.struct("id"), "date": F.date_add(F.lit("2000-01-01"), F.col("id").cast("int"))}[kind]
    back = {"string": lambda v: int(v), "struct": lambda v: v.id, "date": lambda v: (v - datetime.date(2000, 1, 1)).days}[kind]
    inf, nan = float("inf"), float("nan")
    odd = [(900, 1.0, 0.0, 0.0, inf, 9.0), (901, 2.0, 0.0, 0.0, inf, 9.0), (902, 1.0, nan, 0.0, 9.0, 9.0), (903, 1.0, None, 0.0, 9.0, 9.0), (904, 1.0, 9.0, 9.0, 0.0, 0.0)]
    df = spark.createDataFrame(boxes + odd, BOX)
    # groups that differ only in where the null stands
    df = df.unionAll(df.filter("id < 3")).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("score")))
    df = df.withColumns({"g": F.when(F.col("n") == 1, 5), "h": F.when(F.col("n") == 2, 5), "id": name})
    got = box_nms(df, ["g", "h"], "id", "score", 0.6, 2)
    assert got.columns == df.columns
    assert sorted(back(r.id) for r in got.collect() if r.g == 5) == sorted(_kept(boxes, 0.6) + [b[0] for b in odd])
    assert sorted(back(r.id) for r in got.collect() if r.h == 5) == _kept(boxes[:3], 0.6)


def test_types_that_parquet_lacks(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 9.0, 9.0), (2, 1.0, 0.0, 0.0, 9.0, 9.5)], BOX).withColumns({"g": F.lit(1), "long": F.expr("make_interval(0, 1, 0, 2)")})
    assert [r.id for r in box_nms(df, ["g"], "id", "score", 0.7).select("id").collect()] == [1]
