"""Python work on Arrow batches: results by definition, and steps of bounded size."""

import math

import numpy as np
import pyarrow as pa

from kymora.functions import curves as C
from kymora.functions.arrays import row_steps
from kymora.operators import signal as G
from pyspark.sql import functions as F


def direct(x, scales):
    out = np.empty((len(x), scales))
    for s in range(1, scales + 1):
        t = np.arange(-8 * s, 8 * s + 1) / s
        psi = np.exp(-t * t) * np.exp(2j * math.pi * t) / math.sqrt(math.pi * s)
        out[:, s - 1] = np.abs(np.convolve(x, psi)[8 * s : 8 * s + len(x)])
    return out


def test_wavelets_equal_their_definition(spark):
    """Series shorter and longer than a wavelet, of several blocks, and with missing and infinite values."""
    rng, series = np.random.default_rng(3), {}
    for n in (1, 2, 31, 32, 33, 64, 79, 80, 81, 400):
        series[n] = rng.normal(0, 50, n)
    series[401], series[402] = rng.normal(0, 50, 401), rng.normal(0, 50, 402)
    series[401][200], series[402][3] = math.nan, math.inf
    rows = [(g, i, float(v)) for g, x in series.items() for i, v in enumerate(x)]
    out = G.wavelet_magnitudes(spark.createDataFrame(rows, "g long, i long, v double"), ["g"], "i", "v", 10, size=128)
    got = {(r.g, r.i): r.magnitudes for r in out.collect()}
    assert len(got) == len(rows)
    for g, x in series.items():
        with np.errstate(invalid="ignore"):
            np.testing.assert_allclose(np.array([got[g, i] for i in range(len(x))]), direct(x, 10), atol=1e-9)


def test_results_are_handed_on_in_bounded_steps():
    batch = pa.RecordBatch.from_pydict({"n": list(range(1, 51))})
    seen = []
    for part, results in row_steps(iter([batch]), lambda b: ([np.zeros(n)] for n in b.column("n").to_pylist()), 800):
        assert part.column("n").to_pylist() == [len(r[0]) for r in results]
        assert sum(r[0].nbytes for r in results[:-1]) < 800
        seen += part.column("n").to_pylist()
    assert seen == list(range(1, 51))


def test_spectrum_gives_rows_in_steps(spark):
    """The plan holds no list of a series' coefficients: Python hands on rows."""
    s = spark.range(40).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("i"), F.rand(1).alias("v"))
    plan = G.spectrum(s, ["g"], "i", "v")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_curve_arrays_of_a_batch_are_whole_arrow_columns(spark):
    """Curves of several lengths and a missing one, without a Python object for each list."""
    rows = [(k, [float(i) for i in range(n)], [float(i * i) for i in range(n)]) for k, n in enumerate((2, 32, 5))] + [(3, None, None)]
    df = spark.createDataFrame(rows, "k int, y array<double>, x array<double>").coalesce(1)
    assert "ArrowEvalPython" in (q := df.select("k", C._resample("y", "x", F.lit(10)).alias("r")))._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.r for r in q.collect()}
    for k, y, x in rows[:3]:
        d = np.r_[0, np.cumsum(np.hypot(np.diff(y), np.diff(x)))]
        np.testing.assert_allclose(got[k].ys, np.interp(np.linspace(0, d[-1], 10), d, y))
        np.testing.assert_allclose(got[k].xs, np.interp(np.linspace(0, d[-1], 10), d, x))
        assert got[k].length == d[-1]
    assert np.isnan(got[3].ys).all() and got[3].length == 0
    bent = {r.k: r.h for r in df.filter("k < 3").select("k", C.head_curvature(F.col("y"), F.col("x")).alias("h")).collect()}
    assert [len(bent[k]) for k in range(3)] == [2, 32, 5] and all(v == 0 for v in bent[1][12:]) and max(bent[1][:12]) > 0
    assert C._head_curvature.evalType == C._resample.evalType == F.arrow_udf(lambda v: v, "long").evalType
