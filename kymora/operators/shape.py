"""Whole jobs on centrelines: head angles over time and posture over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.functions import curves as C
from kymora.operators import series as W
from kymora.operators import signal as G
from kymora.operators.normalize import z_score
from kymora.operators.ordered import neighbour_columns, null_safe_join, with_row_index

ANGLE_FIELDS = ["angle_degrees", "bend_location", "bend_magnitude", "bend_position_y", "bend_position_x", "head_mag", "body_mag"]


def head_angles(curves: DataFrame, keys: Sequence[str], frame: str, min_length: float = 5.0, straight: float = 3.0, window: int = 3, deviation: float = 50.0) -> DataFrame:
    """Angles per frame, failed frames filled, noise peaks removed, bends by smoothed angle.

    Points are needed once: the candidate angles and the strongest bend do not depend on
    the neighbouring frames, so only they travel through the windows.
    """
    r = curves.select(*keys, frame, C.resample(F.col("points"), 100).alias("r"))
    r = r.withColumn("k", C.head_curvature(F.col("r.ys"), F.col("r.xs"))).withColumn("p", C.zip_points(F.col("r.ys"), F.col("r.xs")))
    r = r.select(*keys, frame, C.head_candidates(F.col("p"), min_length).alias("__c"), C.strongest_bend(F.col("p"), F.col("k")).alias("__b"))
    first = r.withColumn("__a", C.pick_head_angle(F.col("__c"), F.lit(None).cast("double")))
    flat = F.abs("__a.angle_degrees") <= straight
    first = first.withColumns(
        {
            "angle_degrees": F.col("__a.angle_degrees"), "head_mag": F.col("__a.head_mag"), "body_mag": F.col("__a.body_mag"), "error": F.col("__a.error"),
            **{b: F.when(flat, 0.0).otherwise(F.col(f"__b.{b}")) for b in W.BEND},
        }
    ).drop("__a")
    filled = W.fill_failed_frames(first, keys, frame, ANGLE_FIELDS, straight=straight)
    dense = with_row_index(filled, keys, [frame], F.floor(F.col(frame) / 4096), "__i")
    calm = W.remove_noise_peaks(dense, keys, "__i", "angle_degrees", window, deviation)
    out = neighbour_columns(
        calm, keys, "__i", 1, {"__prev": lambda w: F.lag("angle_degrees").over(w), "angle_degrees_smoothed_3frame": lambda w: F.avg("angle_degrees").over(w.rowsBetween(-1, 1))}
    )
    out = out.withColumn("__a", C.pick_head_angle(F.col("__c"), F.col("__prev")))
    flat = (F.abs("angle_degrees") <= straight) | (F.abs("__a.angle_degrees") <= straight)
    return out.select(
        *keys, frame, "angle_degrees", *[F.when(flat, 0.0).otherwise(F.col(f"__b.{b}")).alias(b) for b in W.BEND],
        F.col("__a.head_mag").alias("head_mag"), F.col("__a.body_mag").alias("body_mag"), "is_noise_peak", "peak_deviation", "window_size_used",
        (F.abs("angle_degrees") <= straight).alias("is_straight"), F.col("__a.error").alias("error"), F.col("__a.error").isNotNull().alias("has_warning"),
        "angle_degrees_smoothed_3frame",
    )


def frame_shapes(curves: DataFrame, keep: Sequence[str], window: int = 50, threshold: float = 8.0) -> DataFrame:
    """Length, amplitude, posture, wavelength and spatial frequency of each frame."""
    p = F.col("points")
    c = curves.withColumn("curvature", C.curvature(C.ys(p), C.xs(p), window))
    top, avg = C.swim_amplitude(p)
    c = c.withColumns({"max_amplitude": top, "avg_amplitude": avg, "worm_length": C.length(p), "shape": C.shape_class(p, threshold)})
    c = c.withColumn("wavelength", C.wavelength(F.col("shape"), F.col("worm_length"), C.strict_peaks(F.col("curvature"))))
    return c.select(
        *keep, "shape", "max_amplitude", "avg_amplitude", "worm_length", "wavelength",
        F.try_divide("worm_length", "wavelength").alias("wave_number"), F.try_divide("wavelength", "worm_length").alias("normalized_wavelength"),
        C.spatial_frequency(F.col("curvature")).alias("dominant_spatial_freq"), C.mean(F.col("curvature")).alias("mean_curvature"),
    )


METRICS = ["max_amplitude", "avg_amplitude", "wavelength", "worm_length", "wave_number", "normalized_wavelength"]


def posture_series(curves: DataFrame, keys: Sequence[str], index: str, fps: float = 10.0, window_s: float = 5.0, overlap_s: float = 2.5, **shape_args) -> DataFrame:
    """Per-frame shapes with smoothed metrics, mean-curvature z score and frequency."""
    s = frame_shapes(curves, [*keys, index], **shape_args)
    s = z_score(s, keys, "mean_curvature", "curvature_time_series", population=True)
    nper, nover = int(window_s * fps), int(overlap_s * fps)
    seg = G.segment_power(s, keys, index, "curvature_time_series", fps, nper, nover)
    s = G.frame_frequency(s, seg, keys, index, fps, nper, nover, tail=False)
    return W.polynomial_smooth(s, keys, index, METRICS)


def angle_statistics(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, population sd, extremes and quartiles of several columns."""
    from kymora.operators.ordered import exact_quantiles

    long = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(keys), list(values), "measure", "v")
    g = [*keys, "measure"]
    base = long.groupBy(*g).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return null_safe_join(base, exact_quantiles(long, g, "v", {"q25": 0.25, "q75": 0.75}), g)
