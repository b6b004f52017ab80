"""Onset detection functions and peak picking."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scales import wrap_to_pi
from .series import map_series
from .signal import smooth
from .spectrogram import difference

EPSILON = 2.220446049250313e-16


def _per_frame(df: DataFrame, value) -> DataFrame:
    return df.groupBy("track", "frame").agg(value.alias("a"))


def high_frequency_content(spec: DataFrame) -> DataFrame:
    return _per_frame(spec, F.avg(F.col("mag") * F.col("bin")))


def spectral_diff(spec: DataFrame, frames: int = 1) -> DataFrame:
    return _per_frame(difference(spec, frames, positive=True), F.sum(F.col("diff") * F.col("diff")))


def spectral_flux(spec: DataFrame, frames: int = 1) -> DataFrame:
    return _per_frame(difference(spec, frames, positive=True), F.sum("diff"))


def superflux(spec: DataFrame, frames: int = 1, max_bins: int = 3) -> DataFrame:
    return _per_frame(difference(spec, frames, max_bins, positive=True), F.sum("diff"))


def modified_kullback_leibler(spec: DataFrame, frames: int = 1, epsilon: float = EPSILON) -> DataFrame:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    before = F.lag("mag", frames).over(Window.partitionBy("track", "bin").orderBy("frame"))
    return _per_frame(spec.withColumn("_r", F.coalesce(F.ln(F.col("mag") / (before + epsilon) + 1), F.lit(0.0))), F.avg("_r"))


def correlation_diff(spec: DataFrame, frames: int = 1, positive: bool = False, bins: int = 1) -> DataFrame:
    """Difference to an earlier frame shifted by the few bins at which the two agree most (the first of equals)."""
    earlier = spec.select("track", (F.col("frame") + frames).alias("frame"), F.col("bin"), F.col("mag").alias("_m"))
    shifts = earlier.withColumn("shift", F.explode(F.sequence(F.lit(-bins), F.lit(bins)))).withColumn("bin", F.col("bin") + F.col("shift"))
    pairs = spec.join(shifts, ["track", "frame", "bin"])
    scored = pairs.groupBy("track", "frame", "shift").agg(F.sum(F.col("mag") * F.col("_m")).alias("score"))
    best = scored.groupBy("track", "frame").agg(F.max_by("shift", F.struct("score", -F.col("shift"))).alias("shift"))
    moved = pairs.join(best, ["track", "frame", "shift"]).select("track", "frame", "bin", (F.col("mag") - F.col("_m")).alias("_d"))
    diff = F.coalesce(F.greatest("_d", F.lit(0.0)) if positive else F.col("_d"), F.lit(0.0))
    return spec.join(moved, ["track", "frame", "bin"], "left").select("track", "frame", "bin", "mag", diff.alias("diff"))


def complex_flux(spec: DataFrame, frames: int = 1, max_bins: int = 3, temporal: int = 3, origin: int = 0, delays: DataFrame | None = None, filterbank: DataFrame | None = None) -> DataFrame:
    """Superflux weighted by the share of half a turn that the local group delay is: where it is small, tremolo is damped.

    The delay (column lgd) is the largest of ``temporal`` frames, moved back by ``origin``, and then the least of the
    neighbouring bins. A filtered spectrogram takes its delays from the unfiltered ``delays`` (track, frame, bin, lgd):
    the least from one bin below a band of the filterbank to one above it.
    """
    delay = (spec if delays is None else delays).withColumn("_l", F.abs("lgd") / math.pi)
    if temporal > 0:
        before = temporal // 2 + origin
        delay = delay.withColumn("_l", F.max("_l").over(Window.partitionBy("track", "bin").orderBy("frame").rowsBetween(-before, temporal - 1 - before)))
    if filterbank is None:
        mask = delay.withColumn("_l", F.min("_l").over(Window.partitionBy("track", "frame").orderBy("bin").rowsBetween(-1, 1)))
    else:
        spans = filterbank.filter("weight <> 0").groupBy("band").agg(F.sequence(F.min("bin") - 1, F.max("bin") + 1).alias("bins"))
        reached = delay.join(F.broadcast(spans.select("band", F.explode("bins").alias("bin"))), "bin")
        least = reached.groupBy("track", "frame", F.col("band").cast("bigint").alias("bin")).agg(F.min("_l").alias("_l"))
        mask = spec.join(least, ["track", "frame", "bin"])
    return _per_frame(difference(mask, frames, max_bins, positive=True), F.sum(F.col("diff") * F.col("_l")))


def _deviation(spec: DataFrame) -> DataFrame:
    series = Window.partitionBy("track", "bin").orderBy("frame")
    second = F.col("phase") - F.lag("phase", 1).over(series) * 2 + F.lag("phase", 2).over(series)
    return spec.withColumn("_pd", F.coalesce(wrap_to_pi(second), F.lit(0.0)))


def phase_deviation(spec: DataFrame) -> DataFrame:
    return _per_frame(_deviation(spec), F.avg(F.abs("_pd")))


def weighted_phase_deviation(spec: DataFrame) -> DataFrame:
    return _per_frame(_deviation(spec), F.avg(F.abs(F.col("_pd") * F.col("mag"))))


def normalized_weighted_phase_deviation(spec: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    return _per_frame(_deviation(spec), F.avg(F.abs(F.col("_pd") * F.col("mag"))) / (F.avg("mag") + epsilon))


def _complex_difference(spec: DataFrame) -> DataFrame:
    """Distance of each bin from its steady continuation: previous magnitude, phase going on at the same rate."""
    series = Window.partitionBy("track", "bin").orderBy("frame")
    angle = F.lag("phase", 1).over(series) * 2 - F.lag("phase", 2).over(series)
    angle = F.coalesce(angle, F.lag("phase", 1).over(series) * 2, F.lit(0.0))
    before = F.coalesce(F.lag("mag", 1).over(series), F.lit(0.0))
    re = F.col("mag") * F.cos("phase") - before * F.cos(angle)
    im = F.col("mag") * F.sin("phase") - before * F.sin(angle)
    return spec.withColumn("_cd", F.sqrt(re * re + im * im)).withColumn("_rise", F.col("mag") > F.lag("mag", 1).over(series))


def complex_domain(spec: DataFrame) -> DataFrame:
    return _per_frame(_complex_difference(spec), F.sum("_cd"))


def rectified_complex_domain(spec: DataFrame) -> DataFrame:
    return _per_frame(_complex_difference(spec), F.sum(F.when(F.col("_rise"), F.col("_cd")).otherwise(F.lit(0.0))))


METHODS = {
    "high_frequency_content": high_frequency_content, "spectral_diff": spectral_diff, "spectral_flux": spectral_flux, "superflux": superflux,
    "complex_flux": complex_flux, "modified_kullback_leibler": modified_kullback_leibler, "phase_deviation": phase_deviation, "weighted_phase_deviation": weighted_phase_deviation,
    "normalized_weighted_phase_deviation": normalized_weighted_phase_deviation, "complex_domain": complex_domain, "rectified_complex_domain": rectified_complex_domain,
}


def onset_function(spec: DataFrame, method: str = "spectral_flux", **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"no onset method {method!r}; there are {', '.join(METHODS)}")
    return METHODS[method](spec, **options)


def peak_picking(acts: DataFrame, threshold: float, smooth_by: int | list[float] | None = None, pre_avg: int = 0, post_avg: int = 0, pre_max: int = 1, post_max: int = 1, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Rows (keys, frame, a) that reach the moving average plus threshold and are the largest of their surroundings.

    Averages divide by the whole length and maxima see zeros outside the series.
    """
    smoothed = smooth(acts, smooth_by, keys, "frame", "a")
    series = Window.partitionBy(*keys).orderBy("frame")
    average = F.sum("a").over(series.rowsBetween(-pre_avg, post_avg)) / (pre_avg + post_avg + 1)
    sized = smoothed.withColumn("_least", average + threshold if pre_avg + post_avg > 0 else F.lit(threshold))
    held = sized.withColumn("_held", F.when(F.col("a") >= F.col("_least"), F.col("a")).otherwise(F.lit(0.0)))
    if pre_max + post_max > 0:
        largest = F.greatest(F.max("_held").over(series.rowsBetween(-pre_max, post_max)), F.lit(0.0))
        held = held.withColumn("_held", F.when(F.col("_held") == largest, F.col("_held")).otherwise(F.lit(0.0)))
    return held.filter(F.col("_held") > 0).drop("_least", "_held")


def frames_of(value: float, fps: float) -> int:
    """Seconds to frames, halves to even."""
    return round(value * fps)


def combine_events(events: DataFrame, delta: float, how: str = "mean", keys: tuple[str, ...] = ("track",), time: str = "t") -> DataFrame:
    """Merge events of a series that are within ``delta`` of the last one kept.

    'left' keeps the first, 'right' the last, 'mean' moves the kept one half way each time. What 'right' keeps is the
    last event before each gap; the others depend on what was kept before, so a series is gone through once, in order.
    """
    if how not in ("mean", "left", "right"):
        raise ValueError(f"no way {how!r} to combine events")
    reach = delta + 1e-12
    if how == "right":
        gap = F.lead(time).over(Window.partitionBy(*keys).orderBy(time)) - F.col(time)
        return events.select(*keys, time).withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > reach)).drop("_gap")

    def kept(c):
        out: list[float] = []
        for t in c[time].tolist():
            if out and t - out[-1] <= reach:
                out[-1] = (out[-1] + t) * 0.5 if how == "mean" else out[-1]
            else:
                out.append(t)
        return {time: np.asarray(out)}

    return map_series(events, [time], kept, f"`{time}` double", keys, time)


def pick_onsets(acts: DataFrame, fps: float, threshold: float, smooth_s: float = 0.0, pre_avg: float = 0.0, post_avg: float = 0.0, pre_max: float = 0.0, post_max: float = 0.0, combine: float = 0.03, delay: float = 0.0, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Onset times in seconds; all spans are in seconds."""
    n = lambda v: frames_of(v, fps)
    peaks = peak_picking(acts, threshold, n(smooth_s) or None, n(pre_avg), n(post_avg), n(pre_max), n(post_max), keys)
    times = peaks.select(*keys, (F.col("frame") / fps + delay).alias("t"))
    return combine_events(times, combine, "left", keys) if combine else times
