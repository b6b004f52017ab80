"""Operators on sample tables (track, n, x), or (track, n, ch, x) with channels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .series import map_series

#: What silence has instead of minus infinity.
LEAST = -1.7976931348623157e308


def _is_integer(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, IntegralType)


def remix(df: DataFrame, num_channels: int, channel: int | None = None) -> DataFrame:
    """Change the channels: pick one, average to one (integers are cut toward zero), or repeat one to several."""
    kind = df.schema["x"].dataType
    if channel is not None:
        return df.filter(F.col("ch") == channel).withColumn("ch", F.lit(0))
    if num_channels == 1:
        return df.groupBy("track", "n").agg(F.avg("x").cast(kind).alias("x")).withColumn("ch", F.lit(0)).select("track", "n", "ch", "x")
    return df.filter(F.col("ch") == 0).withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(num_channels - 1)))).select("track", "n", "ch", "x")


def normalize(df: DataFrame, full_scale: float = 1.0) -> DataFrame:
    """Scale each track so that its largest magnitude is ``full_scale``; a silent track gives null."""
    peaks = df.groupBy("track").agg(F.max(F.abs("x")).alias("_peak"))
    return df.join(peaks, "track").withColumn("x", F.col("x") / F.nullif("_peak", F.lit(0.0)) * full_scale).select(*df.columns)


def adjust_gain(df: DataFrame, gain: float) -> DataFrame:
    """Amplify by decibels; integer samples cannot be amplified."""
    if gain > 0 and _is_integer(df, "x"):
        raise ValueError("a positive gain would clip integer samples")
    return df.withColumn("x", (F.col("x") * math.sqrt(10.0) ** (0.1 * gain)).cast(df.schema["x"].dataType))


def attenuate(df: DataFrame, attenuation: float) -> DataFrame:
    return df if attenuation == 0 else adjust_gain(df, -attenuation)


def rescale(df: DataFrame, full_scale: float = 32767.0) -> DataFrame:
    """Integer samples to fractions of the full scale."""
    return df.withColumn("x", F.col("x").cast("double") / full_scale)


def hamming(size: int) -> list[float]:
    if size <= 1:
        raise ValueError("a smoothing window has two samples at least")
    return [0.54 - 0.46 * math.cos(2 * math.pi * k / (size - 1)) for k in range(size)]


def smooth(df: DataFrame, kernel: int | list[float] | None, keys: tuple[str, ...] = ("track",), order: str = "n", value: str = "x") -> DataFrame:
    """Convolve each series with a Hamming window of that size (not normalised) or a kernel; the length stays."""
    if kernel is None or kernel == 0:
        return df
    taps = hamming(kernel) if isinstance(kernel, int) else list(kernel)
    series, back = Window.partitionBy(*keys).orderBy(order), (len(taps) - 1) // 2
    terms = [F.coalesce(F.lag(value, k - back).over(series), F.lit(0.0)) * tap for k, tap in enumerate(taps)]
    return df.withColumn(value, sum(terms[1:], terms[0]))


def trim(df: DataFrame, where: str = "fb") -> DataFrame:
    """Drop silence at the front ('f'), the back ('b') or both."""
    sounding = df.filter(F.col("x") != 0).groupBy("track").agg(F.min("n").alias("_first"), F.max("n").alias("_last"))
    marked, inside = df.join(sounding, "track"), F.lit(True)
    if "f" in where:
        inside &= F.col("n") >= F.col("_first")
    if "b" in where:
        inside &= F.col("n") <= F.col("_last")
    return marked.filter(inside).select(*df.columns)


def levels(df: DataFrame, keys: tuple[str, ...] = ("track",), p_ref: float = 1.0) -> DataFrame:
    """Per series: energy, rms and sound pressure level against ``p_ref`` (silence has the least number)."""
    square = F.col("x").cast("double") * F.col("x").cast("double")
    out = df.groupBy(*keys).agg(F.sum(square).alias("energy"), F.sqrt(F.avg(square)).alias("rms"))
    return out.withColumn("spl", F.when(F.col("rms") > 0, F.log10(F.col("rms") / p_ref) * 20).otherwise(F.lit(LEAST)))


#: Output samples that one kernel call of a resampler makes.
RESAMPLED = 1 << 15


def resample(df: DataFrame, up: int, down: int, half_width: int = 10, beta: float = 5.0) -> DataFrame:
    """Polyphase resampling of samples (track, n, x) by up/down with a Kaiser-windowed sinc.

    The output is cut into runs, each with the input samples that its filters reach, so a recording is many tasks and
    every sample is shuffled once but near a run's edge. A run whose samples end before its reach does holds the
    recording's end; samples outside a recording are zero.
    """
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return df
    widest = max(up, down)
    reach = half_width * widest
    t = np.arange(2 * reach + 1) - reach
    h = np.sinc(t / widest) * np.kaiser(2 * reach + 1, beta)
    h = h / h.sum() * up
    taps = 2 * reach // up + 1
    # output m takes input n by tap m * down - n * up + reach
    n = F.col("n")
    low = F.greatest(F.floor(F.ceil((n * up - reach) / down) / RESAMPLED), F.lit(0).cast("bigint"))
    high = F.floor((F.floor((n * up + reach) / down) + 1) / RESAMPLED)
    dealt = df.select("track", "n", F.col("x").cast("double").alias("x"), F.explode(F.sequence(low, high)).alias("run"))

    def make(c):
        first, count = int(c["run"][0]) * RESAMPLED, (int(c["n"][-1]) + 1) * up // down
        m = np.arange(first, max(first, min(first + RESAMPLED, count)))
        if not len(m):
            return {"m": m, "y": np.zeros(0)}
        start = -((reach - m * down) // up)  # the first input within reach
        begin = int(start[0])
        line = np.zeros(int(start[-1]) + taps - begin)
        inside = (c["n"] >= begin) & (c["n"] < begin + len(line))
        line[c["n"][inside] - begin] = c["x"][inside]
        windows, y, phase = np.lib.stride_tricks.sliding_window_view(line, taps), np.empty(len(m)), m * down - start * up
        for p in np.unique(phase).tolist():
            at = np.flatnonzero(phase == p)
            tap = p - np.arange(taps) * up + reach
            weights = np.where((tap >= 0) & (tap <= 2 * reach), h[np.clip(tap, 0, 2 * reach)], 0.0)
            for lo in range(0, len(at), 2048):
                y[at[lo : lo + 2048]] = windows[start[at[lo : lo + 2048]] - begin] @ weights
        return {"m": m, "y": y}

    made = map_series(dealt, ["n", "x", "run"], make, "m bigint, y double", ("track", "run"), "n")
    return made.select("track", F.col("m").alias("n"), F.col("y").alias("x"))
