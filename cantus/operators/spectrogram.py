"""Operators on spectrogram tables (track, frame, bin, mag)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import RUN, hann
from .series import map_series


def apply_filterbank(spec: DataFrame, filterbank: DataFrame) -> DataFrame:
    """Weighted sums over bins: (track, frame, bin = band, mag). Frames without a bin of a band lack it.

    The filterbank is a table of fixed size, so it is broadcast; sums are combined before the shuffle.
    """
    joined = spec.join(F.broadcast(filterbank), "bin")
    return joined.groupBy("track", "frame", F.col("band").cast("bigint").alias("bin")).agg(F.sum(F.col("mag") * F.col("weight")).alias("mag"))


def log_compress(spec: DataFrame, mul: float | None = 1.0, add: float | None = 1.0, base: float | None = 10.0) -> DataFrame:
    x = F.col("mag")
    x = x if mul is None else x * mul
    x = x if add is None else x + add
    return spec.withColumn("mag", x if base is None else F.log10(x) if base == 10 else F.ln(x))


def max_filter(spec: DataFrame, bins: int, value: str = "mag", to: str = "mag") -> DataFrame:
    """Largest value of the neighbouring bins; at the edges of what there is."""
    over = Window.partitionBy("track", "frame").orderBy("bin").rowsBetween(-(bins // 2), (bins - 1) // 2)
    return spec.withColumn(to, F.max(value).over(over))


def diff_frames(ratio: float, hop: float, size: int, window: list[float] | None = None) -> int:
    """Frames to go back until windows overlap by less than where they reach ``ratio`` of their height."""
    taps = hann(size) if window is None else window
    first = next(i for i, w in enumerate(taps) if w > ratio * max(taps))
    return max(1, round((len(taps) / 2 - first) / hop))


def difference(spec: DataFrame, frames: int = 1, max_bins: int | None = None, positive: bool = False, keep_dims: bool = True) -> DataFrame:
    """Add ``diff``: the magnitude less that of ``frames`` before (there the largest of ``max_bins`` bins), 0 at the start."""
    if frames < 1:
        raise ValueError("a difference goes back a frame at least")
    before, made = ("mag", spec) if not max_bins or max_bins < 2 else ("_max", max_filter(spec, max_bins, to="_max"))
    series = Window.partitionBy("track", "bin").orderBy("frame")
    diff = F.col("mag") - F.lag(before, frames).over(series)
    diff = F.when(diff > 0, diff).when(diff.isNotNull(), F.lit(0.0)) if positive else diff
    out = made.withColumn("diff", diff).drop("_max")
    return out.withColumn("diff", F.coalesce("diff", F.lit(0.0))) if keep_dims else out.filter("diff IS NOT NULL")


def stack_difference(spec: DataFrame, bins: int, frames: int = 1, positive: bool = True) -> DataFrame:
    """The spectrogram with its difference as further bins."""
    both = difference(spec, frames, positive=positive)
    pair = F.array(F.struct(F.col("bin").alias("bin"), F.col("mag").alias("mag")), F.struct((F.col("bin") + bins).alias("bin"), F.col("diff").alias("mag")))
    return both.select("track", "frame", F.inline(pair))


def context(spec: DataFrame, frames: int, bins: int) -> DataFrame:
    """Each frame with its neighbours as further bins: (track, frame, bin, mag), zeros outside the clip left out."""
    around = frames // 2
    sized = spec.join(spec.groupBy("track").agg(F.max("frame").alias("_last")), "track")
    spread = sized.withColumn("_at", F.explode(F.sequence(F.lit(-around), F.lit(frames - 1 - around))))
    target = F.col("frame") - F.col("_at")
    return spread.select("track", target.alias("frame"), ((F.col("_at") + around) * bins + F.col("bin")).alias("bin"), "mag", "_last").filter("frame BETWEEN 0 AND _last").drop("_last")


def superflux(spec: DataFrame, filterbank: DataFrame, mul: float = 1.0, add: float = 1.0, frames: int = 1, max_bins: int = 3) -> DataFrame:
    """Filter, compress and take the positive max-filtered difference."""
    return difference(log_compress(apply_filterbank(spec, filterbank), mul, add), frames, max_bins, positive=True)


def dct(spec: DataFrame, coefficients: int | None = None, length: int | None = None) -> DataFrame:
    """Type-II cosine transform over bins, not normalised: (track, frame, coef, value).

    ``length`` is the number of bins where it is known; otherwise it is each frame's own.
    """
    size = F.lit(length) if length else F.count("*").over(Window.partitionBy("track", "frame"))
    sized = spec.withColumn("_n", size)
    spread = sized.withColumn("coef", F.explode(F.sequence(F.lit(0), (F.lit(coefficients) if coefficients else F.col("_n")) - 1)))
    angle = F.col("coef") * (F.col("bin") * 2 + 1) * math.pi / (F.col("_n") * 2)
    return spread.groupBy("track", "frame", "coef").agg((F.sum(F.col("mag") * F.cos(angle)) * 2).alias("value"))


def mfcc(spec: DataFrame, mel: DataFrame, bands: int, mul: float = 1.0, add: float = 0.0, coefficients: int | None = None) -> DataFrame:
    """Cosine transform of log mel energies; with ``add`` 0 a silent band is minus infinity."""
    energies = apply_filterbank(spec, mel)
    logged = energies.withColumn("mag", F.when(F.col("mag") * mul + add > 0, F.log10(F.col("mag") * mul + add)).otherwise(F.lit(float("-inf"))))
    return dct(logged, coefficients, bands)


def pitch_class_profile(spec: DataFrame, filterbank: DataFrame) -> DataFrame:
    return apply_filterbank(spec, filterbank)


def clp_chroma(semitones: DataFrame, factor: float = 100.0, threshold: float = 0.001) -> DataFrame:
    """Log-compressed chroma of semitone energies (track, frame, midi, energy) with unit length; weak frames are flat."""
    folded = semitones.groupBy("track", "frame", F.pmod(F.col("midi"), F.lit(12)).alias("pc")).agg(F.sum(F.log10(F.col("energy") * factor + 1)).alias("value"))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("track", "frame")))
    sized = folded.withColumn("_length", length)
    return sized.select("track", "frame", "pc", F.when(F.col("_length") < threshold, F.lit(1 / math.sqrt(12))).otherwise(F.col("value") / F.col("_length")).alias("value"))


def selected_median(columns: list[np.ndarray]) -> np.ndarray:
    """Median of an odd number of equally shaped arrays, place by place, by a network of minima and maxima.

    One more than half of them are held; whatever is least or largest of those can't be the median, as too many others lie
    on its other side, and makes room for the next one.
    """
    held, waiting = list(columns[: len(columns) // 2 + 2]), list(columns[len(columns) // 2 + 2 :])
    while len(held) > 1:
        if len(held) == 2:  # of an even rest, which odd numbers don't leave
            raise ValueError("a median needs an odd number of values")
        for i in range(len(held) - 1, 0, -1):  # the least goes to the front
            held[i - 1], held[i] = np.minimum(held[i - 1], held[i]), np.maximum(held[i - 1], held[i])
        for i in range(1, len(held) - 1):  # the largest of the others to the end
            held[i], held[i + 1] = np.minimum(held[i], held[i + 1]), np.maximum(held[i], held[i + 1])
        held = held[1:-1] + waiting[:1]
        waiting = waiting[1:]
    return held[0]


def running_median(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Medians over ``size`` neighbours (an odd number; one more if even) along an axis, borders reflected with the edge repeated."""
    reach, length = size // 2, x.shape[axis]
    wide = np.pad(x, [(reach, reach) if i == axis else (0, 0) for i in range(x.ndim)], mode="symmetric")
    return selected_median([np.take(wide, range(k, k + length), axis) for k in range(2 * reach + 1)])


def _medians(spec: DataFrame, sizes: dict[str, tuple[str, int]]) -> DataFrame:
    """Running medians of whole spectra in runs of frames: columns by name, each along an axis over so many neighbours.

    A run has the frames around it that its medians see, and the recording's end where there are fewer; frames follow each
    other from 0, each with the same bins.
    """
    reach = max([size // 2 for axis, size in sizes.values() if axis == "frame"], default=0)
    length = max(RUN, reach)
    frame = F.col("frame")
    runs = F.sequence(F.greatest(F.floor((frame - reach) / length), F.lit(0).cast("bigint")), F.floor((frame + reach) / length))
    dealt = spec.select("track", "frame", F.col("bin").cast("bigint").alias("bin"), F.col("mag").cast("double").alias("mag"), F.explode(runs).alias("run"))

    def run(c):
        frames, at = np.unique(c["frame"], return_inverse=True)
        bins, to = np.unique(c["bin"], return_inverse=True)
        if len(frames) * len(bins) != len(at) or frames[-1] - frames[0] + 1 != len(frames):
            raise ValueError("medians need whole spectra of consecutive frames")
        x = np.empty((len(frames), len(bins)))
        x[at, to] = c["mag"]
        own = frames // length == c["run"][0]
        n = int(own.sum())
        made = {name: running_median(x, size, 0 if axis == "frame" else 1)[own].ravel() for name, (axis, size) in sizes.items()}
        return {"frame": np.repeat(frames[own], len(bins)), "bin": np.tile(bins, n), "mag": x[own].ravel(), **made}

    return map_series(dealt, ["frame", "bin", "mag", "run"], run, "frame bigint, bin bigint, mag double, " + ", ".join(f"`{n}` double" for n in sizes), ("track", "run")).drop("run")


def median_filter(spec: DataFrame, size: int, axis: str, to: str) -> DataFrame:
    """Median over ``size`` neighbours along frames or bins, with reflected borders: (track, frame, bin, mag, ``to``)."""
    return _medians(spec, {to: (axis, size)})


def hpss(spec: DataFrame, masking: str | float = "binary", harmonic: int = 15, percussive: int = 15) -> DataFrame:
    """Harmonic and percussive parts by median filters along frames and bins; soft masks have a power."""
    both = _medians(spec, {"h": ("frame", harmonic), "p": ("bin", percussive)})
    h, p = F.col("h"), F.col("p")
    if masking == "binary":
        mask_h, mask_p = F.when(h > p, 1.0).otherwise(0.0), F.when(p >= h, 1.0).otherwise(0.0)
    else:
        hp, pp = F.pow(h, F.lit(float(masking))), F.pow(p, F.lit(float(masking)))
        mask_h, mask_p = F.when(hp + pp > 0, hp / (hp + pp)).otherwise(0.0), F.when(hp + pp > 0, pp / (hp + pp)).otherwise(0.0)
    return both.withColumn("harmonic", F.col("mag") * mask_h).withColumn("percussive", F.col("mag") * mask_p)
