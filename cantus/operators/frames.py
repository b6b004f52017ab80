"""Framing: samples to overlapping frames.

A sample finds the frames that hold it by arithmetic, so framing is a generator and never a range join. Rows are
(track, frame, k, x), k being the place in the frame; samples outside the signal count as zero and have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import map_series

#: Frames that are made together: a recording is cut into runs of so many, each with the samples that they reach.
RUN = 256


def origin_of(origin: int | str, size: int) -> int:
    """Samples by which frames lie before their reference sample."""
    names = {"center": 0, "offline": 0, "left": (size - 1) / 2, "past": (size - 1) / 2, "online": (size - 1) / 2, "right": -(size / 2), "future": -(size / 2), "stream": -(size / 2)}
    return int(names[origin] if isinstance(origin, str) else origin)


def hop_of(hop: float | None, fps: float | None, sample_rate: float | None) -> float:
    if fps is not None:
        if sample_rate is None:
            raise ValueError("frames per second need a sample rate")
        return sample_rate / fps
    if hop is None or hop <= 0:
        raise ValueError("a hop must be positive")
    return float(hop)


def num_frames(samples: Column, hop: float, end: str = "normal") -> Column:
    if end not in ("normal", "extend"):
        raise ValueError(f"end is 'normal' or 'extend', not {end!r}")
    return F.ceil(samples / hop) if end == "normal" else F.floor(samples / hop + 1)


def frame(df: DataFrame, size: int, hop: float | None = None, *, fps: float | None = None, sample_rate: float | None = None, origin: int | str = 0, end: str = "normal") -> DataFrame:
    """Frames of samples (track, n, x)."""
    step = hop_of(hop, fps, sample_rate)
    before = size // 2 + origin_of(origin, size)
    n = F.col("n")
    sized = df.join(df.groupBy("track").agg(num_frames(F.max("n") + 1, step, end).alias("_frames")), "track")
    low = F.greatest(F.ceil((n + (before - size + 1)) / step), F.lit(0).cast("bigint"))
    high = F.least(F.ceil((n + (before + 1)) / step) - 1, F.col("_frames") - 1)
    spread = sized.select("track", "n", "x", low.alias("_low"), high.alias("_high")).filter("_low <= _high")
    spread = spread.select("track", F.explode(F.sequence("_low", "_high")).alias("frame"), "n", "x")
    return spread.select("track", "frame", (n - F.floor(F.col("frame") * step) + before).alias("k"), "x").filter((F.col("k") >= 0) & (F.col("k") < size))


def map_frames(df: DataFrame, size: int, fn: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, hop: float | None = None, *, fps: float | None = None, sample_rate: float | None = None, origin: int | str = 0, end: str = "normal", pad: float | str = 0.0, halo: int = 0) -> DataFrame:
    """Apply ``fn`` to blocks of whole frames (frames x size) of samples (track, n, x): (track, frame, columns of ``schema``).

    Samples are shuffled once, by track and run of frames; only those near a run's edge go to two runs. A recording of
    any length is many runs; its samples follow each other, so that a run whose samples end before its frames do holds
    the recording's end. Samples outside the recording are ``pad``, or its first and last with 'repeat'. With ``halo``,
    a block begins with so many frames of the run before, if there are any; their results are dropped.
    """
    step = hop_of(hop, fps, sample_rate)
    if end not in ("normal", "extend"):
        raise ValueError(f"end is 'normal' or 'extend', not {end!r}")
    before, repeat = size // 2 + origin_of(origin, size), pad == "repeat"
    dealt = run_rows(df, step, before, size, halo)

    def make(c):
        at, x = c["n"], c["x"]
        taken = frames_of(int(c["run"][0]), RUN, int(at[-1]) + 1, step, end, halo)
        if not len(taken):
            return {"frame": taken, **{k: v[:0] for k, v in fn(np.zeros((1, size))).items()}}
        line, starts = line_of(at, x, taken, step, before, size, 0.0 if repeat else float(pad))
        low = int(starts[0])
        if repeat:
            line[: max(0, -low)] = x[np.searchsorted(at, 0)] if low < 0 else 0.0
            line[max(0, int(at[-1]) + 1 - low) :] = x[-1]
        own = taken // RUN == c["run"][0]
        made = fn(line[(starts - low)[:, None] + np.arange(size)])
        return {"frame": taken[own], **{k: v[own] for k, v in made.items()}}

    return map_series(dealt, ["n", "x", "run"], make, f"frame bigint, {schema}", ("track", "run"), "n").drop("run")


def run_rows(df: DataFrame, step: float, before: int, size: int, halo: int = 0) -> DataFrame:
    """Samples (track, n, x) with each ``run`` of frames that reaches them, and with those whose frames refer to them."""
    n = F.col("n")
    low = F.least(F.ceil((n + (before - size + 1)) / step), F.floor(n / step))
    high = F.greatest(F.ceil((n + (before + 1)) / step) - 1, F.ceil((n + 1) / step))
    runs = F.sequence(F.greatest(F.floor(low / RUN), F.lit(0).cast("bigint")), F.floor((high + halo) / RUN))
    return df.select("track", "n", F.col("x").cast("double").alias("x"), F.explode(runs).alias("run"))


def frames_of(run: int, length: int, samples: int, step: float, end: str = "normal", halo: int = 0) -> np.ndarray:
    """Frames of a run of ``length`` and its halo in a recording of at least so many samples, of which the run's frames see the last."""
    count = math.ceil(samples / step) if end == "normal" else math.floor(samples / step + 1)
    last = min((run + 1) * length, count)
    return np.arange(max(0, run * length - halo), last) if last > run * length else np.zeros(0, np.int64)


def line_of(at: np.ndarray, x: np.ndarray, frames: np.ndarray, step: float, before: int, size: int, pad: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The samples that some frames span, with ``pad`` where there are none, and the frames' starts."""
    starts = np.floor(frames * step).astype(np.int64) - before
    low = int(starts[0])
    line = np.full(int(starts[-1]) + size - low, pad)
    inside = (at >= low) & (at < low + len(line))
    line[at[inside] - low] = x[inside]
    return line, starts


def frame_counts(df: DataFrame, hop: float, end: str = "normal") -> DataFrame:
    return df.groupBy("track").agg(num_frames(F.max("n") + 1, hop, end).alias("frames"))


def frame_arrays(framed: DataFrame) -> DataFrame:
    """(track, frame, ks, xs): the places that hold samples and the samples, in order."""
    rows = framed.groupBy("track", "frame").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("_s"))
    return rows.select("track", "frame", F.col("_s.k").alias("ks"), F.col("_s.x").alias("xs"))


def segment_axis(df: DataFrame, size: int, hop: int) -> DataFrame:
    """Whole windows of ``size`` samples every ``hop``, without padding: (track, segment, k, x)."""
    n, sized = F.col("n"), df.join(df.groupBy("track").agg(F.max("n").alias("_last")), "track")
    low = F.greatest(F.ceil((n - (size - 1)) / hop), F.lit(0).cast("bigint"))
    high = F.least(F.floor(n / hop), F.floor((F.col("_last") + 1 - size) / hop))
    spread = sized.select("track", "n", "x", low.alias("_low"), high.alias("_high")).filter("_low <= _high")
    return spread.select("track", F.explode(F.sequence("_low", "_high")).alias("segment"), "n", "x").select("track", "segment", (n - F.col("segment") * hop).alias("k"), "x")


def hann(size: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * k / (size - 1)) for k in range(size)]
