"""Short-time Fourier transforms and what follows from them.

Spectra are rows (track, frame, bin, re, im). The transform itself is an Arrow kernel over frames; everything after it
is expressions and windows over bins or frames.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scales import wrap_to_pi
from .frames import frame_arrays, hann, map_frames


def fft_frequencies(df: DataFrame, bins: int, sample_rate: float) -> DataFrame:
    """Add the centre frequency of ``bin``."""
    return df.withColumn("frequency", F.col("bin") * (sample_rate / (2.0 * bins)))


def stft(framed: DataFrame, size: int, window: list[float] | None = None, fft_size: int | None = None, circular_shift: bool = False, include_nyquist: bool = False, full_scale: float = 1.0) -> DataFrame:
    """Spectra of frames (track, frame, k, x): (track, frame, re array, im array).

    The window is scaled down for integer samples instead of the samples. ``circular_shift`` moves the frame's middle
    to the start, so that phases refer to it.
    """
    transform = _transform(size, window, fft_size, circular_shift, include_nyquist, full_scale)
    track_type = framed.schema["track"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            ks, xs = batch.column("ks"), batch.column("xs")
            lengths = np.diff(ks.offsets.to_numpy())
            block = np.zeros((count, size))
            block[np.repeat(np.arange(count), lengths), ks.flatten().to_numpy()] = xs.flatten().to_numpy()
            parts = []
            for part in transform(block).values():
                offsets = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
                parts.append(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(part).ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("track"), batch.column("frame"), *parts], names=["track", "frame", "re", "im"])

    rows = frame_arrays(framed.withColumn("x", F.col("x").cast("double")))
    return rows.mapInArrow(run, f"track {track_type}, frame bigint, re array<double>, im array<double>")


def _transform(size: int, window: list[float] | None, fft_size: int | None, circular_shift: bool, include_nyquist: bool, full_scale: float):
    """Spectra of a block of frames, as arrays re and im."""
    fft_size = fft_size or size
    if fft_size < size:
        raise ValueError("the transform is at least as long as the frame")
    taps = np.asarray(hann(size) if window is None else window, float) / full_scale
    bins, half = fft_size // 2 + (1 if include_nyquist else 0), size // 2

    def run(block: np.ndarray) -> dict[str, np.ndarray]:
        wide = np.zeros((len(block), fft_size))
        if circular_shift:
            wide[:, : size - half], wide[:, fft_size - half :] = block[:, half:] * taps[half:], block[:, :half] * taps[:half]
        else:
            wide[:, :size] = block * taps
        spectrum = np.fft.fft(wide)[:, :bins]
        return {"re": spectrum.real, "im": spectrum.imag}

    return run


def stft_of(samples: DataFrame, size: int, hop: float | None = None, *, fps: float | None = None, sample_rate: float | None = None, origin: int | str = 0, end: str = "normal", pad: float | str = 0.0, window: list[float] | None = None, fft_size: int | None = None, circular_shift: bool = False, include_nyquist: bool = False, full_scale: float = 1.0) -> DataFrame:
    """Framing and transform in one: samples (track, n, x) to (track, frame, re array, im array)."""
    transform = _transform(size, window, fft_size, circular_shift, include_nyquist, full_scale)
    return map_frames(samples, size, transform, "re array<double>, im array<double>", hop, fps=fps, sample_rate=sample_rate, origin=origin, end=end, pad=pad)


def bins_of(spectra: DataFrame) -> DataFrame:
    """Array spectra to rows (track, frame, bin, re, im)."""
    return spectra.select("track", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "_z")).select("track", "frame", F.col("bin").cast("bigint").alias("bin"), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def magnitude(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("mag", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def phase(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("phase", F.atan2("im", "re"))


def local_group_delay(phases: DataFrame) -> DataFrame:
    """Negative first difference over bins of the unwrapped phase; the last bin has zero.

    Unwrapping only changes a difference by turns to the nearest one, so no running sum is needed.
    """
    over = Window.partitionBy("track", "frame").orderBy("bin")
    step = F.lead("phase").over(over) - F.col("phase")
    wrapped = wrap_to_pi(step)
    # a jump of exactly half a turn keeps its sign
    unwrapped = F.when((wrapped == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(wrapped)
    return phases.withColumn("lgd", F.coalesce(-unwrapped, F.lit(0.0)))
