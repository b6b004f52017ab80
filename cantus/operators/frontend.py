"""Log spectra and their differences at several resolutions, from one exchange of samples, with gradients.

Frames of all sizes refer to the same sample, so the smaller ones lie in the middle of the largest. A run of frames is
cut out once; every branch windows, transforms, filters and compresses its part of it, and takes the difference to
earlier frames, of which the run holds as many as the longest lag. The way back runs over the same runs: each one adds
what its frames' results owe to its samples, and sums over (track, n) overlap and add the runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filterbanks
from .frames import RUN, frames_of, hann, line_of, map_frames, run_rows
from .series import map_series
from .spectrogram import diff_frames


@dataclass(frozen=True)
class Branch:
    """A frame size with its filterbank (bins x bands), and how many frames its difference goes back (None: no difference)."""

    size: int
    bank: np.ndarray
    lag: int | None = None


def matrix_of(filterbank: DataFrame, bins: int) -> np.ndarray:
    """A filterbank table (band, bin, weight), whose size its parameters fix, as an array (bins x bands)."""
    rows = filterbank.collect()
    out = np.zeros((bins, 1 + max((r["band"] for r in rows), default=-1)))
    for r in rows:
        out[r["bin"], r["band"]] = r["weight"]
    return out[:, out.any(0)]


def log_branches(spark, sample_rate: float, plan: tuple[tuple[int, int], ...], fps: float, diff_ratio: float | None = 0.5, fmin: float = 30.0, fmax: float = 17000.0) -> list[Branch]:
    """Logarithmic bands per frame size, with differences that go back until frames overlap by less than ``diff_ratio``."""
    return [
        Branch(size, matrix_of(filterbanks.log_filterbank(spark, size // 2, sample_rate, per_octave, fmin, fmax), size // 2), None if diff_ratio is None else diff_frames(diff_ratio, sample_rate / fps, size))
        for size, per_octave in plan
    ]


def mel_branches(spark, sample_rate: float, sizes: tuple[int, ...], bands: int, fmin: float, fmax: float) -> list[Branch]:
    return [Branch(size, matrix_of(filterbanks.mel_filterbank(spark, size // 2, sample_rate, bands, fmin, fmax), size // 2)) for size in sizes]


class _Parts:
    """A branch's steps on blocks of the largest frames, forth and back."""

    def __init__(self, branch: Branch, largest: int, mul: float, add: float, base: float) -> None:
        self.branch, self.size, self.at = branch, branch.size, largest // 2 - branch.size // 2
        self.window, self.mul, self.add, self.scale = np.asarray(hann(branch.size)), mul, add, 1 / math.log(base)

    def spectrum(self, block: np.ndarray) -> np.ndarray:
        return np.fft.rfft(block[:, self.at : self.at + self.size] * self.window)[:, : self.size // 2]

    def logged(self, spectrum: np.ndarray) -> np.ndarray:
        return np.log(np.abs(spectrum) @ self.branch.bank * self.mul + self.add) * self.scale

    def differences(self, logged: np.ndarray) -> np.ndarray:
        out = np.zeros_like(logged)
        lag = self.branch.lag
        out[lag:] = np.maximum(logged[lag:] - logged[:-lag], 0) if lag < len(logged) else 0
        return out

    def forward(self, block: np.ndarray) -> list[np.ndarray]:
        logged = self.logged(self.spectrum(block))
        return [logged] if self.branch.lag is None else [logged, self.differences(logged)]

    def width(self) -> int:
        return self.branch.bank.shape[1] * (1 if self.branch.lag is None else 2)

    def backward(self, block: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Gradient of a block's samples from that of ``forward``'s columns."""
        spectrum = self.spectrum(block)
        strength = np.abs(spectrum)
        bands = strength @ self.branch.bank * self.mul + self.add
        logged = np.log(bands) * self.scale
        count = logged.shape[1]
        at_log = grad[:, :count].copy()
        if (lag := self.branch.lag) is not None and lag < len(logged):
            passed = grad[lag:, count:] * (logged[lag:] > logged[:-lag])
            at_log[lag:] += passed
            at_log[:-lag] -= passed
        at_strength = (at_log * self.scale * self.mul / bands) @ self.branch.bank.T
        # a silent bin has no direction
        turned = np.divide(at_strength * spectrum, strength, out=np.zeros_like(spectrum), where=strength > 0)
        wide = np.zeros((len(block), self.size), complex)
        wide[:, : self.size // 2] = turned
        out = np.zeros_like(block)
        out[:, self.at : self.at + self.size] = (np.fft.ifft(wide).real * self.size) * self.window
        return out


def _parts(branches: list[Branch], mul: float, add: float, base: float) -> tuple[int, int, list[_Parts]]:
    largest = max(b.size for b in branches)
    return largest, max((b.lag or 0 for b in branches), default=0), [_Parts(b, largest, mul, add, base) for b in branches]


def front_end(samples: DataFrame, sample_rate: float, branches: list[Branch], fps: float = 100.0, mul: float = 1.0, add: float = 1.0, base: float = 10.0, interleaved: bool = False) -> DataFrame:
    """(track, frame, x array): the branches one after the other, each its bands and then its differences.

    ``interleaved`` puts the branches of a band next to each other, for branches of equal widths.
    """
    largest, halo, parts = _parts(branches, mul, add, base)

    def run(block):
        columns = [v for p in parts for v in p.forward(block)]
        x = np.stack(columns, 2).reshape(len(block), -1) if interleaved else np.concatenate(columns, 1)
        return {"x": x}

    return map_frames(samples, largest, run, "x array<double>", fps=fps, sample_rate=sample_rate, halo=halo)


def front_end_gradient(samples: DataFrame, gradients: DataFrame, sample_rate: float, branches: list[Branch], fps: float = 100.0, mul: float = 1.0, add: float = 1.0, base: float = 10.0) -> DataFrame:
    """(track, n, g): the gradient of the samples, given that of ``front_end``'s columns (track, frame, g array).

    Frames without a row in ``gradients`` have none. At a difference of exactly zero and at a silent bin it is zero.
    """
    largest, halo, parts = _parts(branches, mul, add, base)
    step, before, first = sample_rate / fps, largest // 2, -(1 << 62)
    cuts = np.cumsum([0, *(p.width() for p in parts)])
    rows = run_rows(samples, step, before, largest, halo).withColumn("g", F.lit(None).cast("array<double>"))
    given = gradients.select("track", (F.col("frame") + first).alias("n"), F.lit(0.0).alias("x"), F.floor(F.col("frame") / RUN).alias("run"), "g")

    def back(c):
        head = c["n"] < 0
        at, x, run = c["n"][~head], c["x"][~head], int(c["run"][0])
        frames = frames_of(run, RUN, int(at[-1]) + 1, step, "normal", halo) if len(at) else np.zeros(0, np.int64)
        if not len(frames) or not head.any():
            return {"n": np.zeros(0, np.int64), "g": np.zeros(0)}
        line, starts = line_of(at, x, frames, step, before, largest)
        low = int(starts[0])
        places = (starts - low)[:, None] + np.arange(largest)
        block, grad, owed = line[places], np.zeros((len(frames), int(cuts[-1]))), np.zeros(len(line))
        for frame, g in zip(c["n"][head] - first, c["g"][head]):
            if frame <= frames[-1]:
                grad[frame - frames[0]] = g
        for p, lo, hi in zip(parts, cuts, cuts[1:]):
            np.add.at(owed, places, p.backward(block, grad[:, lo:hi]))
        n = np.arange(low, low + len(line))
        held = (n >= 0) & (n <= at[-1])
        return {"n": n[held], "g": owed[held]}

    made = map_series(rows.unionByName(given), ["n", "x", "run", "g"], back, "n bigint, g double", ("track", "run"), "n")
    return made.groupBy("track", "n").agg(F.sum("g").alias("g"))
