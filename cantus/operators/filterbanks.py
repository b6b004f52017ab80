"""Filterbanks as tables (band, bin, weight), to be joined with spectra.

A filterbank's size follows from its parameters (bins times bands at most), not from the data, so it is built from
ranges with the same expressions that run over data, and may be broadcast.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scales import A4, BARK, BARK_DOUBLE, hz2mel, mel2hz


def _numbered(df: DataFrame, order: str = "frequency") -> DataFrame:
    return df.withColumn("idx", F.row_number().over(Window.orderBy(order)) - 1)


def log_frequencies(spark: SparkSession, per_octave: int, fmin: float, fmax: float, fref: float = A4) -> DataFrame:
    """(idx, frequency): equal steps of the octave around ``fref`` within the limits."""
    low = math.floor(math.log2(fmin / fref) * per_octave)
    high = math.ceil(math.log2(fmax / fref) * per_octave)
    steps = spark.range(low, high).select((F.pow(F.lit(2.0), F.col("id") / per_octave) * fref).alias("frequency"))
    return _numbered(steps.filter(F.col("frequency").between(fmin, fmax)))


def semitone_frequencies(spark: SparkSession, fmin: float, fmax: float, fref: float = A4) -> DataFrame:
    return log_frequencies(spark, 12, fmin, fmax, fref)


def mel_frequencies(spark: SparkSession, count: int, fmin: float, fmax: float) -> DataFrame:
    low, high = hz2mel(F.lit(float(fmin))), hz2mel(F.lit(float(fmax)))
    return spark.range(count).select(F.col("id").cast("int").alias("idx"), mel2hz(low + (high - low) * (F.col("id") / (count - 1))).alias("frequency"))


def bark_frequencies(spark: SparkSession, fmin: float = 20.0, fmax: float = 15500.0, double: bool = False) -> DataFrame:
    values = [(float(f),) for f in (BARK_DOUBLE if double else BARK) if fmin <= f <= fmax]
    return _numbered(spark.createDataFrame(values, "frequency double"))


def bin_frequencies(spark: SparkSession, bins: int, sample_rate: float) -> DataFrame:
    return spark.range(bins).select(F.col("id").alias("bin"), (F.col("id") * (sample_rate / (2.0 * bins))).alias("bin_frequency"))


def nearest_bin(frequency: Column, bins: int, sample_rate: float) -> Column:
    """The bin of the nearest centre, the higher of two, within [1, bins - 1]."""
    position = frequency / (sample_rate / (2.0 * bins))
    return F.least(F.greatest(F.floor(position + 0.5), F.lit(1).cast("bigint")), F.lit(bins - 1).cast("bigint"))


def frequencies2bins(frequencies: DataFrame, bins: int, sample_rate: float, unique: bool = False) -> DataFrame:
    """(idx, bin), numbered anew if bins are to be unique."""
    found = frequencies.select("idx", nearest_bin(F.col("frequency"), bins, sample_rate).alias("bin"))
    return _numbered(found.select("bin").distinct(), "bin").select("idx", "bin") if unique else found


def _normalised(weights: DataFrame, norm: bool) -> DataFrame:
    if not norm:
        return weights
    return weights.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("band")))


def triangular(edges: DataFrame, norm: bool = True) -> DataFrame:
    """Triangles over three successive edges (idx, bin); one narrower than two bins is a single bin."""
    order = Window.orderBy("idx")
    bands = edges.select(F.col("idx").alias("band"), F.col("bin").alias("start"), F.lead("bin", 1).over(order).alias("center"), F.lead("bin", 2).over(order).alias("stop")).filter("stop IS NOT NULL")
    narrow = F.col("stop") - F.col("start") < 2
    bands = bands.select("band", "start", F.when(narrow, F.col("start")).otherwise(F.col("center")).alias("center"), F.when(narrow, F.col("start") + 1).otherwise(F.col("stop")).alias("stop"))
    placed = bands.withColumn("bin", F.explode(F.sequence("start", F.col("stop") - 1)))
    rising = (F.col("bin") - F.col("start")) / (F.col("center") - F.col("start"))
    falling = (F.col("stop") - F.col("bin")) / (F.col("stop") - F.col("center"))
    weights = placed.select("band", "bin", F.when(F.col("bin") < F.col("center"), rising).otherwise(falling).alias("weight"))
    return _normalised(weights, norm)


def rectangular(edges: DataFrame, norm: bool = True) -> DataFrame:
    """Ones from each edge (idx, bin) to the next."""
    order = Window.orderBy("idx")
    bands = edges.select(F.col("idx").alias("band"), F.col("bin").alias("start"), F.lead("bin").over(order).alias("stop")).filter("stop IS NOT NULL")
    placed = bands.filter("start < stop").select("band", F.explode(F.sequence("start", F.col("stop") - 1)).alias("bin"), F.lit(1.0).alias("weight"))
    return _normalised(placed, norm)


def log_filterbank(spark: SparkSession, bins: int, sample_rate: float, per_octave: int = 12, fmin: float = 30.0, fmax: float = 17000.0, fref: float = A4, norm: bool = True, unique: bool = True) -> DataFrame:
    return triangular(frequencies2bins(log_frequencies(spark, per_octave, fmin, fmax, fref), bins, sample_rate, unique), norm)


def mel_filterbank(spark: SparkSession, bins: int, sample_rate: float, bands: int = 40, fmin: float = 20.0, fmax: float = 17000.0, norm: bool = True, unique: bool = False) -> DataFrame:
    """``bands`` triangles in all, which take two edges more."""
    return triangular(frequencies2bins(mel_frequencies(spark, bands + 2, fmin, fmax), bins, sample_rate, unique), norm)


def bark_filterbank(spark: SparkSession, bins: int, sample_rate: float, double: bool = False, fmin: float = 20.0, fmax: float = 15500.0, norm: bool = True, unique: bool = True) -> DataFrame:
    return rectangular(frequencies2bins(bark_frequencies(spark, fmin, fmax, double), bins, sample_rate, unique), norm)


def rectangular_filterbank(spark: SparkSession, bins: int, sample_rate: float, crossovers: list[float], fmin: float = 30.0, fmax: float = 17000.0, norm: bool = True, unique: bool = True) -> DataFrame:
    """Contiguous bands between the limits, split at the crossover frequencies."""
    corners = spark.createDataFrame([(i, float(f)) for i, f in enumerate([fmin, *crossovers, fmax])], "idx int, frequency double")
    return rectangular(frequencies2bins(corners, bins, sample_rate, unique), norm)


def pitch_class_filterbank(spark: SparkSession, bins: int, sample_rate: float, classes: int = 12, fmin: float = 100.0, fmax: float = 5000.0, fref: float = A4) -> DataFrame:
    """Each bin within the limits belongs to the class of its nearest pitch (halves to even)."""
    inside = bin_frequencies(spark, bins, sample_rate).filter(F.col("bin_frequency").between(fmin, fmax) & (F.col("bin_frequency") > 0))
    step = F.rint(F.log2(F.col("bin_frequency") / fref) * classes)
    return inside.select(F.pmod(step, F.lit(float(classes))).cast("int").alias("band"), "bin", F.lit(1.0).alias("weight"))


def harmonic_pitch_class_filterbank(spark: SparkSession, bins: int, sample_rate: float, classes: int = 36, fmin: float = 100.0, fmax: float = 5000.0, fref: float = A4, window: float = 4.0) -> DataFrame:
    """Squared-cosine weights for the classes nearer than half a window on the circle of classes."""
    inside = bin_frequencies(spark, bins, sample_rate).filter(F.col("bin_frequency").between(fmin, fmax) & (F.col("bin_frequency") > 0))
    turns = inside.withColumn("position", F.pmod(F.log2(F.col("bin_frequency") / fref) * classes, F.lit(float(classes)))).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    away = F.col("position") - F.col("band")
    away = away - F.rint(away / classes) * classes
    near = turns.withColumn("away", away).filter(F.abs("away") < window / 2)
    return near.select("band", "bin", F.pow(F.cos(F.col("away") * (math.pi / window)), 2).alias("weight"))


def center_frequencies(filterbank: DataFrame, bins: int, sample_rate: float) -> DataFrame:
    """Per band: first and last bin's frequency and that of the first bin of the largest weight."""
    width = sample_rate / (2.0 * bins)
    return filterbank.groupBy("band").agg((F.min("bin") * width).alias("low"), (F.max_by("bin", F.struct("weight", -F.col("bin"))) * width).alias("center"), (F.max("bin") * width).alias("high"))


# --- semitone band-pass filters -------------------------------------------------------------------------------------


def _landen(k: float) -> list[float]:
    """Descending Landen moduli."""
    out = []
    while k > 1e-15 and len(out) < 12:
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _complete(k: float) -> float:
    """Complete elliptic integral of the first kind."""
    return math.pi / 2 * math.prod(1 + v for v in _landen(k))


def _jacobi(u: complex, k: float, kind: str) -> complex:
    """cd(uK, k) or sn(uK, k) by ascending Landen transformations."""
    w = np.cos(u * np.pi / 2) if kind == "cd" else np.sin(u * np.pi / 2)
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _inverse_sn(w: complex, k: float) -> complex:
    for v in _landen(k):
        before = k
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - before * before * w * w + 0j)))
        k = v
    return 2 * np.arcsin(w) / np.pi


def elliptic_lowpass(order: int, ripple: float, rejection: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of an analogue elliptic prototype with passband edge 1."""
    e_pass, e_stop = math.sqrt(10 ** (ripple / 10) - 1), math.sqrt(10 ** (rejection / 10) - 1)
    k1 = e_pass / e_stop
    pairs, odd = divmod(order, 2)
    places = [(2 * i - 1) / order for i in range(1, pairs + 1)]
    # the degree equation in the complementary modulus
    kc1 = math.sqrt(1 - k1 * k1)
    kc = kc1**order * math.prod(_jacobi(u, kc1, "sn").real for u in places) ** 4
    k = math.sqrt(1 - kc * kc)
    zeros = [1j / (k * _jacobi(u, k, "cd")) for u in places]
    shift = -1j / order * _inverse_sn(1j / e_pass, k1)
    poles = [1j * _jacobi(u - 1j * shift, k, "cd") for u in places]
    all_poles = [p for p in poles for p in (p, np.conj(p))] + ([1j * _jacobi(1j * shift, k, "sn")] if odd else [])
    all_zeros = [z for z in zeros for z in (z, np.conj(z))]
    z, p = np.asarray(all_zeros, complex), np.asarray(all_poles, complex)
    gain = (np.prod(-p) / np.prod(-z)).real * (1 if odd else 10 ** (-ripple / 20))
    return z, p, gain


def _bandpass_roots(order: int, ripple: float, rejection: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the digital band-pass filter; edges are fractions of the Nyquist frequency."""
    z, p, gain = elliptic_lowpass(order, ripple, rejection)
    a, b = 4 * math.tan(math.pi * low / 2), 4 * math.tan(math.pi * high / 2)
    width, center = b - a, math.sqrt(a * b)
    spread = lambda roots: np.concatenate([s * np.sqrt((roots * width / 2) ** 2 - center**2 + 0j) + roots * width / 2 for s in (1, -1)])
    degree = len(p) - len(z)
    z, p = np.concatenate((spread(z), np.zeros(degree))), spread(p)
    gain *= width**degree
    digital = lambda roots: (4 + roots) / (4 - roots)
    gain *= (np.prod(4 - z) / np.prod(4 - p)).real
    return np.concatenate((digital(z), -np.ones(len(p) - len(z)))), digital(p), gain


def elliptic_bandpass(order: int, ripple: float, rejection: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the digital band-pass filter."""
    z, p, gain = _bandpass_roots(order, ripple, rejection, low, high)
    return gain * np.poly(z).real, np.poly(p).real


def elliptic_sections(order: int, ripple: float, rejection: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The same filter as a cascade of second order: numerators and denominators (order x 3), and the largest pole's radius.

    Pairs of poles meet the zeros nearest to them, the sharpest first, so that no section amplifies much.
    """
    z, p, gain = _bandpass_roots(order, ripple, rejection, low, high)
    poles = sorted(p[p.imag > 0], key=lambda v: -abs(v))
    zeros = list(z[z.imag > 1e-9])
    b, a = [], []
    for pole in poles:
        if zeros:
            zero = zeros.pop(int(np.argmin(np.abs(np.asarray(zeros) - pole))))
            b.append([1.0, -2 * zero.real, abs(zero) ** 2])
        else:  # an odd order's pair at both ends of the band
            b.append([1.0, 0.0, -1.0])
        a.append([1.0, -2 * pole.real, abs(pole) ** 2])
    b = np.asarray(b)
    return b * abs(gain) ** (1 / len(b)) * np.where(np.arange(len(b)) == 0, np.sign(gain), 1.0)[:, None], np.asarray(a), float(max(map(abs, poles)))


def semitone_bands(fmin: float = 27.5, fmax: float = 4200.0, order: int = 4, ripple: float = 1.0, rejection: float = 50.0, quality: float = 25.0, fref: float = A4) -> list[dict]:
    """A filter per semitone: centre, the rate at which it runs, its coefficients as a whole and in sections."""
    out = []
    for step in range(math.floor(math.log2(fmin / fref) * 12), math.ceil(math.log2(fmax / fref) * 12)):
        center = fref * 2 ** (step / 12)
        if not fmin <= center <= fmax:
            continue
        # low bands run at low rates, where their filters are well conditioned
        rate = 882 if center < 260 else 4410 if center < 2090 else 22050
        half = center / quality / 2
        edges = (center - half) / (rate / 2), (center + half) / (rate / 2)
        b, a = elliptic_bandpass(order, ripple, rejection, *edges)
        sections = elliptic_sections(order, ripple, rejection, *edges)
        out.append({"midi": round(69 + 12 * math.log2(center / A4)), "center": center, "rate": rate, "b": b.tolist(), "a": a.tolist(), "sections": sections[:2], "radius": sections[2]})
    return out


class BlockFilters:
    """Recursive filters of one order side by side, in blocks: what a block's samples and the state before it add to the
    block's output and to the state after it are matrices, made once."""

    BLOCK = 64

    def __init__(self, b: np.ndarray, a: np.ndarray) -> None:
        b, a = np.asarray(b, float), np.asarray(a, float)
        b, a = b / a[:, :1], a / a[:, :1]
        count, order = a.shape[0], a.shape[1] - 1
        step = np.zeros((count, order, order))
        step[:, np.arange(order - 1), np.arange(1, order)] = 1
        step[:, :, 0] -= a[:, 1:]
        push = b[:, 1:] - a[:, 1:] * b[:, :1]
        # responses to the state and to a sample, step by step
        state, reach = np.tile(np.eye(order), (count, 1, 1)), []
        for _ in range(self.BLOCK):
            reach.append(state)
            state = step @ state
        self.from_state = np.stack([r[:, 0, :] for r in reach], 1)
        pulse = np.stack([b[:, 0], *((r[:, 0, :] * push).sum(1) for r in reach[:-1])], 1)
        self.from_input = np.zeros((count, self.BLOCK, self.BLOCK))
        for i in range(self.BLOCK):
            self.from_input[:, i, : i + 1] = pulse[:, i::-1]
        self.to_state = np.stack([(r * push[:, None, :]).sum(2) for r in reversed(reach)], 2)
        self.carry = state

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Filter rows (filters x samples) from silence."""
        count, n = x.shape
        blocks = -(-n // self.BLOCK)
        padded = np.zeros((count, blocks * self.BLOCK))
        padded[:, :n] = x
        padded = padded.reshape(count, blocks, self.BLOCK)
        out = padded @ self.from_input.swapaxes(1, 2)
        entering = padded @ self.to_state.swapaxes(1, 2)  # what each block adds to the state
        states, state = np.empty_like(entering), np.zeros((count, entering.shape[2], 1))
        for k in range(blocks):
            states[:, k] = state[..., 0]
            state = self.carry @ state + entering[:, k, :, None]
        out += states @ self.from_state.swapaxes(1, 2)
        return out.reshape(count, -1)[:, :n]


class SectionFilters:
    """Cascades of second-order sections side by side; double precision suffices however narrow a band is."""

    def __init__(self, sections: list[tuple[np.ndarray, np.ndarray]]) -> None:
        b, a = (np.stack([s[i] for s in sections]) for i in (0, 1))
        self.stages = [BlockFilters(b[:, k], a[:, k]) for k in range(b.shape[1])]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for stage in self.stages:
            x = stage(x)
        return x


def run_up(radius: float, accuracy: float = 1e-13) -> int:
    """Samples after which a filter with poles of that radius has forgotten what came before, but for ``accuracy``."""
    return math.ceil(math.log(accuracy) / math.log(radius))
