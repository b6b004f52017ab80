"""Queries on signals, frames and spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import frames, signal, spectra
from .registry import query, r6, s6
from .views import SIGNAL
from .views import signal as view

W = f"WITH {SIGNAL} "


@query("remix_downmix", W + "SELECT track, n // 2 AS n, trunc(avg(trunc(x)))::INTEGER AS x FROM sig GROUP BY 1, 2")
def _(spark, sf):
    stereo = view(spark, sf).select("track", F.expr("n div 2").alias("n"), (F.col("n") % 2).cast("int").alias("ch"), F.col("x").cast("int").alias("x"))
    return signal.remix(stereo, 1).select("track", "n", "x")


@query("remix_upmix", W + "SELECT track, n, c::INTEGER AS ch, x FROM sig, range(0, 2) t(c)")
def _(spark, sf):
    return signal.remix(view(spark, sf).withColumn("ch", F.lit(0)), 2)


@query("normalize", W + f"SELECT track, n, {s6('x / max(abs(x)) OVER (PARTITION BY track)')} AS x FROM sig")
def _(spark, sf):
    return signal.normalize(view(spark, sf)).withColumn("x", r6("x"))


@query("adjust_gain", W + f"SELECT track, n, {s6('x * pow(sqrt(10.0), 0.1 * 6.0)')} AS x FROM sig")
def _(spark, sf):
    return signal.adjust_gain(view(spark, sf), 6.0).withColumn("x", r6("x"))


@query("attenuate", W + f"SELECT track, n, {s6('x * pow(sqrt(10.0), -0.1 * 3.0)')} AS x FROM sig")
def _(spark, sf):
    return signal.attenuate(view(spark, sf), 3.0).withColumn("x", r6("x"))


@query("rescale", W + f"SELECT track, n, {s6('trunc(x) / 32767.0')} AS x FROM sig")
def _(spark, sf):
    return signal.rescale(view(spark, sf).withColumn("x", F.col("x").cast("int"))).withColumn("x", r6("x"))


GATED = f"WITH {SIGNAL}, gated AS (SELECT track, n, CASE WHEN x < 200 THEN 0.0 ELSE x END AS x FROM sig), "


@query("trim", GATED + "lim AS (SELECT track, min(n) AS lo, max(n) AS hi FROM gated WHERE x <> 0 GROUP BY track) SELECT g.track, n, x FROM gated g JOIN lim ON g.track = lim.track AND n BETWEEN lo AND hi")
def _(spark, sf):
    return signal.trim(view(spark, sf).withColumn("x", F.when(F.col("x") < 200, 0.0).otherwise(F.col("x"))))


@query("levels", W + f"SELECT track, {s6('sum(x * x)')} AS energy, {s6('sqrt(avg(x * x))')} AS rms, {s6('20 * log10(sqrt(avg(x * x)) / 500.0)')} AS spl FROM sig GROUP BY track")
def _(spark, sf):
    return signal.levels(view(spark, sf), p_ref=500.0).select("track", *(r6(c).alias(c) for c in ("energy", "rms", "spl")))


_TAPS = "taps AS (SELECT k, 0.54 - 0.46 * cos(2 * pi() * k / 6) AS w FROM range(0, 7) t(k))"


@query("smooth_hamming", W + f", {_TAPS} SELECT a.track, a.n, {s6('sum(b.x * w)')} AS x FROM sig a JOIN taps ON true JOIN sig b ON b.track = a.track AND b.n = a.n + 3 - k GROUP BY 1, 2")
def _(spark, sf):
    return signal.smooth(view(spark, sf), 7).withColumn("x", r6("x"))


@query("smooth_kernel", W + f", taps(k, w) AS (VALUES (0, 0.5), (1, 0.25), (2, -0.125), (3, 1.0)) SELECT a.track, a.n, {s6('sum(b.x * w::DOUBLE)')} AS x FROM sig a JOIN taps ON true JOIN sig b ON b.track = a.track AND b.n = a.n + 1 - k GROUP BY 1, 2")
def _(spark, sf):
    return signal.smooth(view(spark, sf), [0.5, 0.25, -0.125, 1.0]).withColumn("x", r6("x"))


def _framing(size: int, hop: float, before: int, end: str = "ceil(c / {hop})") -> str:
    count = end.format(hop=hop)
    return (
        f"WITH {SIGNAL}, len AS (SELECT track, count(*) AS c FROM sig GROUP BY track), fr AS (SELECT track, unnest(range(0, ({count})::BIGINT)) AS frame FROM len), "
        f"framed AS (SELECT fr.track, frame, n - (floor(frame * {hop})::BIGINT - {before}) AS k, x FROM fr JOIN sig ON sig.track = fr.track AND n BETWEEN floor(frame * {hop})::BIGINT - {before} AND floor(frame * {hop})::BIGINT - {before} + {size - 1}) "
    )


for _name, _origin, _before in (("frame_center", 0, 4), ("frame_left", "left", 7), ("frame_right", "right", 0)):

    @query(_name, _framing(8, 3, _before) + "SELECT track, frame, k, x FROM framed")
    def _(spark, sf, origin=_origin):
        return frames.frame(view(spark, sf), 8, 3, origin=origin)


@query("frame_fractional_hop", _framing(6, 2.5, 3) + f"SELECT track, frame, count(*) AS held, {s6('sum(x * (k + 1))')} AS v FROM framed GROUP BY 1, 2")
def _(spark, sf):
    framed = frames.frame(view(spark, sf), 6, fps=4, sample_rate=10)
    return framed.groupBy("track", "frame").agg(F.count("*").alias("held"), r6(F.sum(F.col("x") * (F.col("k") + 1))).alias("v"))


@query("frame_counts", W + "SELECT track, ceil(count(*) / 4.0)::BIGINT AS normal, floor(count(*) / 4.0 + 1)::BIGINT AS extend FROM sig GROUP BY track")
def _(spark, sf):
    sig = view(spark, sf)
    return frames.frame_counts(sig, 4.0).withColumnRenamed("frames", "normal").join(frames.frame_counts(sig, 4.0, "extend").withColumnRenamed("frames", "extend"), "track")


@query("frame_levels", _framing(8, 4, 4) + f"SELECT track, frame, {s6('sum(x * x)')} AS energy, {s6('sqrt(avg(x * x))')} AS rms FROM framed GROUP BY 1, 2")
def _(spark, sf):
    return signal.levels(frames.frame(view(spark, sf), 8, 4), ("track", "frame")).select("track", "frame", r6("energy").alias("energy"), r6("rms").alias("rms"))


@query("segment_axis", W + ", len AS (SELECT track, count(*) AS c FROM sig GROUP BY track), seg AS (SELECT track, unnest(range(0, (c - 5) // 2 + 1)) AS segment FROM len WHERE c >= 5) SELECT seg.track, segment, n - segment * 2 AS k, x FROM seg JOIN sig ON sig.track = seg.track AND n BETWEEN segment * 2 AND segment * 2 + 4")
def _(spark, sf):
    return frames.segment_axis(view(spark, sf), 5, 2)


_DFT = ", win AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * k / 15)) AS y FROM framed), tf AS (SELECT track, frame, b AS bin, sum(y * cos(2 * pi() * b * {k} / {size})) AS re, -sum(y * sin(2 * pi() * b * {k} / {size})) AS im FROM win, range(0, {bins}) t(b) GROUP BY 1, 2, 3) "


def _dft(bins: int = 8, k: str = "k", size: int = 16) -> str:
    return _framing(16, 8, 8).rstrip() + _DFT.format(bins=bins, k=k, size=size)


@query("stft_complex", _dft() + f"SELECT track, frame, bin, {s6('re')} AS re, {s6('im')} AS im FROM tf")
def _(spark, sf):
    rows = spectra.bins_of(spectra.stft_of(view(spark, sf), 16, 8))
    return rows.select("track", "frame", "bin", r6("re").alias("re"), r6("im").alias("im"))


@query("stft_nyquist", _dft(bins=9) + f"SELECT track, frame, bin, {s6('sqrt(re * re + im * im)')} AS mag FROM tf")
def _(spark, sf):
    rows = spectra.magnitude(spectra.bins_of(spectra.stft_of(view(spark, sf), 16, 8, include_nyquist=True)))
    return rows.select("track", "frame", "bin", r6("mag").alias("mag"))


@query("stft_padded", _dft(bins=16, size=32) + f"SELECT track, frame, bin, {s6('sqrt(re * re + im * im)')} AS mag FROM tf")
def _(spark, sf):
    rows = spectra.magnitude(spectra.bins_of(spectra.stft_of(view(spark, sf), 16, 8, fft_size=32)))
    return rows.select("track", "frame", "bin", r6("mag").alias("mag"))


@query("stft_circular", _dft(k="(k - 8)") + f"SELECT track, frame, bin, {s6('re')} AS re, {s6('im')} AS im FROM tf")
def _(spark, sf):
    rows = spectra.bins_of(spectra.stft_of(view(spark, sf), 16, 8, circular_shift=True))
    return rows.select("track", "frame", "bin", r6("re").alias("re"), r6("im").alias("im"))


def _phases(spark, sf):
    rows = spectra.bins_of(spectra.stft_of(view(spark, sf), 16, 8, circular_shift=True))
    return spectra.phase(rows.filter("bin BETWEEN 1 AND 7"))


@query("phase", _dft(k="(k - 8)") + f"SELECT track, frame, bin, {s6('atan2(im, re)')} AS phase FROM tf WHERE bin BETWEEN 1 AND 7")
def _(spark, sf):
    return _phases(spark, sf).select("track", "frame", "bin", r6("phase").alias("phase"))


@query(
    "local_group_delay",
    _dft(k="(k - 8)").rstrip() + ", d AS (SELECT track, frame, bin, lead(atan2(im, re)) OVER (PARTITION BY track, frame ORDER BY bin) - atan2(im, re) AS s FROM tf WHERE bin BETWEEN 1 AND 7) "
    f"SELECT track, frame, bin, {s6('coalesce(-(s - 2 * pi() * floor((s + pi()) / (2 * pi()))), 0.0)')} AS lgd FROM d",
)
def _(spark, sf):
    return spectra.local_group_delay(_phases(spark, sf)).select("track", "frame", "bin", r6("lgd").alias("lgd"))


def _resampling_taps(up: int, down: int, half_width: int = 10, beta: float = 5.0) -> list[float]:
    """Kaiser-windowed sinc, from the window's series."""
    bessel = lambda x: sum((x / 2) ** (2 * k) / math.factorial(k) ** 2 for k in range(40))
    reach = half_width * max(up, down)
    sinc = lambda x: math.sin(math.pi * x) / (math.pi * x) if x else 1.0
    raw = [sinc(t / max(up, down)) * bessel(beta * math.sqrt(1 - (t / reach) ** 2)) / bessel(beta) for t in range(-reach, reach + 1)]
    return [v * up / sum(raw) for v in raw]


@query(
    "resample",
    f"WITH {SIGNAL}, tp(tap, h) AS (SELECT tap, h::DOUBLE FROM (VALUES {', '.join(str((i, f'{h:.17g}')) for i, h in enumerate(_resampling_taps(2, 3)))}) t(tap, h)), "
    "sz AS (SELECT track, (count(*) * 2) // 3 AS size FROM sig GROUP BY 1) "
    f"SELECT sig.track, (n * 2 + tap - 30) // 3 AS n, {s6('sum(x * h)')} AS x FROM sig JOIN sz ON sz.track = sig.track JOIN tp ON n * 2 + tap >= 30 AND (n * 2 + tap - 30) % 3 = 0 AND (n * 2 + tap - 30) // 3 < size GROUP BY 1, 2",
)
def _(spark, sf):
    return signal.resample(view(spark, sf).withColumn("x", F.col("x").cast("double")), 2, 3).withColumn("x", r6("x"))
