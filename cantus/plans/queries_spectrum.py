"""Queries on scales, filterbanks, spectrograms, chroma, cepstra and onset functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scales
from ..operators import filterbanks as fb
from ..operators import frames, onsets, spectra
from ..operators import spectrogram as sg
from .registry import query, query_on, r6, s6
from .views import ACTIVATION, ONSETS, SIGNAL, SPECTROGRAM
from .views import activation as act_view
from .views import onsets as onset_view
from .views import signal as signal_view
from .views import spectrogram as spec_view

BINS, RATE = 64, 44100.0
WIDTH = RATE / (2 * BINS)
S = f"WITH {SPECTROGRAM} "


@query("scales", f"WITH {SIGNAL}, vs AS (SELECT track, n, abs(x) + 1 AS v FROM sig) SELECT track, n, {s6('1127.01048 * ln(v / 700.0 + 1)')} AS mel, {s6('700.0 * (exp(v / 20.0 / 1127.01048) - 1)')} AS hz, {s6('12 * log2(v / 440.0) + 69')} AS midi, {s6('440.0 * pow(2.0, (v / 100.0 - 69) / 12)')} AS pitch FROM vs")
def _(spark, sf):
    v = F.abs("x") + 1
    rows = signal_view(spark, sf)
    return rows.select("track", "n", r6(scales.hz2mel(v)).alias("mel"), r6(scales.mel2hz(v / 20.0)).alias("hz"), r6(scales.hz2midi(v)).alias("midi"), r6(scales.midi2hz(v / 100.0)).alias("pitch"))


_LOGF = f"lf AS (SELECT row_number() OVER (ORDER BY f) - 1 AS idx, f FROM (SELECT 440.0::DOUBLE * pow(2.0, k / 6.0) AS f FROM range({math.floor(math.log2(300 / 440) * 6)}, {math.ceil(math.log2(16000 / 440) * 6)}) t(k)) WHERE f BETWEEN 300 AND 16000)"
_MEL = "mf AS (SELECT k AS idx, 700.0 * (exp((lo + (hi - lo) * (k / 11.0)) / 1127.01048) - 1) AS f FROM range(0, 12) t(k), (SELECT 1127.01048 * ln(300 / 700.0 + 1) AS lo, 1127.01048 * ln(16000 / 700.0 + 1) AS hi))"


def _edges(source: str, unique: bool) -> str:
    found = f"least(greatest(floor(f / {WIDTH} + 0.5), 1), {BINS - 1})::BIGINT"
    if not unique:
        return f"edge AS (SELECT idx, {found} AS bin FROM {source})"
    return f"edge AS (SELECT row_number() OVER (ORDER BY bin) - 1 AS idx, bin FROM (SELECT DISTINCT {found} AS bin FROM {source}))"


_TRI = (
    "tri AS (SELECT idx AS band, bin AS a, lead(bin, 1) OVER (ORDER BY idx) AS m, lead(bin, 2) OVER (ORDER BY idx) AS z FROM edge), "
    "tr2 AS (SELECT band, a, CASE WHEN z - a < 2 THEN a ELSE m END AS m, CASE WHEN z - a < 2 THEN a + 1 ELSE z END AS z FROM tri WHERE z IS NOT NULL), "
    "raw AS (SELECT band, a + i AS bin, CASE WHEN a + i < m THEN i::DOUBLE / (m - a) ELSE (z - a - i)::DOUBLE / (z - m) END AS w FROM (SELECT *, unnest(range(0, z - a)) AS i FROM tr2)), "
    "fbk AS (SELECT band, bin, w / sum(w) OVER (PARTITION BY band) AS w FROM raw)"
)
_LOGFB = f"{_LOGF}, {_edges('lf', True)}, {_TRI}"
_MELFB = f"{_MEL}, {_edges('mf', False)}, {_TRI}"


def log_fb(spark):
    return fb.log_filterbank(spark, BINS, RATE, 6, 300.0, 16000.0)


def mel_fb(spark):
    return fb.mel_filterbank(spark, BINS, RATE, 10, 300.0, 16000.0)


def _weights(df):
    return df.select(F.col("band").cast("bigint").alias("band"), F.col("bin").cast("bigint").alias("bin"), r6("weight").alias("weight"))


@query_on("values", "floor(frequency)", "log_frequencies", f"WITH {_LOGF} SELECT idx, {s6('f')} AS frequency FROM lf")
def _(spark, sf):
    return fb.log_frequencies(spark, 6, 300.0, 16000.0).select(F.col("idx").cast("bigint").alias("idx"), r6("frequency").alias("frequency"))


@query_on("values", "floor(frequency)", "mel_frequencies", f"WITH {_MEL} SELECT idx, {s6('f')} AS frequency FROM mf")
def _(spark, sf):
    return fb.mel_frequencies(spark, 12, 300.0, 16000.0).select(F.col("idx").cast("bigint").alias("idx"), r6("frequency").alias("frequency"))


@query_on("values", "floor(frequency)", "semitone_frequencies", f"SELECT row_number() OVER (ORDER BY f) - 1 AS idx, {s6('f')} AS frequency FROM (SELECT 440.0::DOUBLE * pow(2.0, k / 12.0) AS f FROM range(-40, 40) t(k)) WHERE f BETWEEN 100 AND 2000")
def _(spark, sf):
    return fb.semitone_frequencies(spark, 100.0, 2000.0).select(F.col("idx").cast("bigint").alias("idx"), r6("frequency").alias("frequency"))


@query_on("values", "floor(frequency)", "bark_frequencies", "SELECT row_number() OVER (ORDER BY d, f) AS i, d AS doubled, f AS frequency FROM (" + " UNION ALL ".join(f"SELECT {d} AS d, unnest([{', '.join(f'{float(x)}::DOUBLE' for x in v)}]) AS f" for d, v in ((0, scales.BARK), (1, scales.BARK_DOUBLE))) + ") WHERE f BETWEEN 50 AND 9500")
def _(spark, sf):
    from pyspark.sql import Window

    both = fb.bark_frequencies(spark, 50, 9500).withColumn("doubled", F.lit(0)).unionByName(fb.bark_frequencies(spark, 50, 9500, True).withColumn("doubled", F.lit(1)))
    return both.select(F.row_number().over(Window.orderBy("doubled", "frequency")).cast("bigint").alias("i"), "doubled", "frequency")


@query_on("spectrum", "bin", "frequencies2bins", f"WITH {_LOGF}, {_edges('lf', False)}, u AS (SELECT count(DISTINCT bin) AS n FROM edge) SELECT idx, bin, n AS bins FROM edge, u")
def _(spark, sf):
    freqs = fb.log_frequencies(spark, 6, 300.0, 16000.0)
    every, once = fb.frequencies2bins(freqs, BINS, RATE), fb.frequencies2bins(freqs, BINS, RATE, unique=True)
    return every.withColumn("bins", F.lit(once.count()).cast("bigint")).select(F.col("idx").cast("bigint").alias("idx"), "bin", "bins")


@query_on("spectrum", "bin", "filterbank_log", f"WITH {_LOGFB} SELECT band, bin, {s6('w')} AS weight FROM fbk")
def _(spark, sf):
    return _weights(log_fb(spark))


@query_on("spectrum", "bin", "filterbank_mel", f"WITH {_MELFB} SELECT band, bin, {s6('w')} AS weight FROM fbk")
def _(spark, sf):
    return _weights(mel_fb(spark))


_RECTS = "rec AS (SELECT idx AS band, bin AS a, lead(bin) OVER (ORDER BY idx) AS z FROM edge), fbk AS (SELECT band, a + i AS bin, 1.0::DOUBLE / (z - a) AS w FROM (SELECT *, unnest(range(0, z - a)) AS i FROM rec WHERE z > a))"
_CROSS = "cf(idx, f) AS (VALUES (0, 300.0::DOUBLE), (1, 1500.0::DOUBLE), (2, 6000.0::DOUBLE), (3, 16000.0::DOUBLE))"
_RECTFB = f"{_CROSS}, {_edges('cf', True)}, {_RECTS}"


def rect_fb(spark):
    return fb.rectangular_filterbank(spark, BINS, RATE, [1500.0, 6000.0], 300.0, 16000.0)


@query_on("spectrum", "bin", "filterbank_rectangular", f"WITH {_RECTFB} SELECT band, bin, {s6('w')} AS weight FROM fbk")
def _(spark, sf):
    return _weights(rect_fb(spark))


@query_on("spectrum", "bin", "filterbank_bark", f"WITH bk AS (SELECT row_number() OVER (ORDER BY f) - 1 AS idx, f FROM (SELECT unnest([{', '.join(f'{float(x)}::DOUBLE' for x in scales.BARK)}]) AS f)), {_edges('bk', True)}, {_RECTS} SELECT band, bin, {s6('w')} AS weight FROM fbk")
def _(spark, sf):
    return _weights(fb.bark_filterbank(spark, BINS, RATE))


_BINF = f"bf AS (SELECT b AS bin, b * {WIDTH} AS f FROM range(1, {BINS}) t(b))"
_PCP = _BINF + ", fbk AS (SELECT (((round_even(12 * log2(f / 440.0), 0)::BIGINT % 12) + 12) % 12) AS band, bin, 1.0::DOUBLE AS w FROM bf WHERE f BETWEEN 100 AND 16000)"
_HPCP = _BINF + ", pos AS (SELECT bin, 36 * log2(f / 440.0) AS p FROM bf WHERE f BETWEEN 100 AND 16000), away AS (SELECT c AS band, bin, p - c - 36 * round_even((p - c) / 36, 0) AS d FROM pos, range(0, 36) t(c)), fbk AS (SELECT band, bin, pow(cos(pi() * d / 4.0), 2) AS w FROM away WHERE abs(d) < 2)"


@query_on("spectrum", "bin", "filterbank_pitch_class", f"WITH {_PCP} SELECT band, bin, w AS weight FROM fbk")
def _(spark, sf):
    return _weights(fb.pitch_class_filterbank(spark, BINS, RATE, fmax=16000.0))


@query_on("spectrum", "bin", "filterbank_harmonic_pitch_class", f"WITH {_HPCP} SELECT band, bin, {s6('w')} AS weight FROM fbk")
def _(spark, sf):
    return _weights(fb.harmonic_pitch_class_filterbank(spark, BINS, RATE, fmax=16000.0))


@query_on("spectrum", "band", "filterbank_centers", f"WITH {_MELFB}, rk AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {s6('w')} DESC, bin) AS r FROM fbk) SELECT band, {s6(f'min(bin) * {WIDTH}')} AS low, {s6(f'max(CASE WHEN r = 1 THEN bin END) * {WIDTH}')} AS center, {s6(f'max(bin) * {WIDTH}')} AS high FROM rk GROUP BY band")
def _(spark, sf):
    rows = fb.center_frequencies(mel_fb(spark).withColumn("weight", r6("weight")), BINS, RATE)
    return rows.select(F.col("band").cast("bigint").alias("band"), *(r6(c).alias(c) for c in ("low", "center", "high")))


_FILTERED = "flt AS (SELECT track, frame, band AS bin, sum(mag * w) AS mag FROM spec JOIN fbk USING (bin) GROUP BY 1, 2, 3)"


def _mag(df, column="mag"):
    return df.select("track", "frame", "bin", r6(column).alias(column))


for _name, _sql, _make in (("spec_filtered_log", _LOGFB, log_fb), ("spec_filtered_mel", _MELFB, mel_fb), ("spec_multiband", _RECTFB, rect_fb)):

    @query(_name, S + f", {_sql}, {_FILTERED} SELECT track, frame, bin, {s6('mag')} AS mag FROM flt")
    def _(spark, sf, make=_make):
        return _mag(sg.apply_filterbank(spec_view(spark, sf), make(spark)))


for _name, _sql, _make in (
    ("pitch_class_profile", _PCP, lambda s: fb.pitch_class_filterbank(s, BINS, RATE, fmax=16000.0)),
    ("harmonic_pitch_class_profile", _HPCP, lambda s: fb.harmonic_pitch_class_filterbank(s, BINS, RATE, fmax=16000.0)),
):

    @query(_name, S + f", {_sql}, {_FILTERED} SELECT track, frame, bin, {s6('mag')} AS mag FROM flt")
    def _(spark, sf, make=_make):
        return _mag(sg.pitch_class_profile(spec_view(spark, sf), make(spark)))


@query("spec_log", S + f"SELECT track, frame, bin, {s6('log10(5 * mag + 1)')} AS mag FROM spec")
def _(spark, sf):
    return _mag(sg.log_compress(spec_view(spark, sf), 5.0, 1.0))


_LAG = "lag({v}, {d}) OVER (PARTITION BY track, bin ORDER BY frame)"


@query("spec_diff", S + f"SELECT track, frame, bin, {s6('coalesce(mag - ' + _LAG.format(v='mag', d=2) + ', 0.0)')} AS diff FROM spec")
def _(spark, sf):
    return _mag(sg.difference(spec_view(spark, sf), 2), "diff")


@query("spec_diff_positive", S + f"SELECT track, frame, bin, {s6('greatest(mag - ' + _LAG.format(v='mag', d=1) + ', 0.0)')} AS diff FROM spec QUALIFY frame >= 1")
def _(spark, sf):
    return _mag(sg.difference(spec_view(spark, sf), 1, positive=True, keep_dims=False), "diff")


_MAXED = "mx AS (SELECT *, max(mag) OVER (PARTITION BY track, frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM spec)"
_DIFFED = f"dif AS (SELECT track, frame, bin, mag, coalesce(greatest(mag - {_LAG.format(v='m', d=1)}, 0.0), 0.0) AS d FROM mx)"


@query("spec_diff_maxfilter", S + f", {_MAXED}, {_DIFFED} SELECT track, frame, bin, {s6('d')} AS diff FROM dif")
def _(spark, sf):
    return _mag(sg.difference(spec_view(spark, sf), 1, 3, positive=True), "diff")


@query("spec_diff_stack", S + f", dif AS (SELECT track, frame, bin, mag, coalesce(greatest(mag - {_LAG.format(v='mag', d=1)}, 0.0), 0.0) AS d FROM spec) SELECT track, frame, bin, {s6('mag')} AS mag FROM dif UNION ALL SELECT track, frame, bin + 64, {s6('d')} FROM dif")
def _(spark, sf):
    return _mag(sg.stack_difference(spec_view(spark, sf), 64))


@query("superflux_chain", S + f", {_LOGFB}, {_FILTERED}, lg AS (SELECT track, frame, bin, log10(mag + 1) AS mag FROM flt), {_MAXED.replace('FROM spec', 'FROM lg')}, {_DIFFED} SELECT track, frame, bin, {s6('d')} AS diff FROM dif")
def _(spark, sf):
    return _mag(sg.superflux(spec_view(spark, sf), log_fb(spark)), "diff")


@query("context_frames", S + "SELECT a.track, a.frame, (d + 1) * 64 + bin AS bin, " + s6("mag") + " AS mag FROM vec a JOIN range(-1, 2) t(d) ON true JOIN spec b ON b.track = a.track AND b.frame = a.frame + d")
def _(spark, sf):
    return _mag(sg.context(spec_view(spark, sf), 3, 64))


_DCT = "SELECT track, frame, k::INTEGER AS coef, " + s6("2 * sum(mag * cos(pi() * k * (2 * bin + 1) / (2 * {n})))") + " AS value FROM {t}, range(0, {c}) t(k) GROUP BY 1, 2, 3"


@query("cepstrogram", S + _DCT.format(n=64, t="spec", c=13))
def _(spark, sf):
    return sg.dct(spec_view(spark, sf), 13, 64).withColumn("value", r6("value"))


@query("mfcc", S + f", {_MELFB}, {_FILTERED}, lg AS (SELECT track, frame, bin, log10(mag) AS mag FROM flt) " + _DCT.format(n=10, t="lg", c=10))
def _(spark, sf):
    return sg.mfcc(spec_view(spark, sf), mel_fb(spark), 10).withColumn("value", r6("value"))


@query(
    "clp_chroma",
    S + ", fold AS (SELECT track, frame, (bin + 21) % 12 AS pc, sum(log10(mag * 100.0 + 1)) AS v FROM spec GROUP BY 1, 2, 3), nrm AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY track, frame)) AS l FROM fold) "
    f"SELECT track, frame, pc, {s6('CASE WHEN l < 0.001 THEN 1 / sqrt(12.0) ELSE v / l END')} AS value FROM nrm",
)
def _(spark, sf):
    semitones = spec_view(spark, sf).select("track", "frame", (F.col("bin") + 21).alias("midi"), F.col("mag").alias("energy"))
    return sg.clp_chroma(semitones).withColumn("value", r6("value"))


def _reflect(axis: str, other: str, source: str, reach: int) -> str:
    return (
        f"SELECT *, {axis} AS pos FROM {source} UNION ALL SELECT *, -1 - {axis} FROM {source} WHERE {axis} < {reach} "
        f"UNION ALL SELECT s.*, 2 * hi + 1 - {axis} FROM {source} s JOIN (SELECT track AS tk, {other} AS ot, max({axis}) AS hi FROM {source} GROUP BY 1, 2) e ON s.track = tk AND s.{other} = ot WHERE hi - {axis} < {reach}"
    )


_HPSS = (
    f", rf AS ({_reflect('frame', 'bin', 'spec', 2)}), hm AS (SELECT *, median(mag) OVER (PARTITION BY track, bin ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM rf), h AS (SELECT track, frame, bin, mag, h FROM hm WHERE pos = frame), "
    f"rb AS ({_reflect('bin', 'frame', 'h', 2)}), pm AS (SELECT *, median(mag) OVER (PARTITION BY track, frame ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM rb), hp AS (SELECT track, frame, bin, mag, h, p FROM pm WHERE pos = bin) "
)


@query("hpss_slices", S + _HPSS + f"SELECT track, frame, bin, {s6('h')} AS h, {s6('p')} AS p FROM hp")
def _(spark, sf):
    return sg.hpss(spec_view(spark, sf), "binary", 5, 5).select("track", "frame", "bin", r6("h").alias("h"), r6("p").alias("p"))


@query("hpss_binary", S + _HPSS + f"SELECT track, frame, bin, {s6('CASE WHEN h > p THEN mag ELSE 0 END')} AS harmonic, {s6('CASE WHEN p >= h THEN mag ELSE 0 END')} AS percussive FROM hp")
def _(spark, sf):
    return sg.hpss(spec_view(spark, sf), "binary", 5, 5).select("track", "frame", "bin", r6("harmonic").alias("harmonic"), r6("percussive").alias("percussive"))


@query("hpss_soft", S + _HPSS + f"SELECT track, frame, bin, {s6('mag * h * h / (h * h + p * p)')} AS harmonic, {s6('mag * p * p / (h * h + p * p)')} AS percussive FROM hp")
def _(spark, sf):
    return sg.hpss(spec_view(spark, sf), 2.0, 5, 5).select("track", "frame", "bin", r6("harmonic").alias("harmonic"), r6("percussive").alias("percussive"))


# --- onset functions ------------------------------------------------------------------------------------------------

_POS = f"dif AS (SELECT track, frame, bin, mag, coalesce(greatest(mag - {_LAG.format(v='mag', d=1)}, 0.0), 0.0) AS d FROM spec)"
for _name, _sql in (
    ("high_frequency_content", f"SELECT track, frame, {s6('avg(mag * bin)')} AS a FROM spec GROUP BY 1, 2"),
    ("spectral_diff", f", {_POS} SELECT track, frame, {s6('sum(d * d)')} AS a FROM dif GROUP BY 1, 2"),
    ("spectral_flux", f", {_POS} SELECT track, frame, {s6('sum(d)')} AS a FROM dif GROUP BY 1, 2"),
    ("superflux", f", {_MAXED}, {_DIFFED} SELECT track, frame, {s6('sum(d)')} AS a FROM dif GROUP BY 1, 2"),
    ("modified_kullback_leibler", f", q AS (SELECT *, coalesce(ln(1 + mag / ({_LAG.format(v='mag', d=1)} + 0.1)), 0.0) AS l FROM spec) SELECT track, frame, {s6('avg(l)')} AS a FROM q GROUP BY 1, 2"),
):

    @query(_name, S + _sql)
    def _(spark, sf, method=_name):
        options = {"epsilon": 0.1} if method == "modified_kullback_leibler" else {}
        return onsets.onset_function(spec_view(spark, sf), method, **options).withColumn("a", r6("a"))


@query(
    "correlation_diff",
    S + ", pr AS (SELECT a.track, a.frame, a.bin, k, a.mag - b.mag AS d, a.mag * b.mag AS c FROM spec a JOIN range(-1, 2) t(k) ON true JOIN spec b ON b.track = a.track AND b.frame = a.frame - 1 AND b.bin = a.bin - k), "
    "sc AS (SELECT track, frame, k, row_number() OVER (PARTITION BY track, frame ORDER BY sum(c) DESC, k) AS r FROM pr GROUP BY 1, 2, 3) "
    f"SELECT s.track, s.frame, s.bin, {s6('coalesce(d, 0.0)')} AS diff FROM spec s LEFT JOIN (SELECT pr.* FROM pr JOIN sc USING (track, frame, k) WHERE r = 1) x ON x.track = s.track AND x.frame = s.frame AND x.bin = s.bin",
)
def _(spark, sf):
    return _mag(onsets.correlation_diff(spec_view(spark, sf)), "diff")


_CX = (
    f"WITH {SIGNAL}, len AS (SELECT track, count(*) AS c FROM sig GROUP BY track), fr AS (SELECT track, unnest(range(0, ceil(c / 8.0)::BIGINT)) AS frame FROM len), framed AS (SELECT fr.track, frame, n - (frame * 8 - 8) AS k, x FROM fr JOIN sig ON sig.track = fr.track AND n BETWEEN frame * 8 - 8 AND frame * 8 + 7), "
    "win AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * k / 15)) AS y FROM framed), tf AS (SELECT track, frame, b AS bin, sum(y * cos(2 * pi() * b * (k - 8) / 16)) AS re, -sum(y * sin(2 * pi() * b * (k - 8) / 16)) AS im FROM win, range(1, 8) t(b) GROUP BY 1, 2, 3), "
    "cx AS (SELECT track, frame, bin, sqrt(re * re + im * im) AS mag, atan2(im, re) AS ph FROM tf), "
    "lg AS (SELECT *, lag(ph, 1) OVER w AS p1, lag(ph, 2) OVER w AS p2, coalesce(lag(mag, 1) OVER w, 0) AS m1, lag(mag, 1) OVER w AS m0 FROM cx WINDOW w AS (PARTITION BY track, bin ORDER BY frame)), "
    "pd AS (SELECT *, coalesce(ph - 2 * p1 + p2 - 2 * pi() * floor((ph - 2 * p1 + p2 + pi()) / (2 * pi())), 0.0) AS d, coalesce(2 * p1 - p2, 2 * p1, 0.0) AS e FROM lg), "
    "cd AS (SELECT *, sqrt(pow(mag * cos(ph) - m1 * cos(e), 2) + pow(mag * sin(ph) - m1 * sin(e), 2)) AS c FROM pd) "
)


def _complex(spark, sf):
    rows = spectra.bins_of(spectra.stft_of(signal_view(spark, sf), 16, 8, circular_shift=True)).filter("bin BETWEEN 1 AND 7")
    return spectra.phase(spectra.magnitude(rows))


for _name, _value in (
    ("phase_deviation", "avg(abs(d))"),
    ("weighted_phase_deviation", "avg(abs(d * mag))"),
    ("normalized_weighted_phase_deviation", "avg(abs(d * mag)) / (avg(mag) + 2.220446049250313e-16)"),
    ("complex_domain", "sum(c)"),
    ("rectified_complex_domain", "sum(CASE WHEN mag > m0 THEN c ELSE 0 END)"),
):

    @query(_name, _CX + f"SELECT track, frame, {s6(_value)} AS a FROM cd GROUP BY 1, 2")
    def _(spark, sf, method=_name):
        return onsets.onset_function(_complex(spark, sf), method).withColumn("a", r6("a"))


@query(
    "complex_flux",
    _CX + ", ld AS (SELECT track, frame, bin, mag, lead(ph) OVER (PARTITION BY track, frame ORDER BY bin) - ph AS s FROM cx), la AS (SELECT track, frame, bin, mag, abs(coalesce(s - 2 * pi() * floor((s + pi()) / (2 * pi())), 0.0)) / pi() AS l FROM ld), "
    "l1 AS (SELECT track, frame, bin, mag, max(l) OVER (PARTITION BY track, bin ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM la), "
    "l2 AS (SELECT track, frame, bin, mag, min(l) OVER (PARTITION BY track, frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l, max(mag) OVER (PARTITION BY track, frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM l1), "
    "l3 AS (SELECT track, frame, l * coalesce(greatest(mag - lag(m) OVER (PARTITION BY track, bin ORDER BY frame), 0.0), 0.0) AS v FROM l2) "
    f"SELECT track, frame, {s6('sum(v)')} AS a FROM l3 GROUP BY 1, 2",
)
def _(spark, sf):
    return onsets.complex_flux(spectra.local_group_delay(_complex(spark, sf))).withColumn("a", r6("a"))


_ACT = f"WITH {ACTIVATION} "
_PICK = (
    ", sm AS (SELECT *, sum(a) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 + 0.1 AS least FROM act), "
    "hl AS (SELECT *, CASE WHEN a >= least THEN a ELSE 0 END AS h FROM sm), pk AS (SELECT *, greatest(max(h) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 0) AS m FROM hl) "
)


@query("peak_picking", _ACT + _PICK + f"SELECT track, frame, {s6('a')} AS a FROM pk WHERE h = m AND h > 0")
def _(spark, sf):
    return onsets.peak_picking(act_view(spark, sf), 0.1, None, 3, 2, 2, 1).select("track", "frame", r6("a").alias("a"))


_CHAIN = "WITH RECURSIVE {views}, seq AS (SELECT track, t, row_number() OVER (PARTITION BY track ORDER BY t) AS i FROM {source}), " "run(track, i, t, e, g) AS (SELECT track, i, t, t, 1 FROM seq WHERE i = 1 UNION ALL SELECT s.track, s.i, s.t, CASE WHEN s.t - r.e <= {delta} + 1e-12 THEN {merged} ELSE s.t END, CASE WHEN s.t - r.e <= {delta} + 1e-12 THEN g ELSE g + 1 END FROM run r JOIN seq s ON s.track = r.track AND s.i = r.i + 1) "
_LAST = f"SELECT track, {s6('arg_max(e, i)')} AS t FROM run GROUP BY track, g"


@query("onset_times", _CHAIN.format(views=ACTIVATION + _PICK.rstrip() + ", tms AS (SELECT track, frame / 2.0 + 0.25 AS t FROM pk WHERE h = m AND h > 0)", source="tms", delta="1.5", merged="r.e") + _LAST)
def _(spark, sf):
    return onsets.pick_onsets(act_view(spark, sf), 2.0, 0.1, 0.0, 1.5, 1.0, 1.0, 0.5, combine=1.5, delay=0.25).withColumn("t", r6("t"))


for _how, _merged in (("left", "r.e"), ("right", "s.t"), ("mean", "(r.e + s.t) * 0.5")):

    @query(f"combine_{_how}", _CHAIN.format(views=ONSETS, source="ons", delta="0.15", merged=_merged) + _LAST)
    def _(spark, sf, how=_how):
        return onsets.combine_events(onset_view(spark, sf), 0.15, how).withColumn("t", r6("t"))
