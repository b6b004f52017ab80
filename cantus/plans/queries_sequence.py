"""Queries on tempo, sequence models, state spaces, decoders, notes, chords and keys."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import beats, labels, sequence, states, tempo
from ..operators.series import map_series
from .registry import ORACLES, query, query_on, r6, s6
from .views import ACTIVATION, SIGNAL, SPECTROGRAM, SYMBOLS
from .views import activation as act_view
from .views import signal as signal_view
from .views import spectrogram as spec_view
from .views import symbols as obs_view

A = f"WITH {ACTIVATION} "
TAUS = list(range(3, 13))


@query("comb_forward", f"WITH {SIGNAL} SELECT track, n, {s6('x + 0.79 * coalesce(lag(x, 3) OVER (PARTITION BY track ORDER BY n), 0)')} AS y FROM sig")
def _(spark, sf):
    return tempo.comb_forward(signal_view(spark, sf), 3, 0.79).select("track", "n", r6("y").alias("y"))


_BACK = "SELECT a.track, a.n, {tau} sum(b.x * pow(0.79::FLOAT::DOUBLE, (a.n - b.n) // {t})) AS y FROM {src} a JOIN {src} b ON b.track = a.track AND b.n <= a.n AND (a.n - b.n) % {t} = 0 GROUP BY 1, 2"


@query("comb_backward", f"WITH {SIGNAL}, y AS ({_BACK.format(tau='', t=3, src='sig')}) SELECT track, n, {s6('y')} AS y FROM y")
def _(spark, sf):
    return tempo.comb_backward(signal_view(spark, sf), 3, 0.79).select("track", "n", r6("y").alias("y"))


@query("comb_bank", f"WITH {SIGNAL}, y AS (" + " UNION ALL ".join(_BACK.format(tau=f"{t} AS tau,", t=t, src="sig").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3") for t in (2, 5)) + f") SELECT track, n, tau, {s6('y')} AS y FROM y")
def _(spark, sf):
    return tempo.comb_bank(signal_view(spark, sf), [2, 5], 0.79).withColumn("y", r6("y"))


@query("comb_bank_split", f"WITH {SIGNAL}, y AS (" + " UNION ALL ".join(_BACK.format(tau=f"{t} AS tau,", t=t, src="sig").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3") for t in (2, 5)) + f") SELECT track, n, tau, {s6('y')} AS y FROM y")
def _(spark, sf):
    return tempo.comb_bank(signal_view(spark, sf), [2, 5], 0.79, block=16).withColumn("y", r6("y"))


@query(
    "comb_backward_columns",
    f"WITH {SPECTROGRAM}, y AS (SELECT a.track, a.frame, a.bin, sum(b.mag * pow(0.79::FLOAT::DOUBLE, (a.frame - b.frame) // 3)) AS y FROM spec a JOIN spec b ON b.track = a.track AND b.bin = a.bin AND b.frame <= a.frame AND (a.frame - b.frame) % 3 = 0 GROUP BY ALL) SELECT track, frame, bin, {s6('y')} AS y FROM y",
)
def _(spark, sf):
    bins = F.sort_array(F.collect_list(F.struct("bin", "mag")))
    wide = spec_view(spark, sf).groupBy("track", F.col("frame").alias("n")).agg(bins.alias("s")).select("track", "n", F.col("s.mag").alias("x"))
    return tempo.comb_backward_columns(wide, 3, 0.79, 64, block=16).select("track", F.col("n").alias("frame"), F.posexplode("y").alias("bin", "y")).select("track", "frame", F.col("bin").cast("bigint").alias("bin"), r6("y").alias("y"))


_ACF = "acf AS (SELECT a.track, t AS tau, sum(abs(a.a * b.a)) AS bin FROM act a JOIN range(3, 13) r(t) ON true JOIN act b ON b.track = a.track AND b.frame = a.frame + t GROUP BY 1, 2)"


@query("acf_histogram", A + f", {_ACF} SELECT track, tau::INTEGER AS tau, {s6('bin')} AS bin FROM acf")
def _(spark, sf):
    return tempo.acf_histogram(act_view(spark, sf), TAUS).withColumn("bin", r6("bin"))


_SMOOTH = "sm AS (SELECT h.track, h.tau, sum(g.bin * (0.54 - 0.46 * cos(2 * pi() * k / 2))) AS bin FROM acf h JOIN range(0, 3) r(k) ON true JOIN acf g ON g.track = h.track AND g.tau = h.tau + 1 - k GROUP BY 1, 2)"


@query("smooth_histogram", A + f", {_ACF}, {_SMOOTH} SELECT track, tau::INTEGER AS tau, {s6('bin')} AS bin FROM sm")
def _(spark, sf):
    return tempo.smooth_histogram(tempo.acf_histogram(act_view(spark, sf), TAUS), 3).withColumn("bin", r6("bin"))


@query("dominant_interval", A + f", {_ACF} SELECT track, arg_max(tau, {s6('bin')})::INTEGER AS tau FROM acf GROUP BY track")
def _(spark, sf):
    return tempo.dominant_interval(tempo.acf_histogram(act_view(spark, sf), TAUS).withColumn("bin", r6("bin")))


_PEAKS = (
    ", nb AS (SELECT *, coalesce(lag(bin) OVER w, last_value(bin) OVER (PARTITION BY track ORDER BY tau ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p, coalesce(lead(bin) OVER w, first_value(bin) OVER w) AS x FROM {src} WINDOW w AS (PARTITION BY track ORDER BY tau)), "
    "pk AS (SELECT track, tau, bin FROM nb WHERE bin > p AND bin > x), "
    "rk AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY bin DESC, tau DESC)::INTEGER AS rank, 60.0 * 2.0 / tau AS bpm, bin / sum(bin) OVER (PARTITION BY track) AS strength FROM pk) "
)


@query("detect_tempo", A + f", {_ACF}" + _PEAKS.format(src="acf") + f"SELECT track, rank, {s6('bpm')} AS bpm, {s6('strength')} AS strength FROM rk")
def _(spark, sf):
    return tempo.detect_tempo(tempo.acf_histogram(act_view(spark, sf), TAUS), 2.0).withColumn("bpm", r6("bpm")).withColumn("strength", r6("strength"))


@query("estimate_tempo_acf", A + f", {_ACF}, {_SMOOTH}" + _PEAKS.format(src="sm") + f"SELECT track, rank, {s6('bpm')} AS bpm, {s6('strength')} AS strength FROM rk")
def _(spark, sf):
    return tempo.estimate_tempo(act_view(spark, sf), 2.0, 10.0, 40.0, "acf", None, 3).withColumn("bpm", r6("bpm")).withColumn("strength", r6("strength"))


def _comb(low: int, high: int) -> str:
    """Resonators by recursion, as their definition has it, and the share of each frame's largest ones."""
    return (
        f"WITH RECURSIVE {ACTIVATION}, cb(track, tau, frame, y) AS (SELECT track, t, frame, a FROM act, range({low}, {high}) r(t) WHERE frame < t "
        "UNION ALL SELECT c.track, c.tau, a.frame, a.a + 0.79::FLOAT::DOUBLE * c.y FROM cb c JOIN act a ON a.track = c.track AND a.frame = c.frame + c.tau), "
        "wn AS (SELECT *, max(y) OVER (PARTITION BY track, frame) AS m FROM cb), acf AS (SELECT track, tau, sum(CASE WHEN y = m THEN y ELSE 0 END) AS bin FROM wn GROUP BY 1, 2) "
    )


@query("comb_histogram", _comb(3, 7) + f"SELECT track, tau::INTEGER AS tau, {s6('bin')} AS bin FROM acf")
def _(spark, sf):
    return tempo.comb_histogram(act_view(spark, sf), [3, 4, 5, 6]).withColumn("bin", r6("bin"))


@query("estimate_tempo_comb", _comb(3, 13) + f", {_SMOOTH}" + _PEAKS.format(src="sm") + f"SELECT track, rank, {s6('bpm')} AS bpm, {s6('strength')} AS strength FROM rk")
def _(spark, sf):
    return tempo.estimate_tempo(act_view(spark, sf), 2.0, 10.0, 40.0, "comb", None, 3).withColumn("bpm", r6("bpm")).withColumn("strength", r6("strength"))


# --- hidden Markov models -------------------------------------------------------------------------------------------

TRANSITION = [(0, 0, 0.625), (0, 1, 0.375), (1, 0, 0.25), (1, 1, 0.5), (1, 2, 0.25), (2, 1, 0.125), (2, 2, 0.875)]
EMISSION = [[0.5, 0.25, 0.125, 0.125], [0.125, 0.625, 0.125, 0.125], [0.25, 0.125, 0.125, 0.5]]
_HMM = (
    f"WITH RECURSIVE {SYMBOLS}, tr(s, d, p) AS (VALUES {', '.join(map(str, TRANSITION))}), em(s, o, e) AS (VALUES {', '.join(str((s, o, e)) for s, row in enumerate(EMISSION) for o, e in enumerate(row))})"
)


def _chain():
    src, dst, prob = zip(*TRANSITION)
    return sequence.Transitions.of(src, dst, prob)


_VITERBI = (
    _HMM + ", v(track, frame, s, lp, path) AS ("
    "SELECT o.track, o.frame, d::INTEGER, max(ln(1 / 3.0) + ln(p::DOUBLE)) + any_value(ln(e::DOUBLE)), d::VARCHAR FROM obs o JOIN tr ON true JOIN em ON em.s = tr.d AND em.o = o.symbol WHERE o.frame = 0 GROUP BY 1, 2, d "
    "UNION ALL SELECT o.track, o.frame, d::INTEGER, max(v.lp + ln(p::DOUBLE)) + any_value(ln(e::DOUBLE)), arg_max(v.path, v.lp + ln(p::DOUBLE) - tr.s * 1e-13) || d::VARCHAR FROM v JOIN tr ON tr.s = v.s JOIN obs o ON o.track = v.track AND o.frame = v.frame + 1 JOIN em ON em.s = tr.d AND em.o = o.symbol GROUP BY 1, 2, d), "
    "fin AS (SELECT v.track, max(lp) AS lp, arg_max(path, lp) AS path FROM v JOIN (SELECT track, max(frame) AS f FROM obs GROUP BY 1) l ON l.track = v.track AND l.f = v.frame GROUP BY 1) "
)


@query("hmm_viterbi_log_prob", _VITERBI + f"SELECT track, {s6('lp')} AS log_prob FROM fin")
def _(spark, sf):
    return sequence.decode_symbols(obs_view(spark, sf), _chain(), EMISSION).groupBy("track").agg(r6(F.max("log_prob")).alias("log_prob"))


@query("hmm_viterbi_path", _VITERBI + f"SELECT track, i - 1 AS frame, substr(path, i::INTEGER, 1)::BIGINT AS state, {s6('lp')} AS log_prob FROM (SELECT *, unnest(range(1, length(path) + 1)) AS i FROM fin)")
def _(spark, sf):
    return sequence.decode_symbols(obs_view(spark, sf), _chain(), EMISSION).withColumn("log_prob", r6("log_prob"))


_FORWARD = (
    _HMM + ", f(track, frame, s, p) AS (SELECT track, frame, s, p / sum(p) OVER (PARTITION BY track, frame) FROM (SELECT o.track, o.frame, d::INTEGER AS s, sum(tr.p::DOUBLE / 3) * any_value(e::DOUBLE) AS p FROM obs o JOIN tr ON true JOIN em ON em.s = tr.d AND em.o = o.symbol WHERE o.frame = 0 GROUP BY 1, 2, d) "
    "UNION ALL SELECT track, frame, s, p / sum(p) OVER (PARTITION BY track, frame) FROM (SELECT o.track, o.frame, d::INTEGER AS s, sum(f.p * tr.p::DOUBLE) * any_value(e::DOUBLE) AS p FROM f JOIN tr ON tr.s = f.s JOIN obs o ON o.track = f.track AND o.frame = f.frame + 1 JOIN em ON em.s = tr.d AND em.o = o.symbol GROUP BY 1, 2, d)) "
)


@query("hmm_forward", _FORWARD + f"SELECT track, frame, s::BIGINT AS state, {s6('p')} AS prob FROM f")
def _(spark, sf):
    return sequence.forward_symbols(obs_view(spark, sf), _chain(), EMISSION).withColumn("prob", r6("prob"))


@query("hmm_make_sparse", f"WITH {SYMBOLS}, mv AS (SELECT symbol AS src, lead(symbol) OVER (PARTITION BY track ORDER BY frame) AS dst FROM obs), c AS (SELECT dst, src, count(*) AS n FROM mv WHERE dst IS NOT NULL GROUP BY 1, 2) SELECT dst, src, {s6('n::DOUBLE / sum(n) OVER (PARTITION BY src)')} AS prob, 1.0::DOUBLE AS total FROM c")
def _(spark, sf):
    moves = obs_view(spark, sf).select(F.col("symbol").alias("src"), F.lead("symbol").over(Window.partitionBy("track").orderBy("frame")).alias("dst")).dropna()
    edges = moves.withColumn("prob", F.lit(1.0)).groupBy("src", "dst").agg(F.sum("prob").alias("prob"))
    shares = edges.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy("src")))
    return sequence.make_sparse(shares).select("dst", "src", r6("prob").alias("prob"), r6("total").alias("total"))


CRF = sequence.ConditionalRandomField(
    np.array([0.5, 0.25, -0.25]), np.array([0.125, 0.0, 0.5]), np.array([0.1, -0.2, 0.3]), np.array([[1.0, -0.5, 0.25], [0.5, 0.75, -1.0], [-0.25, 0.5, 1.25]]), np.array([[1.0, -1.0, 0.5], [-0.5, 1.5, 0.25], [0.75, 0.25, -1.0], [0.1, 0.2, 0.3]])
)


def _fold(size: int) -> str:
    """The magnitudes of every ``size``-th bin as one."""
    return f"{SPECTROGRAM}, fold AS (SELECT track, frame, bin % {size} AS bin, avg(mag) AS mag FROM spec GROUP BY 1, 2, 3)"


def _vectors(spark, sf, size):
    folded = spec_view(spark, sf).groupBy("track", "frame", (F.col("bin") % size).alias("bin")).agg(F.avg("mag").alias("mag"))
    frames = folded.groupBy("track", "frame").agg(F.sort_array(F.collect_list(F.struct("bin", "mag"))).alias("s"))
    return frames.select("track", "frame", F.col("s.mag").alias("x"))


_T = [(i, j, float(v)) for i, row in enumerate(CRF.transition) for j, v in enumerate(row)]
_LOCAL = f"lo AS (SELECT track, frame, s, list_extract([{', '.join(str(float(b)) for b in CRF.bias)}], s + 1)::DOUBLE + sum(mag * w::DOUBLE) AS l FROM fold JOIN (VALUES {', '.join(str((f, s, float(w))) for f, row in enumerate(CRF.observation) for s, w in enumerate(row))}) ob(f, s, w) ON ob.f = fold.bin GROUP BY 1, 2, 3)"


@query(
    "crf_decode",
    f"WITH RECURSIVE {_fold(4)}, {_LOCAL}, tr(s, d, w) AS (VALUES {', '.join(map(str, _T))}), v(track, frame, s, sc, path) AS ("
    f"SELECT track, frame, s, list_extract([{', '.join(str(float(b)) for b in CRF.initial)}], s + 1)::DOUBLE + l, s::VARCHAR FROM lo WHERE frame = 0 "
    "UNION ALL SELECT l.track, l.frame, l.s, max(v.sc + w::DOUBLE) + any_value(l.l), arg_max(v.path, v.sc + w::DOUBLE) || l.s::VARCHAR FROM v JOIN tr ON tr.s = v.s JOIN lo l ON l.track = v.track AND l.frame = v.frame + 1 AND l.s = tr.d GROUP BY 1, 2, 3), "
    "nf AS (SELECT track, max(frame) AS f FROM lo GROUP BY 1), "
    f"bst AS (SELECT v.track, arg_max(path, sc + list_extract([{', '.join(str(float(b)) for b in CRF.final)}], s + 1)::DOUBLE) AS path FROM v JOIN nf ON nf.track = v.track AND nf.f = v.frame GROUP BY 1) "
    "SELECT track, i - 1 AS frame, substr(path, i::INTEGER, 1)::BIGINT AS state FROM (SELECT track, path, unnest(range(1, length(path) + 1)) AS i FROM bst)",
)
def _(spark, sf):
    return sequence.crf_decode(_vectors(spark, sf, 4), CRF)


MEANS = np.array([[0.1, 0.2, 0.1], [0.05, 0.05, 0.3]])
MIXTURES = {
    "diag": sequence.Mixture(np.array([0.25, 0.75]), MEANS, np.array([[0.02, 0.03, 0.01], [0.05, 0.01, 0.04]]), "diag"),
    "spherical": sequence.Mixture(np.array([0.5, 0.5]), MEANS, np.array([0.02, 0.04]), "spherical"),
}


def _gaussian(kind: str) -> str:
    m = MIXTURES[kind]
    rows = []
    for k in range(2):
        cov = m.covars[k] if kind == "diag" else [m.covars[k]] * 3
        rows += [(k, d, float(MEANS[k, d]), float(cov[d]), float(m.weights[k])) for d in range(3)]
    return (
        f"WITH {_fold(3)}, gm(k, d, mu, cv, wt) AS (VALUES {', '.join(map(str, rows))}), sc AS (SELECT track, frame, k, -0.5 * sum(ln(2 * pi() * cv::DOUBLE) + (mag - mu::DOUBLE) * (mag - mu::DOUBLE) / cv::DOUBLE) + ln(any_value(wt::DOUBLE)) AS s FROM fold JOIN gm ON gm.d = bin GROUP BY 1, 2, 3), "
        f"tp AS (SELECT *, max(s) OVER (PARTITION BY track, frame) AS m FROM sc), lp AS (SELECT *, m + ln(sum(exp(s - m)) OVER (PARTITION BY track, frame)) AS l FROM tp) SELECT track, frame, k AS component, {s6('l')} AS log_prob, {s6('exp(s - l)')} AS responsibility FROM lp"
    )


for _kind in ("diag", "spherical"):

    @query(f"gmm_{_kind}", _gaussian(_kind))
    def _(spark, sf, kind=_kind):
        return sequence.mixture_scores(_vectors(spark, sf, 3), MIXTURES[kind]).withColumn("log_prob", r6("log_prob")).withColumn("responsibility", r6("responsibility"))


_FULL = sequence.Mixture(np.array([0.4, 0.6]), np.array([[0.1, 0.2], [0.05, 0.1]]), np.array([[[0.04, 0.01], [0.01, 0.05]], [[0.03, -0.01], [-0.01, 0.02]]]), "full")


_TIED = sequence.Mixture(_FULL.weights, _FULL.means, np.array([[0.05, 0.02], [0.02, 0.03]]), "tied")


def _full_sql(mixture) -> str:
    rows = []
    for k in range(2):
        (a, b), (_, d) = mixture.covars[k] if mixture.kind == "full" else mixture.covars
        det = a * d - b * b
        rows.append((k, *map(float, (mixture.means[k, 0], mixture.means[k, 1], d / det, -b / det, a / det, math.log(det), mixture.weights[k]))))
    return (
        f"WITH {_fold(2)}, gm AS (SELECT k, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('m0', 'm1', 'p00', 'p01', 'p11', 'ld', 'wt'))} FROM (VALUES {', '.join(map(str, rows))}) t(k, m0, m1, p00, p01, p11, ld, wt)), "
        "xy AS (SELECT track, frame, max(CASE WHEN bin = 0 THEN mag END) AS x, max(CASE WHEN bin = 1 THEN mag END) AS y FROM fold GROUP BY 1, 2), "
        "sc AS (SELECT track, frame, k, -0.5 * (2 * ln(2 * pi()) + ld + (x - m0) * (x - m0) * p00 + 2 * (x - m0) * (y - m1) * p01 + (y - m1) * (y - m1) * p11) + ln(wt) AS s FROM xy, gm), "
        f"tp AS (SELECT *, max(s) OVER (PARTITION BY track, frame) AS m FROM sc), lp AS (SELECT *, m + ln(sum(exp(s - m)) OVER (PARTITION BY track, frame)) AS l FROM tp) SELECT track, frame, k AS component, {s6('l')} AS log_prob, {s6('exp(s - l)')} AS responsibility FROM lp"
    )


for _mixture in (_FULL, _TIED):

    @query(f"gmm_{_mixture.kind}", _full_sql(_mixture))
    def _(spark, sf, mixture=_mixture):
        return sequence.mixture_scores(_vectors(spark, sf, 2), mixture).withColumn("log_prob", r6("log_prob")).withColumn("responsibility", r6("responsibility"))


@query("log_sum_exp", f"WITH {SPECTROGRAM} SELECT track, frame, {s6('max(mag) + ln(sum(exp(mag - mx)))')} AS v FROM (SELECT *, max(mag) OVER (PARTITION BY track, frame) AS mx FROM spec) GROUP BY 1, 2")
def _(spark, sf):
    v = sequence.log_sum_exp(F.col("mag"), Window.partitionBy("track", "frame"))
    return spec_view(spark, sf).withColumn("v", v).groupBy("track", "frame").agg(r6(F.first("v")).alias("v"))


# --- state spaces ---------------------------------------------------------------------------------------------------

_BEAT = "iv AS (SELECT i, sum(i) OVER (ORDER BY i) - i AS o FROM range(3, 8) t(i)), bs AS (SELECT o + k AS state, k::DOUBLE / i AS position, i AS interval FROM (SELECT *, unnest(range(0, i)) AS k FROM iv)), nb AS (SELECT count(*) AS n FROM bs)"


@query_on("activation", "state", "beat_states", f"WITH {_BEAT} SELECT state::BIGINT AS state, {s6('position')} AS position, interval, 0::BIGINT AS pattern FROM bs")
def _(spark, sf):
    return states.beat_space(3, 7).table(spark).withColumn("position", r6("position"))


@query_on("activation", "state", "bar_states", f"WITH {_BEAT} SELECT (state + b * n)::BIGINT AS state, {s6('position + b')} AS position, interval, 0::BIGINT AS pattern FROM bs, nb, range(0, 3) t(b)")
def _(spark, sf):
    return states.bar_space(3, 3, 7).table(spark).withColumn("position", r6("position"))


_EDGES = (
    f"{_BEAT}, f AS (SELECT i, o FROM iv), ch AS (SELECT a.o + a.i - 1 AS src, b.o AS dst, a.i AS ai, exp(-10.0 * abs(b.i::DOUBLE / a.i - 1)) AS p FROM iv a, iv b), "
    "ed AS (SELECT s.state - 1 AS src, s.state AS dst, 1.0::DOUBLE AS p FROM bs s WHERE s.position > 0 UNION ALL SELECT src, dst, p / sum(p) OVER (PARTITION BY src) FROM ch)"
)


@query_on("activation", "before", "exponential_transition", f"WITH {_EDGES} SELECT ai AS before, i AS after, {s6('p / sum(p) OVER (PARTITION BY src)')} AS prob FROM ch JOIN iv ON iv.o = ch.dst")
def _(spark, sf):
    intervals = np.arange(3, 8)
    p = states.exponential_transition(intervals, intervals, 10.0)
    return spark.createDataFrame([(int(a), int(b), float(p[i, j])) for i, a in enumerate(intervals) for j, b in enumerate(intervals)], "before bigint, after bigint, prob double").withColumn("prob", r6("prob"))


@query_on("activation", "src", "beat_transitions", f"WITH {_EDGES} SELECT dst::BIGINT AS dst, src::BIGINT AS src, {s6('p')} AS prob FROM ed")
def _(spark, sf):
    return states.beat_transitions(states.beat_space(3, 7), 10.0).table(spark).withColumn("prob", r6("prob"))


@query_on(
    "activation", "src", "bar_transitions",
    f"WITH {_EDGES} SELECT (dst + b * n)::BIGINT AS dst, (src + b * n)::BIGINT AS src, {s6('p')} AS prob FROM ed, nb, range(0, 2) t(b) WHERE src = dst - 1 AND p = 1.0 "
    f"UNION ALL SELECT (dst + b * n)::BIGINT, (src + (1 - b) * n)::BIGINT, {s6('p / sum(p) OVER (PARTITION BY src, b)')} FROM ch, nb, range(0, 2) t(b)",
)
def _(spark, sf):
    return states.bar_transitions(states.bar_space(2, 3, 7), 10.0).table(spark).withColumn("prob", r6("prob"))


@query_on(
    "activation", "src", "pattern_transitions",
    f"WITH {_EDGES}, pt(k, beats, o) AS (SELECT 0, 3, 0 UNION ALL SELECT 1, 4, 3 * n FROM nb), pn AS (SELECT src, dst, p / sum(p) OVER (PARTITION BY src) AS p FROM ch) "
    f"SELECT (dst + b * n + pt.o)::BIGINT AS dst, (src + b * n + pt.o)::BIGINT AS src, 1.0::DOUBLE AS prob FROM ed, nb, pt, range(0, 4) t(b) WHERE b < beats AND src = dst - 1 AND p = 1.0 "
    f"UNION ALL SELECT (dst + (b + 1) % beats * n + pt.o)::BIGINT, (src + b * n + pt.o)::BIGINT, {s6('p * CASE WHEN b = beats - 1 THEN 0.9 ELSE 1.0 END')} FROM pn, nb, pt, range(0, 4) t(b) WHERE b < beats "
    f"UNION ALL SELECT (dst + q.o)::BIGINT, (src + (pt.beats - 1) * n + pt.o)::BIGINT, {s6('p * 0.1')} FROM pn, nb, pt JOIN pt q ON q.k <> pt.k",
)
def _(spark, sf):
    spaces = [states.bar_space(b, 3, 7) for b in (3, 4)]
    space = states.multi_pattern_space(spaces)
    return states.multi_pattern_transitions([states.bar_transitions(s, 10.0) for s in spaces], space, 0.1).table(spark).withColumn("prob", r6("prob"))


_NOTE = [(0, 0, 0.2), (0, 1, 0.8), (1, 0, 0.2), (1, 2, 0.8), (2, 0, 0.2), (2, 3, 0.8), (3, 3, 0.8 / 1.8), (3, 1, 0.8 / 1.8), (3, 4, 0.2 / 1.8), (4, 0, 1.0)]


@query_on("activation", "src", "note_transitions", f"SELECT d::BIGINT AS dst, s::BIGINT AS src, {s6('p::DOUBLE')} AS prob FROM (VALUES {', '.join(map(str, _NOTE))}) t(s, d, p)")
def _(spark, sf):
    return states.note_transitions(states.NoteStates()).table(spark).withColumn("prob", r6("prob"))


_CLIP = "greatest(least(a, 0.99), 0.01)"


@query("beat_densities", A + f"SELECT track, frame, {s6(f'ln((1 - {_CLIP}) / 15)')} AS rest, {s6(f'ln({_CLIP})')} AS beat FROM act")
def _(spark, sf):
    a = F.greatest(F.least("a", F.lit(0.99)), F.lit(0.01))
    clipped = act_view(spark, sf).withColumn("a", a)
    return map_series(clipped, ["frame", "a"], lambda c: {"frame": c["frame"], "rest": states.beat_densities(c["a"], 16)[:, 0], "beat": states.beat_densities(c["a"], 16)[:, 1]}, "frame bigint, rest double, beat double").select("track", "frame", r6("rest").alias("rest"), r6("beat").alias("beat"))


# --- decoders -------------------------------------------------------------------------------------------------------


@query("threshold_activations", A + f", lm AS (SELECT track, min(frame) AS lo, max(frame) AS hi FROM act WHERE a >= 0.6 GROUP BY 1) SELECT a.track, frame, {s6('a')} AS a FROM act a JOIN lm ON a.track = lm.track AND frame BETWEEN lo AND hi WHERE hi > 0")
def _(spark, sf):
    return beats.threshold_activations(act_view(spark, sf), 0.6).withColumn("a", r6("a"))


def _pulses(spark, sf):
    """Activations with a pulse every seventh frame added to what the events give."""
    a = act_view(spark, sf)
    return a.withColumn("a", F.least(F.col("a") * 0.3 + F.when(F.col("frame") % 7 == 3, 0.6).otherwise(0.02), F.lit(0.99)))


_PULSES = f"{ACTIVATION}, pu AS (SELECT track, frame, least(a * 0.3 + CASE WHEN frame % 7 = 3 THEN 0.6 ELSE 0.02 END, 0.99) AS a FROM act)"


def _decoded(low: int, high: int, models: list[tuple[int, int]], density: str, change: float | None = None) -> str:
    """Viterbi by recursion over bars (model, beats) of beats of ``low`` to ``high`` frames; ``change``: one model of patterns.

    ob (track, i, ...) are the frames in order from 0. The result is sq (track, g, i, m, b, k, iv) and its score lp.
    """
    group = "m" if change is None else "0"
    places, offset = [], 0
    for m, count in models:
        places.append((m, count, offset))
        offset += 0 if change is None else count
    jumps = "SELECT {g} AS g, (off + b) * n + ao + ai - 1 AS src, (off + (b + 1) % beats) * n + co AS dst, p * {w} AS p FROM md, nz, jm, range(0, 5) u(b) WHERE b < beats"
    edges = jumps.format(g=group, w="1.0" if change is None else f"CASE WHEN b = beats - 1 THEN 1 - {change}::DOUBLE ELSE 1.0 END")
    if change is not None:
        edges += f" UNION ALL SELECT 0, (md.off + md.beats - 1) * n + ao + ai - 1, o.off * n + co, p * {change}::DOUBLE FROM md JOIN md o ON o.m <> md.m, nz, jm"
    return (
        f"iv AS (SELECT i, sum(i) OVER (ORDER BY i) - i AS o FROM range({low}, {high + 1}) t(i)), nz AS (SELECT sum(i) AS n FROM iv), "
        "jm AS (SELECT ai, ao, ci, co, q / sum(q) OVER (PARTITION BY ai) AS p FROM (SELECT a.i AS ai, a.o AS ao, c.i AS ci, c.o AS co, exp(-100.0 * abs(c.i::DOUBLE / a.i - 1)) AS q FROM iv a, iv c) WHERE q > 2.220446049250313e-16), "
        f"md(m, beats, off) AS (VALUES {', '.join(map(str, places))}), "
        f"st AS (SELECT {group} AS g, m, ((off + b) * n + o + k)::BIGINT AS s, b, k, i AS iv FROM md, nz, iv, range(0, 16) r(k), range(0, 5) u(b) WHERE k < i AND b < beats), "
        f"ed AS (SELECT g, s - 1 AS src, s AS dst, 1.0::DOUBLE AS p FROM st WHERE k > 0 UNION ALL SELECT g, src::BIGINT, dst::BIGINT, p FROM ({edges})), "
        "en AS (SELECT ed.g, dst, max(ln(p)) - ln(any_value(c)) AS lp FROM ed JOIN (SELECT g, count(*) AS c FROM st GROUP BY 1) z ON z.g = ed.g GROUP BY 1, 2), "
        f"v(track, g, i, s, lp, path) AS (SELECT track, st.g, o.i, s, en.lp + {density}, lpad(s::VARCHAR, 3, '0') FROM ob o, st JOIN en ON en.g = st.g AND en.dst = st.s WHERE o.i = 0 "
        f"UNION ALL SELECT o.track, st.g, o.i, ed.dst, max(v.lp + ln(p)) + any_value({density}), arg_max(v.path, v.lp + ln(p) - ed.src * 1e-13) || lpad(ed.dst::VARCHAR, 3, '0') "
        "FROM v JOIN ed ON ed.g = v.g AND ed.src = v.s JOIN st ON st.g = ed.g AND st.s = ed.dst JOIN ob o ON o.track = v.track AND o.i = v.i + 1 GROUP BY o.track, st.g, o.i, ed.dst), "
        "bp AS (SELECT v.track, v.g, max(lp) AS lp, arg_max(path, lp) AS path FROM v JOIN (SELECT track, max(i) AS e FROM ob GROUP BY 1) l ON l.track = v.track AND l.e = v.i GROUP BY 1, 2), "
        "sq AS (SELECT q.track, q.g, q.lp, q.i - 1 AS i, m, b, k, iv FROM (SELECT *, unnest(range(1, length(path) // 3 + 1)) AS i FROM bp) q JOIN st ON st.g = q.g AND st.s = substr(path, (3 * q.i - 2)::INTEGER, 3)::BIGINT)"
    )


_BEAT_OBS = "CASE WHEN k = 0 THEN ln(o.a) ELSE ln((1 - o.a) / 15) END"


@query("dbn_beats", f"WITH RECURSIVE {_PULSES}, ob AS (SELECT track, frame AS i, a FROM pu), {_decoded(3, 11, [(0, 1)], _BEAT_OBS)} SELECT track, {s6('i / 10.0')} AS t FROM sq WHERE k = 0")
def _(spark, sf):
    return beats.dbn_beats(_pulses(spark, sf), 10.0, 55, 215).withColumn("t", r6("t"))


@query(
    "estimate_tempo_dbn",
    f"WITH RECURSIVE {_PULSES}, ob AS (SELECT track, frame AS i, a FROM pu), {_decoded(3, 12, [(0, 1)], _BEAT_OBS)}, acf AS (SELECT t.track, tau, count(sq.iv)::DOUBLE AS bin FROM (SELECT DISTINCT track FROM ob) t JOIN range(3, 13) r(tau) ON true LEFT JOIN sq ON sq.track = t.track AND sq.iv = tau GROUP BY 1, 2), {_SMOOTH}"
    + _PEAKS.format(src="sm") + f"SELECT track, rank, {s6('bpm')} AS bpm, {s6('strength')} AS strength FROM rk",
)
def _(spark, sf):
    return tempo.estimate_tempo(_pulses(spark, sf), 2.0, 10.0, 40.0, "dbn", None, 3).withColumn("bpm", r6("bpm")).withColumn("strength", r6("strength"))


@query(
    "dbn_downbeats",
    f"WITH RECURSIVE {_PULSES}, dw AS (SELECT track, frame, a * 0.3 AS a, CASE WHEN frame % 28 = 3 THEN a * 0.7 ELSE a * 0.05 END AS d FROM pu), lm AS (SELECT track, min(frame) AS lo, max(frame) AS hi FROM dw WHERE greatest(a, d) >= 0.05 GROUP BY 1), "
    f"ob AS (SELECT dw.track, frame - lo AS i, a, d FROM dw JOIN lm ON lm.track = dw.track AND frame BETWEEN lo AND hi), {_decoded(3, 11, [(0, 3), (1, 4)], 'CASE WHEN k > 0 THEN ln((1 - (o.a + o.d)) / 15) WHEN b = 0 THEN ln(o.d) ELSE ln(o.a) END')}, "
    f"bt AS (SELECT track, arg_max(g, lp - g * 1e-9) AS g FROM bp GROUP BY 1) SELECT sq.track, {s6('(i + lo) / 10.0')} AS t, b + 1 AS beat FROM sq JOIN bt ON bt.track = sq.track AND bt.g = sq.g JOIN lm ON lm.track = sq.track WHERE k = 0",
)
def _(spark, sf):
    return beats.dbn_downbeats(_bars(spark, sf), 10.0, (3, 4), 55, 215, None).withColumn("t", r6("t"))


def _bars(spark, sf):
    p = _pulses(spark, sf)
    down = F.when((F.col("frame") % 28 == 3), F.col("a") * 0.7).otherwise(F.col("a") * 0.05)
    return p.select("track", "frame", (F.col("a") * 0.3).alias("beat"), down.alias("downbeat"))


# --- the same decoders over split tracks ----------------------------------------------------------------------------


@query("hmm_path_split", f"SELECT track, frame, state FROM ({ORACLES['hmm_viterbi_path']})")
def _(spark, sf):
    return sequence.decode_symbols(obs_view(spark, sf), _chain(), EMISSION, block=16).select("track", "frame", "state")


@query("dbn_beats_split", ORACLES["dbn_beats"])
def _(spark, sf):
    return beats.dbn_beats(_pulses(spark, sf), 10.0, 55, 215, block=128).withColumn("t", r6("t"))


@query("dbn_downbeats_split", ORACLES["dbn_downbeats"])
def _(spark, sf):
    return beats.dbn_downbeats(_bars(spark, sf), 10.0, (3, 4), 55, 215, None, block=128).withColumn("t", r6("t"))


_BAR_PLACES = [(m, b) for m in (3, 4) for b in range(1, m + 1)]
_BAR_MOVES = [(m, b, m, b + 1, 1.0) for m, b in _BAR_PLACES if b < m] + [(m, m, k, 1, 1 - 1e-7 if k == m else 1e-7) for m in (3, 4) for k in (3, 4)]
_BAR_OBS = "CASE WHEN {b} = 1 THEN ln(a) ELSE ln((1 - a) / 99) END"


@query(
    "dbn_bars",
    f"WITH RECURSIVE {ACTIVATION}, bl AS (SELECT track, frame // 12 AS block, greatest(least(avg(a), 0.99), 0.01) AS a FROM act GROUP BY 1, 2), ob AS (SELECT track, block * 6.0 AS t, a, row_number() OVER (PARTITION BY track ORDER BY block) AS i, count(*) OVER (PARTITION BY track) AS n FROM bl), "
    f"pl(m, b) AS (VALUES {', '.join(map(str, _BAR_PLACES))}), mv(m, b, m2, b2, p) AS (SELECT m, b, m2, b2, p::DOUBLE FROM (VALUES {', '.join(str((*x[:4], f'{x[4]:.17g}')) for x in _BAR_MOVES)}) t(m, b, m2, b2, p)), "
    f"v(track, i, m, b, lp, path) AS (SELECT track, i, m, b, ln(1 / 7.0::DOUBLE) + CASE WHEN b = 1 THEN ln(1 - 1e-7::DOUBLE) ELSE 0 END + {_BAR_OBS.format(b='b')}, m::VARCHAR || b::VARCHAR FROM ob, pl WHERE i = 1 "
    f"UNION ALL SELECT o.track, o.i, mv.m2, mv.b2, max(v.lp + ln(p)) + any_value({_BAR_OBS.format(b='mv.b2')}), arg_max(v.path, v.lp + ln(p)) || mv.m2::VARCHAR || mv.b2::VARCHAR FROM v JOIN mv ON mv.m = v.m AND mv.b = v.b JOIN ob o ON o.track = v.track AND o.i = v.i + 1 AND o.i < o.n GROUP BY o.track, o.i, mv.m2, mv.b2), "
    "bs AS (SELECT v.track, arg_max(path, lp) AS path FROM v JOIN (SELECT track, max(n) AS n FROM ob GROUP BY 1) e ON e.track = v.track AND v.i = e.n - 1 GROUP BY 1) "
    "SELECT ob.track, t::DOUBLE AS t, CASE WHEN i < n THEN substr(path, (2 * i)::INTEGER, 1)::BIGINT ELSE substr(path, (2 * i - 2)::INTEGER, 1)::BIGINT % substr(path, (2 * i - 3)::INTEGER, 1)::BIGINT + 1 END AS beat FROM ob JOIN bs ON bs.track = ob.track",
)
def _(spark, sf):
    blocks = act_view(spark, sf).groupBy("track", F.expr("frame div 12").alias("block")).agg(F.avg("a").alias("a"))
    marked = blocks.select("track", (F.col("block") * 6.0).alias("t"), F.greatest(F.least("a", F.lit(0.99)), F.lit(0.01)).alias("a"))
    return beats.dbn_bars(marked)


@query(
    "beat_detection",
    f"WITH RECURSIVE {_PULSES}, cb(track, tau, frame, y) AS (SELECT track, t, frame, a FROM pu, range(3, 11) r(t) WHERE frame < t UNION ALL SELECT c.track, c.tau, p.frame, p.a + 0.79::FLOAT::DOUBLE * c.y FROM cb c JOIN pu p ON p.track = c.track AND p.frame = c.frame + c.tau), "
    "wn AS (SELECT *, max(y) OVER (PARTITION BY track, frame) AS m FROM cb), bn AS (SELECT track, tau, sum(y) AS bin FROM wn WHERE y = m GROUP BY 1, 2), "
    "iv AS (SELECT track, arg_max(tau, round(bin, 9) - tau * 1e-10)::BIGINT AS iv, greatest(1, arg_max(tau, round(bin, 9) - tau * 1e-10) // 5)::BIGINT AS aside FROM bn GROUP BY 1), "
    "sn AS (SELECT p.track, p.frame AS pos, iv, CASE WHEN k > 0 THEN p.frame + k - aside ELSE p.frame END AS beat FROM pu p JOIN iv USING (track), range(0, 4) r(k) LEFT JOIN pu q ON q.track = p.track AND q.frame = p.frame + k - aside WHERE k < 2 * aside "
    "QUALIFY row_number() OVER (PARTITION BY p.track, p.frame ORDER BY coalesce(q.a, 0) * (0.54 - 0.46 * cos(2 * pi() * k / (2 * aside - 1))) DESC, k) = 1), "
    "ch(track, start, iv, beat) AS (SELECT track, pos, iv, beat FROM sn WHERE pos < iv UNION ALL SELECT c.track, c.start, c.iv, s.beat FROM ch c JOIN sn s ON s.track = c.track AND s.pos = c.beat + c.iv), "
    "sm AS (SELECT c.track, c.start, round(sum(p.a), 9) AS total FROM ch c JOIN pu p ON p.track = c.track AND p.frame = c.beat GROUP BY 1, 2), "
    f"bs AS (SELECT track, start FROM sm QUALIFY row_number() OVER (PARTITION BY track ORDER BY total DESC, start) = 1) SELECT c.track, {s6('c.beat / 10.0')} AS t FROM ch c JOIN bs USING (track, start)",
)
def _(spark, sf):
    return beats.beat_detection(_pulses(spark, sf), 10.0, min_bpm=60, max_bpm=200).withColumn("t", r6("t"))


@query("beat_tracking")
def _(spark, sf):
    return beats.beat_detection(_pulses(spark, sf), 10.0, look_ahead=10.0, min_bpm=60, max_bpm=200)


@query("crf_beats")
def _(spark, sf):
    return beats.crf_beats(_pulses(spark, sf), 10.0, min_bpm=60, max_bpm=200)


@query(
    "pattern_beats",
    f"WITH RECURSIVE {_PULSES}, ob AS (SELECT track, frame AS i, a FROM pu), {_decoded(3, 10, [(0, 3), (1, 4)], '-0.5 * (ln(2 * pi() * 0.05) + pow(o.a - CASE WHEN 2 * k < iv THEN CASE WHEN m = 0 THEN 0.8 ELSE 0.7 END ELSE CASE WHEN m = 0 THEN 0.1 ELSE 0.2 END END, 2) / 0.05)', 0.01)}, "
    f"nx AS (SELECT *, lag(b) OVER (PARTITION BY track ORDER BY i) AS z FROM sq) SELECT track, {s6('i / 10.0')} AS t, b + 1 AS beat FROM nx WHERE b <> z",
)
def _(spark, sf):
    def mixture(level):
        return sequence.Mixture(np.array([1.0]), np.array([[level]]), np.array([[0.05]]), "diag")

    features = _pulses(spark, sf).select("track", "frame", F.array("a").alias("x"))
    return beats.pattern_beats(features, 10.0, [(3, [mixture(0.8), mixture(0.1)] * 3), (4, [mixture(0.7), mixture(0.2)] * 4)], 60, 200, change=0.01).withColumn("t", r6("t"))


@query(
    "select_model",
    f"WITH {ACTIVATION}, md AS (SELECT 'all' AS track, track AS model, frame, a FROM act), er AS (SELECT track, model, sum(pow(a - m, 2)) AS e FROM (SELECT *, avg(a) OVER (PARTITION BY track, frame) AS m FROM md) GROUP BY 1, 2), bt AS (SELECT track, arg_min(model, e) AS model FROM er GROUP BY 1) SELECT md.track, md.model, frame, {s6('a')} AS a FROM md JOIN bt ON bt.track = md.track AND bt.model = md.model",
)
def _(spark, sf):
    models = act_view(spark, sf).select(F.lit("all").alias("track"), F.col("track").alias("model"), "frame", "a")
    return beats.select_model(models).select("track", "model", "frame", r6("a").alias("a"))


@query(
    "sync_features",
    f"WITH {SPECTROGRAM}, bt AS (SELECT track, frame / 10.0 AS t FROM vec WHERE frame % 9 = 2), ed AS (SELECT track, (max(frame) + 1) / 10.0 AS e FROM vec GROUP BY 1), ok AS (SELECT bt.* FROM bt JOIN ed ON ed.track = bt.track AND t <= e), "
    "ld AS (SELECT track, t, row_number() OVER w - 1 AS beat, lead(t) OVER w AS x FROM ok WINDOW w AS (PARTITION BY track ORDER BY t)), st AS (SELECT *, floor((x - least((x - t) / 4, 0.05)) * 10)::BIGINT AS stop FROM ld), "
    "sp AS (SELECT track, beat, CASE WHEN beat = 0 THEN greatest(0, floor((t - 0.02) * 10)::BIGINT) ELSE lag(stop) OVER (PARTITION BY track ORDER BY t) END AS start, stop FROM st), "
    "fr AS (SELECT track, beat, f AS frame, floor((f - start) * 2.0 / (stop - start))::INTEGER AS division FROM (SELECT *, unnest(range(start, stop)) AS f FROM sp WHERE stop IS NOT NULL)) "
    f"SELECT s.track, beat::INTEGER AS beat, division, bin, {s6('avg(mag)')} AS mag FROM spec s JOIN fr ON fr.track = s.track AND fr.frame = s.frame GROUP BY 1, 2, 3, 4",
)
def _(spark, sf):
    spec = spec_view(spark, sf)
    marks = spec.select("track", "frame").distinct().filter("frame % 9 = 2").select("track", (F.col("frame") / 10.0).alias("t"))
    return beats.sync_features(spec, marks, 2, 10.0).withColumn("mag", r6("mag"))


_SOUND = [(0, 0, 0.2), (0, 1, 0.8), *((k, j, p) for k in (1, 2, 3, 4) for j, p in ((k + 1, 0.8), (0, 0.2))), (5, 5, 0.8 / 2.1), (5, 1, 0.8 / 2.1), (5, 6, 0.5 / 2.1), (6, 0, 1.0)]
_SOUND_OBS = "CASE WHEN {s} = 0 THEN ln(1 - struck) WHEN {s} < 3 THEN ln(struck) WHEN {s} < 6 THEN ln(note) ELSE ln(stop) END"


@query(
    "adsr_notes",
    f"WITH RECURSIVE {ACTIVATION}, lv AS (SELECT track, frame, CASE WHEN frame % 40 BETWEEN 10 AND 23 THEN 0.9 ELSE a * 0.05 + 0.01 END AS note, CASE WHEN frame % 40 BETWEEN 10 AND 12 THEN 0.9 ELSE a * 0.05 + 0.01 END AS struck, CASE WHEN frame % 40 BETWEEN 24 AND 25 THEN 0.9 ELSE a * 0.05 + 0.01 END AS stop FROM act), "
    f"tr(s, d, p) AS (SELECT s, d, p::DOUBLE FROM (VALUES {', '.join(str((*x[:2], f'{x[2]:.17g}')) for x in _SOUND)}) t(s, d, p)), "
    f"v(track, frame, s, lp, path) AS (SELECT track, frame, d, max(ln(1 / 7.0::DOUBLE) + ln(p)) + any_value({_SOUND_OBS.format(s='d')}), d::VARCHAR FROM lv, tr WHERE frame = 0 GROUP BY track, frame, d "
    f"UNION ALL SELECT l.track, l.frame, d, max(v.lp + ln(p)) + any_value({_SOUND_OBS.format(s='d')}), arg_max(v.path, v.lp + ln(p) - tr.s * 1e-13) || d::VARCHAR FROM v JOIN tr ON tr.s = v.s JOIN lv l ON l.track = v.track AND l.frame = v.frame + 1 GROUP BY l.track, l.frame, d), "
    "bs AS (SELECT v.track, arg_max(path, lp) AS path FROM v JOIN (SELECT track, max(frame) AS f FROM act GROUP BY 1) e ON e.track = v.track AND v.frame = e.f GROUP BY 1), "
    "sq AS (SELECT track, i - 1 AS frame, substr(path, i::INTEGER, 1)::INTEGER AS s FROM (SELECT *, unnest(range(1, length(path) + 1)) AS i FROM bs)), "
    "tn AS (SELECT *, CASE WHEN (s BETWEEN 2 AND 5) <> lead(s BETWEEN 2 AND 5) OVER w THEN 1 ELSE 0 END AS c FROM sq WINDOW w AS (PARTITION BY track ORDER BY frame)), "
    "sg AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY frame) AS g FROM tn), "
    "nt AS (SELECT sg.track, g, min(sg.frame) AS f, count(*) AS n, max(note) AS note, max(struck) AS struck, count(DISTINCT CASE WHEN s BETWEEN 1 AND 5 THEN s END) AS stages FROM sg JOIN lv ON lv.track = sg.track AND lv.frame = sg.frame WHERE g % 2 = 1 GROUP BY 1, 2) "
    f"SELECT track, 60 AS pitch, {s6('f / 50.0')} AS onset, {s6('n / 50.0')} AS duration FROM nt WHERE note >= 0.5 AND struck >= 0.5 AND stages = 5",
)
def _(spark, sf):
    a, f = F.col("a"), F.col("frame") % 40
    note = F.when((f >= 10) & (f < 24), 0.9).otherwise(a * 0.05 + 0.01)
    onset = F.when((f >= 10) & (f < 13), 0.9).otherwise(a * 0.05 + 0.01)
    offset = F.when((f >= 24) & (f < 26), 0.9).otherwise(a * 0.05 + 0.01)
    found = beats.adsr_notes(act_view(spark, sf).select("track", F.lit(39).alias("pitch"), "frame", note.alias("note"), onset.alias("onset"), offset.alias("offset")))
    return found.withColumn("onset", r6("onset")).withColumn("duration", r6("duration"))


@query(
    "note_onsets",
    "WITH " + SPECTROGRAM + ", sm AS (SELECT *, sum(mag) OVER (PARTITION BY track, bin ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 + 0.1 AS least FROM spec), hl AS (SELECT *, CASE WHEN mag >= least THEN mag ELSE 0 END AS h FROM sm), "
    f"pk AS (SELECT *, greatest(max(h) OVER (PARTITION BY track, bin ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) AS m FROM hl) SELECT track, {s6('frame / 10.0')} AS t, bin + 21 AS pitch FROM pk WHERE h = m AND h > 0",
)
def _(spark, sf):
    acts = spec_view(spark, sf).select("track", (F.col("bin") + 21).alias("pitch"), "frame", F.col("mag").alias("a"))
    return labels.note_onsets(acts, 10.0, 0.1, pre_avg=0.2, post_avg=0.2, pre_max=0.1, post_max=0.1, combine=0.0).select("track", r6("t").alias("t"), "pitch")


# --- chords and keys ------------------------------------------------------------------------------------------------

_CLASS = f"WITH {SPECTROGRAM}, cl AS (SELECT track, frame, arg_max(bin, {s6('mag')} - bin * 1e-9) % {{m}} AS state FROM (SELECT track, frame, bin // 16 AS bin, max(mag) AS mag FROM spec GROUP BY 1, 2, 3) GROUP BY 1, 2)"


def _classes(spark, sf):
    folded = spec_view(spark, sf).groupBy("track", "frame", F.expr("bin div 16").alias("bin")).agg(F.max("mag").alias("mag"))
    return folded.groupBy("track", "frame").agg(F.max_by("bin", r6("mag") - F.col("bin") * 1e-9).alias("state"))


_CHORD = "CASE WHEN state = 24 THEN 'N' ELSE list_extract(['A','A#','B','C','C#','D','D#','E','F','F#','G','G#'], (state % 12 + 1)::INTEGER) || CASE WHEN state < 12 THEN ':maj' ELSE ':min' END END"


@query(
    "chord_segments",
    _CLASS.format(m=25) + ", ch AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY track ORDER BY frame) THEN 0 ELSE 1 END AS c FROM cl), sg AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY frame) AS g FROM ch) "
    f'SELECT track, {s6("min(frame) / 10.0")} AS "start", {s6("(max(frame) + 1) / 10.0")} AS "end", any_value({_CHORD}) AS label FROM sg GROUP BY track, g',
)
def _(spark, sf):
    return labels.chord_segments(_classes(spark, sf), 10.0).select("track", r6("start").alias("start"), r6("end").alias("end"), "label")


@query("key_label", f"WITH {SPECTROGRAM}, kp AS (SELECT track, bin % 24 AS state, row_number() OVER (PARTITION BY track ORDER BY {s6('avg(mag)')} DESC, bin % 24) AS r FROM spec GROUP BY 1, 2) SELECT track, list_extract([{', '.join(repr(k) for k in labels.KEYS)}], (state + 1)::INTEGER) AS label FROM kp WHERE r = 1")
def _(spark, sf):
    scores = spec_view(spark, sf).groupBy("track", (F.col("bin") % 24).alias("state")).agg(r6(F.avg("mag")).alias("p"))
    return labels.key_labels(scores)
