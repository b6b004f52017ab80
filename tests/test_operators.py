"""Operators against literal examples and plain numpy forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantus.operators import beats, filterbanks, frames, labels, nn, onsets, sequence, signal, spectra, states, tempo
from cantus.operators import spectrogram as sg


def samples(spark, xs, kind="double"):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], f"track int, n bigint, x {kind}")


def series(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_downmix_cuts_toward_zero(spark):
    rows = [(0, n, ch, x) for n, pair in enumerate([(3, 4), (-3, -4)]) for ch, x in enumerate(pair)]
    got = signal.remix(spark.createDataFrame(rows, "track int, n bigint, ch int, x int"), 1)
    assert [r.x for r in got.orderBy("n").collect()] == [3, -3]


def test_gain_on_integers(spark):
    with pytest.raises(ValueError):
        signal.adjust_gain(samples(spark, [1], "int"), 3.0)
    assert signal.attenuate(samples(spark, [1.0]), 0).collect()[0].x == 1.0


def test_silence(spark):
    got = signal.levels(samples(spark, [0.0, 0.0])).collect()[0]
    assert (got.energy, got.rms, got.spl) == (0.0, 0.0, signal.LEAST)
    assert signal.trim(samples(spark, [0.0, 0.0])).count() == 0
    assert [r.n for r in signal.trim(samples(spark, [0.0, 1.0, 0.0, 2.0, 0.0]), "f").orderBy("n").collect()] == [1, 2, 3, 4]


def test_smoothing_equals_convolution(spark):
    x = np.arange(12.0) ** 1.5
    for kernel in (5, [1.0, 2.0, -1.0, 0.5]):
        taps = signal.hamming(kernel) if isinstance(kernel, int) else kernel
        got = [r.x for r in signal.smooth(samples(spark, x.tolist()), kernel).orderBy("n").collect()]
        assert np.allclose(got, np.convolve(x, taps, "same"))
    with pytest.raises(ValueError):
        signal.smooth(samples(spark, [1.0]), 1)


def test_frame_origins():
    assert frames.origin_of("left", 6) == 2 and frames.origin_of("right", 6) == -3
    with pytest.raises(ValueError):
        frames.hop_of(0, None, None)


def test_stft_of_a_sine(spark):
    x = np.sin(2 * np.pi * 8 * np.arange(256) / 64)
    spec = spectra.magnitude(spectra.bins_of(spectra.stft(frames.frame(samples(spark, x.tolist()), 64, 16), 64)))
    top = spec.filter("frame BETWEEN 4 AND 10").groupBy("frame").agg(F.max_by("bin", "mag").alias("bin")).collect()
    assert {r.bin for r in top} == {8}


def test_resampling_keeps_a_sine(spark):
    x = np.sin(2 * np.pi * np.arange(400) / 40)
    got = np.asarray([r.x for r in signal.resample(samples(spark, x.tolist()), 1, 2).orderBy("n").collect()])
    assert len(got) == 200 and np.allclose(got[30:170], x[::2][30:170], atol=0.01)


def test_semitone_filters_pass_their_tone():
    bands = filterbanks.semitone_bands()
    assert len(bands) == 88 and {b["rate"] for b in bands} == {882, 4410, 22050}
    for band in bands[::9]:
        z = np.exp(-2j * np.pi * band["center"] / band["rate"])
        gain = abs(np.polyval(band["b"][::-1], z) / np.polyval(band["a"][::-1], z))
        away = np.exp(-2j * np.pi * band["center"] * 1.12 / band["rate"])
        assert 0.85 < gain < 1.01
        assert abs(np.polyval(band["b"][::-1], away) / np.polyval(band["a"][::-1], away)) < 0.01


def test_log_filterbank_width(spark):
    assert filterbanks.log_filterbank(spark, 1024, 44100.0).select("band").distinct().count() == 81


def test_downbeat_feature_width(spark):
    widths = [filterbanks.log_filterbank(spark, s // 2, 44100.0, b).select("band").distinct().count() for s, b in ((1024, 3), (2048, 6), (4096, 12))]
    assert widths == [21, 45, 91]


def test_difference_lag():
    assert sg.diff_frames(0.5, 441.0, 2048) == 1
    assert sg.diff_frames(0.5, 100.0, 2048) == 5


def test_peak_picking_equals_plain_form(spark):
    rng = np.random.default_rng(5)
    a = np.round(rng.random(60), 3)
    acts = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(a)], "track int, frame bigint, a double")
    for threshold, before, after, back, ahead in ((0.55, 0, 0, 1, 1), (0.1, 4, 2, 2, 3), (0.0, 6, 0, 0, 5)):
        at = lambda i: a[i] if 0 <= i < len(a) else 0.0
        least = [threshold + (sum(at(i + d) for d in range(-before, after + 1)) / (before + after + 1) if before + after else 0) for i in range(len(a))]
        held = [v if v >= m else 0.0 for v, m in zip(a, least)]
        want = [i for i in range(len(a)) if held[i] > 0 and held[i] == max(held[max(0, i - back) : i + ahead + 1])]
        got = onsets.peak_picking(acts, threshold, None, before, after, back, ahead).orderBy("frame").collect()
        assert [r.frame for r in got] == want


def test_combining_events_equals_plain_form(spark):
    rng = np.random.default_rng(6)
    times = {k: sorted(set(np.round(rng.random(40) * 3, 3).tolist())) for k in range(3)}
    events = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "track int, t double")
    for how, merge in (("left", lambda x, t: x), ("right", lambda x, t: t), ("mean", lambda x, t: (x + t) / 2)):
        want = []
        for k, ts in times.items():
            kept = []
            for t in ts:
                if kept and t - kept[-1] <= 0.05 + 1e-12:
                    kept[-1] = merge(kept[-1], t)
                else:
                    kept.append(t)
            want += [(k, t) for t in kept]
        assert series(onsets.combine_events(events, 0.05, how), "track", "t") == want
    with pytest.raises(ValueError):
        onsets.combine_events(events, 0.03, "middle")


def test_unknown_onset_method(spark):
    with pytest.raises(ValueError):
        onsets.onset_function(spark.range(1), "nothing")


def test_comb_filters_equal_their_recursion(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=45)
    factor = float(np.float32(0.3))
    for tau in (1, 4, 7):
        ahead = [v + 0.3 * (x[i - tau] if i >= tau else 0) for i, v in enumerate(x)]
        back = []
        for i, v in enumerate(x):
            back.append(v + factor * (back[i - tau] if i >= tau else 0))
        assert [r.y for r in tempo.comb_forward(samples(spark, x.tolist()), tau, 0.3).orderBy("n").collect()] == pytest.approx(ahead)
        assert [r.y for r in tempo.comb_backward(samples(spark, x.tolist()), tau, 0.3).orderBy("n").collect()] == pytest.approx(back)
    taus, factors = list(range(1, 20)), [0.05 * t for t in range(1, 20)]
    for backward in (False, True):
        bank = tempo.comb_bank(samples(spark, x.tolist()), taus, factors, backward)
        assert bank.count() == 19 * 45
        single = tempo.comb_backward if backward else tempo.comb_forward
        for tau in (1, 17, 19):
            want = [r.y for r in single(samples(spark, x.tolist()), tau, factors[tau - 1]).orderBy("n").collect()]
            assert [r.y for r in bank.filter(F.col("tau") == tau).orderBy("n").collect()] == pytest.approx(want)
    for taus, alpha in (([0], 0.5), ([2, 3], [0.5])):
        with pytest.raises(ValueError):
            tempo.comb_bank(samples(spark, [1.0]), taus, alpha)


def histogram(spark, bins, taus):
    return spark.createDataFrame([(0, t, float(b)) for b, t in zip(bins, taus)], "track int, tau int, bin double")


def test_tempo_histograms_and_peaks(spark):
    rng = np.random.default_rng(8)
    taus, bins = np.arange(4, 26), np.round(rng.random(22), 4)
    table = histogram(spark, bins, taus.tolist())
    assert tempo.dominant_interval(table).collect()[0].tau == taus[np.argmax(bins)]
    n = len(bins)
    at = sorted((i for i in range(n) if bins[i] > bins[i - 1] and bins[i] > bins[(i + 1) % n]), key=lambda i: -bins[i])
    want = [(k + 1, 3000 / taus[i], bins[i] / sum(bins[j] for j in at)) for k, i in enumerate(at)]
    got = tempo.detect_tempo(table, 50.0).orderBy("rank").collect()
    assert [(r.rank, pytest.approx(r.bpm), pytest.approx(r.strength)) for r in got] == want
    flat = tempo.detect_tempo(histogram(spark, [2] * 6, range(3, 9)), 1.0).collect()[0]
    assert math.isnan(flat.bpm) and flat.strength == 0

    a = rng.random(70)
    acts = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(a)], "track int, frame bigint, a double")
    filtered = np.stack([tempo.resonated(a, t, 0.6) for t in (3, 5, 8)], 1)
    want = (filtered * (filtered == filtered.max(1, keepdims=True))).sum(0)
    assert [r.bin for r in tempo.comb_histogram(acts, [3, 5, 8], 0.6).orderBy("tau").collect()] == pytest.approx(want.tolist())


def test_interpolated_tempo(spark):
    x = np.array([2.0, 3.0, 5.0, 6.0, 7.0, 9.0])
    square = lambda v: 3 * v**2 - 4 * v + 1
    places, values = tempo.spline_between(x, square(x))
    assert np.allclose(values, square(places)) and len(places) == 700
    y = np.array([0.0, 1.0, 4.0, 3.5, 1.0, 0.5])
    places, values = tempo.spline_between(x, y)
    assert np.allclose(np.interp(x[:-1], places, values), y[:-1], atol=0.02)
    assert np.abs(np.diff(values, 2)).max() < 0.001  # no kinks
    got = tempo.detect_tempo(histogram(spark, [0, 1, 4, 3.5, 1, 0], [5, 6, 7, 8, 9, 10]), 10.0, interpolate=True).orderBy("rank").first()
    assert 600 / 8 < got.bpm < 600 / 7


def small_chain(rng, size=3, symbols=4):
    dense, emit = rng.random((size, size)) + 0.05, rng.random((size, symbols)) + 0.05
    dense, emit = dense / dense.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
    return dense, emit, sequence.Transitions.of(*np.indices((size, size)).reshape(2, -1), dense.ravel())


def test_viterbi_and_forward_equal_exhaustive_search(spark):
    import itertools

    rng = np.random.default_rng(9)
    dense, emit, model = small_chain(rng)
    seen = {k: rng.integers(0, 4, 6).tolist() for k in range(4)}
    obs = spark.createDataFrame([(k, i, int(s)) for k, v in seen.items() for i, s in enumerate(v)], "track int, frame bigint, symbol int")
    paths = sequence.decode_symbols(obs, model, emit).orderBy("track", "frame").collect()
    probs = sequence.forward_symbols(obs, model, emit).orderBy("track", "frame", "state").collect()
    densities = spark.createDataFrame([(k, i, np.log(emit[:, s]).tolist()) for k, v in seen.items() for i, s in enumerate(v)], "track int, frame bigint, densities array<double>")
    assert sequence.decode_densities(densities, model).orderBy("track", "frame").collect() == paths
    for k, v in seen.items():
        # the first move starts from any state alike
        score = lambda p: sum(math.log(emit[s, o]) for s, o in zip(p, v)) + sum(math.log(dense[a, b]) for a, b in zip(p, p[1:])) + math.log(dense[:, p[0]].max() / 3)  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=6), key=score)
        mine = [r for r in paths if r.track == k]
        assert tuple(r.state for r in mine) == best and mine[0].log_prob == pytest.approx(score(best))
        weight = np.zeros((6, 3))
        for n in range(1, 7):
            for p in itertools.product(range(3), repeat=n):
                start = dense[:, p[0]].sum() / 3
                weight[n - 1, p[-1]] += start * math.prod(emit[s, o] for s, o in zip(p, v)) * math.prod(dense[a, b] for a, b in zip(p, p[1:]))
        want = weight / weight.sum(1, keepdims=True)
        assert [r.prob for r in probs if r.track == k] == pytest.approx(want.ravel().tolist())


def test_dead_model_has_no_path():
    model = small_chain(np.random.default_rng(10), 2)[2]
    path, score = sequence.viterbi(model, np.full((3, 2), -np.inf), np.arange(2))
    assert len(path) == 0 and score == -math.inf
    with pytest.raises(ValueError):
        sequence.Transitions.of([0], [0], [0.5])


def test_crf_equals_exhaustive_search():
    import itertools

    rng = np.random.default_rng(11)
    for _ in range(20):
        initial, final, bias, moves, weights = (rng.normal(size=s) for s in ((3,), (3,), (3,), (3, 3), (2, 3)))
        x = rng.normal(size=(5, 2))
        local = x @ weights + bias
        score = lambda p: initial[p[0]] + final[p[-1]] + sum(local[t, s] for t, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=5), key=score)
        assert tuple(sequence.ConditionalRandomField(initial, final, bias, moves, weights).decode(x)) == best


def test_mixture_kinds_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 2))
    means, spread = rng.normal(size=(2, 2)), np.array([0.5, 2.0])
    kinds = {
        "spherical": spread,
        "diag": np.stack([np.full(2, s) for s in spread]),
        "full": np.stack([np.eye(2) * s for s in spread]),
    }
    scores = [states.log_density(x, sequence.Mixture(np.array([0.3, 0.7]), means, c, k)) for k, c in kinds.items()]
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    got = sequence.mixture_scores(rows, sequence.Mixture(np.array([0.3, 0.7]), means, kinds["full"], "full")).filter("component = 0").orderBy("i").collect()
    assert np.allclose([r.log_prob for r in got], scores[0])
    a = rng.normal(size=(3, 3))
    assert np.allclose(sequence.pseudo_inverse(a @ a.T), np.linalg.inv(a @ a.T))


def test_state_space_sizes():
    space = lambda n: states.bar_space(n, 60 * 100 / 215, 60 * 100 / 55, 60)
    assert (space(3).states, space(4).states) == (11157, 14876)


def test_bars_equal_exhaustive_search(spark):
    import itertools

    rng = np.random.default_rng(12)
    for _ in range(4):
        n = 8
        t, a = np.cumsum(0.3 + rng.random(n)), rng.random(n) * 0.96 + 0.02
        got = series(beats.dbn_bars(spark.createDataFrame([(0, float(x), float(y)) for x, y in zip(t, a)], "track int, t double, a double"), (2, 3), 4, 0.01), "t")

        def score(p):  # p: (meter, beat) per beat; a bar ends in another meter with probability 0.01
            total = 0.0
            for i, (meter, beat) in enumerate(p):
                total += math.log(a[i]) if beat == 1 else math.log((1 - a[i]) / 3)
                if i:
                    before = p[i - 1]
                    if beat == 1 and before[1] == before[0]:
                        total += math.log(0.99 if meter == before[0] else 0.01)
                    elif (meter, beat) != (before[0], before[1] + 1):
                        return -math.inf
                elif beat == 1:  # likeliest move into the first beat
                    total += math.log(0.99)
            return total

        places = [(m, b) for m in (2, 3) for b in range(1, m + 1)]
        # exhaustive over starts and meters of bars, which fix all places
        best, top = None, -math.inf
        for start in places:
            for meters in itertools.product((2, 3), repeat=n):
                p, bar = [start], iter(meters)
                while len(p) < n - 1:
                    p.append((p[-1][0], p[-1][1] + 1) if p[-1][1] < p[-1][0] else (next(bar), 1))
                if (value := score(p)) > top + 1e-12:
                    best, top = p, value
        last = best[-1]
        assert [r[2] for r in got] == [b for _, b in best] + [last[1] % last[0] + 1]
        assert [r[1] for r in got] == pytest.approx(t.tolist())


def pulse(spark, period, count, height=0.9):
    return spark.createDataFrame([(0, i, height if i % period == 0 else 0.01) for i in range(count)], "track int, frame bigint, a double")


def test_beats_of_pulses(spark):
    acts = pulse(spark, 50, 1000)
    for found in (beats.dbn_beats(acts, 100.0), beats.beat_detection(acts, 100.0), beats.crf_beats(acts, 100.0)):
        t = np.sort([r.t for r in found.collect()])
        inner = t[(t > 1) & (t < 9)]
        assert len(inner) >= 14 and np.allclose(np.diff(inner), 0.5, atol=0.05)


def test_tempo_of_pulses(spark):
    for method, period in (("comb", 50), ("acf", 50), ("dbn", 40)):
        got = tempo.estimate_tempo(pulse(spark, period, 1000), 100.0, 80.0, 170.0, method=method).orderBy("rank").first()
        assert got.bpm == pytest.approx(6000 / period, abs=1.5), (method, got)


def test_crf_sequences_equal_exhaustive_search():
    import itertools

    rng = np.random.default_rng(13)
    for _ in range(200):
        n, interval = int(rng.integers(6, 16)), int(rng.integers(3, 6))
        a, sigma = (rng.random(n) * 0.9 + 0.05).astype(np.float32), float(rng.uniform(0.1, 0.5))
        moves = beats.crf_transition(interval, sigma).astype(float)
        reach = [sum(moves[j] * a[i + j] for j in range(2 * interval) if i + j < n) for i in range(n)]
        log = lambda v: math.log(v) if v > 0 else -math.inf

        def score(p):
            total = sum(log(a[i]) for i in p) + sum(log(reach[i]) for i in p[:-1])
            total = total if reach[p[-1]] > 0 else -math.inf  # nor is a frame the last beat that nothing could follow
            for i, j in zip(p, p[1:]):
                # a move stays, or goes on by less than two intervals; none leaves the first frame
                total += log(moves[j - i]) if 0 <= j - i < 2 * interval and i > 0 else -math.inf
            return total

        count = n // interval
        top = max(score(p) for p in itertools.combinations_with_replacement(range(n), count) if p[0] < interval)
        path, got = beats.crf_sequence(a, interval, sigma)
        assert len(path) == count and got == pytest.approx(top, abs=1e-3)
        assert path[0] < interval and score(path.tolist()) == pytest.approx(top, abs=1e-3)
    assert len(beats.crf_sequence(a[:4], 5, 0.2)[0]) == 0


def test_downbeats_of_pulses(spark):
    rows = [(0, i, 0.9 if i % 50 == 0 and i % 150 else 0.01, 0.9 if i % 150 == 0 else 0.01) for i in range(1200)]
    got = series(beats.dbn_downbeats(spark.createDataFrame(rows, "track int, frame bigint, beat double, downbeat double"), 100.0), "t")
    assert [b for _, _, b in got[3:9]] in ([1, 2, 3] * 2, [2, 3, 1] * 2, [3, 1, 2] * 2)
    assert all(abs(t * 2 - round(t * 2)) < 0.03 for _, t, _ in got)


def test_thresholded_stretch(spark):
    a = [0.31, 0.12, 0.44, 0.07, 0.52, 0.4, 0.39]
    acts = spark.createDataFrame([(0, i, v) for i, v in enumerate(a)], "track int, frame bigint, a double")
    assert [r.frame for r in beats.threshold_activations(acts, 0.42).orderBy("frame").collect()] == [2, 3, 4]
    assert beats.threshold_activations(acts, 0.9).count() == 0
    assert beats.threshold_activations(acts.withColumn("a", F.when(F.col("frame") == 0, 1.0).otherwise(0.0)), 0.5).count() == 0


def test_notes_are_stretches_of_sounding_states(spark):
    rows, played = [], {12: (8, 22), 47: (15, 27)}
    for pitch in (12, 30, 47):
        lo, hi = played.get(pitch, (99, 99))
        for f in range(70):
            level = lambda a, b: 0.93 if a <= f < b else 0.015  # noqa: E731, B023
            rows.append((0, pitch, f, level(lo, hi), level(lo, lo + 3), level(hi, hi + 2)))
    acts = spark.createDataFrame(rows, "track int, pitch int, frame bigint, note double, onset double, offset double")
    got = series(beats.adsr_notes(acts), "onset")
    assert [r[1] for r in got] == [12 + 21, 47 + 21]
    for (lo, hi), (_, _, onset, duration) in zip(played.values(), got):
        assert onset == pytest.approx(lo / 50, abs=0.021) and duration == pytest.approx((hi - lo) / 50, abs=0.041)
    assert beats.adsr_notes(acts, note_threshold=0.95).count() == 0


def test_chords_are_runs_of_equal_states(spark):
    states_ = [3, 3, 15, 24, 24, 24, 7]
    got = series(labels.chord_segments(spark.createDataFrame([(0, i, s) for i, s in enumerate(states_)], "track int, frame bigint, state bigint"), 4.0), "start")
    assert [r[1:] for r in got] == [(0.0, 0.5, "C:maj"), (0.5, 0.75, "C:min"), (0.75, 1.5, "N"), (1.5, 1.75, "E:maj")]


def test_layers_equal_joins(spark):
    rng = np.random.default_rng(3)
    x, w, b = rng.normal(size=(5, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    rows = spark.createDataFrame([(0, f, u, float(x[f, u])) for f in range(5) for u in range(4)], "track int, frame bigint, unit bigint, x double")
    got = [r.x for r in nn.dense(rows, w, b).orderBy("frame", "unit").collect()]
    assert np.allclose(got, nn.Dense(w, b)(x).ravel())
    wide, bias = rng.normal(size=(4, nn.SUMS + 1)), rng.normal(size=nn.SUMS + 1)
    got = [r.x for r in nn.dense(rows, wide, bias).orderBy("frame", "unit").collect()]
    assert np.allclose(got, nn.Dense(wide, bias)(x).ravel())
    kernel = rng.normal(size=(2, 3))
    image = rows.withColumnRenamed("unit", "bin")
    got = [r.x for r in nn.convolve(image, kernel).orderBy("frame", "bin").collect()]
    assert np.allclose(got, nn.Conv(kernel[None, None], np.zeros(1))(x).ravel())
    assert nn.Conv(kernel[None, None], np.zeros(1), pad="same")(x).shape == (5, 4, 1)
    assert nn.MaxPool((2, 2))(x).shape == (2, 2)
    both = nn.Bidirectional(nn.Recurrent(w, b, np.eye(3) * 0.1), nn.Recurrent(w, b, np.eye(3) * 0.1))(x)
    assert np.allclose(both[-1, 3:], np.tanh(x[-1] @ w + b)) and np.allclose(both[0, :3], np.tanh(x[0] @ w + b))
    cell = nn.Gru((w, b, np.eye(3) * 0.2), (w, b, np.eye(3) * 0.3), (w, b, np.eye(3) * 0.1))
    rest = nn.Gru(cell.reset, cell.update, cell.cell, cell(x[:2])[-1])
    assert np.allclose(np.vstack((cell(x[:2]), rest(x[2:]))), cell(x))
    assert nn.Conv(kernel[None, None], np.zeros(1), stride=(2, 1))(x).shape == (2, 2, 1)
    assert np.allclose(nn.MaxPool(axis=1)(x), x.max(1)) and nn.Pad(2, (0, 1), None)(x)[0, 0] == x[0, 0]
    assert nn.Pad(1, (1,), 3.0)(x)[:, -1].tolist() == [3.0] * 5


def test_blocks_of_frames_equal_whole_clips(spark):
    rng = np.random.default_rng(8)
    clips = {t: rng.normal(size=(n, 4)) for t, n in enumerate((5, 6, 10, 11, 23))}
    rows = spark.createDataFrame([(t, f, x.tolist()) for t, clip in clips.items() for f, x in enumerate(clip)], "track int, frame bigint, x array<double>").cache()
    conv = lambda h, pad="valid": nn.Conv(rng.normal(size=(1, 1, h, 3)), np.ones(1), nn.relu, pad)
    dense = nn.Dense(rng.normal(size=(4, 3)), np.ones(3))
    stacks = {
        "frames alone": (nn.BatchNorm(0.0, 1.0, 0.1, 2.0), dense),
        "shrinking": (conv(3), nn.MaxPool((2, 1), (1, 1))),
        "same length": (conv(3, "same"), nn.Conv(rng.normal(size=(1, 2, 2, 1)), np.zeros(2), pad="same")),
        "edges repeated": (nn.Pad(2, (0,), None), conv(5)),
        "growing": (nn.Pad(4), conv(3), nn.Means(2)),
        "moved on": (nn.Pad(2, (0, 1)),),
        "context": (nn.Context(4), nn.Dense(rng.normal(size=(16, 2)), np.zeros(2))),
        "one axis": (conv(2), nn.MaxPool(axis=1)),
    }
    for name, layers in stacks.items():
        networks = [nn.Network(layers), nn.Network((*layers, np.abs))]
        network = nn.Network((nn.Network(layers), nn.BatchNorm(0.1, 2.0, 0.0, 1.0)))
        assert network.reach is not None and networks[1].reach is None, name
        got = {(r.track, r.frame, r.unit): r.x for r in nn.run_networks(rows, [networks[0], network], 5).collect()}
        want = {}
        for track, clip in clips.items():
            both = [np.asarray(n(clip)) for n in (networks[0], network)]
            for (f, u), x in np.ndenumerate((both[0] + both[1]).reshape(len(both[0]), -1) / 2):
                want[track, f, u] = x
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values())), name
    pooled = nn.Pooled(nn.Network(stacks["same length"]), nn.softmax)
    got = {(r.track, r.unit): r.x for r in nn.run_networks(rows, [pooled], 5).collect()}
    want = {(t, u): x for t, clip in clips.items() for u, x in enumerate(pooled(clip).ravel())}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_layers_without_a_reach():
    assert nn.Conv(np.ones((1, 1, 2, 2)), np.zeros(1), stride=(2, 1)).reach is None
    assert nn.MaxPool((2, 2)).reach is None and nn.MaxPool(axis=0).reach is None and nn.MaxPool((1, 2)).reach == (0, 0)
    assert nn.Network((nn.Recurrent(np.ones((1, 1)), np.ones(1), np.ones((1, 1))),)).reach is None
