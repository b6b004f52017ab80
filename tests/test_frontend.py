"""Front-ends of several resolutions against one resolution at a time, and their gradients against finite differences."""

import math

import numpy as np
import pytest

from cantus.operators import filterbanks, frames, frontend, nn, onsets, sequence
from cantus.operators import spectrogram as sg
from cantus.plans import analysis


def signals(seed, lengths):
    rng = np.random.default_rng(seed)
    return {f"t{i}": rng.normal(size=n) * 0.3 + np.sin(np.arange(n) * 0.05 * (i + 1)) for i, n in enumerate(lengths)}


def table(spark, tracks):
    return spark.createDataFrame([(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track string, n bigint, x double").repartition(3)


def rows_of(df):
    return {(r.track, r.frame): np.asarray(r.x) for r in df.collect()}


@pytest.mark.parametrize("run", [256, 7])
def test_branches_equal_single_resolutions(spark, monkeypatch, run):
    rate, fps, plan = 8000, 50.0, ((256, 3), (512, 6), (1024, 12))
    samples = table(spark, signals(1, (8000, 400, 90, 1)))
    want = {}
    for size, per_octave in plan:
        spec = analysis.log_filtered(samples, rate, size, fps, per_octave, fmax=3900.0, mul=5.0)
        both = sg.stack_difference(spec, 10_000, sg.diff_frames(0.5, rate / fps, size))
        for key, x in rows_of(analysis.arrays_of(both)).items():
            want.setdefault(key, []).append(x)
    monkeypatch.setattr(frames, "RUN", run)
    monkeypatch.setattr(frontend, "RUN", run)
    made = frontend.front_end(samples, rate, frontend.log_branches(spark, rate, plan, fps, 0.5, fmax=3900.0), fps, 5.0)
    got = rows_of(made)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], np.concatenate(v), atol=1e-9) for k, v in want.items())
    plan_text = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan_text.count("Exchange hashpartitioning") == 1 and "Join" not in plan_text


def test_mel_branches_lie_side_by_side(spark):
    rate, fps, sizes = 16000, 50.0, (512, 256)
    samples = table(spark, signals(2, (3000,)))
    each = []
    for size in sizes:
        bank = filterbanks.mel_filterbank(spark, size // 2, rate, 20, 100.0, 7000.0)
        each.append(rows_of(analysis.arrays_of(sg.log_compress(sg.apply_filterbank(analysis.spectrogram(samples, rate, size, fps), bank), 1.0, onsets.EPSILON, math.e))))
    got = rows_of(frontend.front_end(samples, rate, frontend.mel_branches(spark, rate, sizes, 20, 100.0, 7000.0), fps, 1.0, onsets.EPSILON, math.e, interleaved=True))
    assert all(np.allclose(got[k], np.stack([e[k] for e in each], 1).ravel(), atol=1e-9) for k in each[0]) and len(got) == len(each[0])


@pytest.mark.parametrize("run", [256, 5])
def test_gradient_equals_finite_differences(spark, monkeypatch, run):
    monkeypatch.setattr(frames, "RUN", run)
    monkeypatch.setattr(frontend, "RUN", run)
    rate, fps = 2000, 20.0
    tracks = signals(3, (900, 333, 128, 40))
    made = frontend.log_branches(spark, rate, ((128, 3), (256, 6)), fps, 0.5, 30.0, 900.0)
    rng = np.random.default_rng(4)

    def results(x):
        return rows_of(frontend.front_end(table(spark, x), rate, made, fps, 2.0))

    base = results(tracks)
    weights = {k: rng.normal(size=len(v)) for k, v in base.items() if k != ("t0", 3)}  # one frame without a gradient
    upstream = spark.createDataFrame([(t, f, w.tolist()) for (t, f), w in weights.items()], "track string, frame bigint, g array<double>")
    got = {(r.track, r.n): r.g for r in frontend.front_end_gradient(table(spark, tracks), upstream, rate, made, fps, 2.0).collect()}
    assert set(got) == {(t, i) for t, x in tracks.items() for i in range(len(x))}
    total = lambda made_: sum(float(w @ made_[k]) for k, w in weights.items())
    step = 1e-6
    for _ in range(2):
        direction = {t: rng.normal(size=len(x)) for t, x in tracks.items()}
        up, down = (total(results({t: x + s * step * direction[t] for t, x in tracks.items()})) for s in (1, -1))
        want = (up - down) / (2 * step)
        mine = sum(got[t, i] * d for t, v in direction.items() for i, d in enumerate(v))
        assert abs(mine - want) < 1e-6 * max(1.0, abs(want))


def test_features_of_beat_and_note_networks(spark):
    samples = table(spark, {"a": np.sin(np.arange(22050) * 0.1)})
    assert {len(x) for x in rows_of(analysis.beat_features(samples, 44100, online=True)).values()} == {2 * len(frontend.log_branches(spark, 44100, ((2048, 12),), 100.0)[0].bank.T)}
    widths = [b.bank.shape[1] for b in frontend.log_branches(spark, 44100, ((1024, 12), (2048, 12), (4096, 12)), 100.0)]
    assert {len(x) for x in rows_of(analysis.note_features(samples, 44100)).values()} == {2 * sum(widths)}


def test_recurrent_notes_and_chords_of_learned_features(spark):
    """Whole tasks with small networks: what they give is what their networks and models say it must be."""
    x = np.zeros(44100)
    x[22050:] = np.sin(np.arange(22050) * 2 * np.pi * 440 / 44100)
    samples = table(spark, {"a": x})
    loud = lambda v: np.stack([np.clip((v.sum(1) - 60) / 100, 0, 1), np.zeros(len(v))], 1)
    with analysis.Analyzer(samples, 44100, networks={"recurrent_notes": [loud]}) as a:
        notes = a.notes().collect()
        features = rows_of(analysis.note_features(samples, 44100))
    activation = [loud(features["a", f][None])[0, 0] for f in range(len(features))]
    assert notes and {r.pitch for r in notes} == {21}
    assert abs(notes[0].t - int(np.argmax(np.asarray(activation) >= 0.35)) / 100) <= 0.15

    def network(v):  # (frames, bins) to (frames less 22, bins, features): the louder half of the bins
        level = v.mean(1)[11:-11, None, None]
        return np.concatenate([np.repeat(level > 0.01, v.shape[1], 1), np.repeat(level <= 0.01, v.shape[1], 1)], 2).astype(float)

    model = sequence.ConditionalRandomField(np.zeros(25), np.zeros(25), np.zeros(25), np.zeros((25, 25)), np.zeros((2, 25)))
    model.observation[0, 0], model.observation[1, 24] = 10.0, 10.0
    with analysis.Analyzer(samples, 44100, networks={"chords": [network]}, crf=model) as a:
        chords = a.chords().orderBy("start").collect()
    assert [r.label for r in chords] == ["N", "A:maj"] and abs(chords[1].start - 0.5) <= 0.45
    assert isinstance(nn.Means(3), nn.Means)


@pytest.mark.parametrize("bar", [3, 4])
def test_downbeats_of_a_clear_meter(spark, bar):
    """Six seconds of a network that hears beats and downbeats plainly: times and numbers are exactly those."""
    samples = table(spark, {"a": np.zeros(6 * 44100)})

    def network(v):
        beat = np.arange(len(v)) % 25 == 10
        down = beat & (np.arange(len(v)) // 25 % bar == 1)
        return np.stack([np.full(len(v), 0.02), np.where(beat & ~down, 0.9, 0.02), np.where(down, 0.9, 0.02)], 1)

    with analysis.Analyzer(samples, 44100, networks={"downbeats": [network]}, fps=50.0) as a:
        got = sorted(map(tuple, a.downbeats().select("t", "beat").collect()))
    assert got == [(pytest.approx(0.2 + 0.5 * k), (k - 1) % bar + 1) for k in range(12)]
