"""Split series: decoding and recurrences in blocks equal one pass over the whole series."""

import numpy as np
import pytest

from cantus.operators import beats, split_decode, tempo
from cantus.operators.sequence import Transitions, decode_densities, decode_symbols, viterbi


def model_of(rng, states_, keep=1.0):
    dense = rng.random((states_, states_)) * (rng.random((states_, states_)) < keep)
    dense[np.arange(states_), np.arange(states_)] += 0.1
    dense /= dense.sum(1, keepdims=True)
    i, j = np.nonzero(dense)
    return Transitions.of(i, j, dense[i, j])


def table(spark, lengths, rng, symbols=4, start=0):
    rows = [(f"t{t}", start + f, int(rng.integers(symbols))) for t, n in enumerate(lengths) for f in range(n)]
    return rows, spark.createDataFrame(rows, "track string, frame bigint, symbol int").repartition(3)


@pytest.mark.parametrize("states_, keep, block, run_up", [(3, 1.0, 50, None), (40, 0.2, 64, 30), (40, 0.2, 64, 1), (33, 1.0, 16, 16)])
def test_split_path_equals_the_whole_one(spark, states_, keep, block, run_up):
    rng = np.random.default_rng(states_ + block)
    model, seen = model_of(rng, states_, keep), rng.random((states_, 4))
    columns = np.log((seen / seen.sum(1, keepdims=True)).T)
    rows, frames = table(spark, (500, block, block + 1, 1, 2 * block), rng, start=7)
    got = split_decode.split_viterbi(frames, ["symbol"], lambda c: columns[c["symbol"]], model, block=block, run_up=run_up).collect()
    assert len(got) == len(rows)
    for track in {r[0] for r in rows}:
        symbols = np.asarray([s for t, _, s in rows if t == track])
        path, score = viterbi(model, columns[symbols], np.arange(states_))
        mine = sorted((r.frame, r.state, r.log_prob) for r in got if r.track == track)
        assert [m[1] for m in mine] == path.tolist() and mine[0][0] == 7
        assert abs(mine[0][2] - score) < 1e-6


def test_wrong_guesses_run_again(spark):
    """A model that never forgets: two closed loops of states, told apart by the last frame alone."""
    ring = 20
    src = np.concatenate([np.arange(ring), ring + np.arange(ring)])
    dst = np.concatenate([(np.arange(ring) + 1) % ring, ring + (np.arange(ring) + 1) % ring])
    model = Transitions.of(src, dst, np.ones(2 * ring))
    densities = np.zeros((200, 2 * ring))
    densities[-1] = -5.0
    densities[-1, ring + 3] = 0.0
    densities[3, :] = -1.0
    densities[3, 2] = 0.0
    rows = [("a", f, d.tolist()) for f, d in enumerate(densities)]
    got = decode_densities(spark.createDataFrame(rows, "track string, frame bigint, densities array<double>"), model, block=32).orderBy("frame").collect()
    path, score = viterbi(model, densities, np.arange(2 * ring))
    assert [r.state for r in got] == path.tolist() and abs(got[0].log_prob - score) < 1e-6


def test_ties_and_dead_models(spark):
    model = Transitions.of([0, 0, 1, 1], [0, 1, 0, 1], [0.5] * 4)
    rows = [("tie", f, 0) for f in range(30)] + [("dead", f, 1 if f == 17 else 0) for f in range(30)]
    frames = spark.createDataFrame(rows, "track string, frame bigint, symbol int")
    with np.errstate(divide="ignore"):
        columns = np.log(np.asarray([[1.0, 1.0], [0.0, 0.0]]))
    got = split_decode.split_viterbi(frames, ["symbol"], lambda c: columns[c["symbol"]], model, block=8).collect()
    assert {(r.track, r.state) for r in got} == {("tie", 0)} and len(got) == 30


def test_symbols_in_blocks(spark):
    rng = np.random.default_rng(2)
    model, seen = model_of(rng, 4), np.asarray([[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.25] * 4])
    _, frames = table(spark, (300,), rng)
    whole, split = (sorted(map(tuple, decode_symbols(frames, model, seen, initial=[0.4, 0.3, 0.2, 0.1], block=b).select("frame", "state").collect())) for b in (None, 37))
    assert whole == split


def test_blocks_are_tasks_of_their_own(spark):
    frames = spark.range(40000).selectExpr("'one' AS track", "id AS frame", "CAST(xxhash64(id) & 1 AS INT) AS symbol")
    model = Transitions.of([0, 0, 1, 1], [0, 1, 0, 1], [0.9, 0.1, 0.2, 0.8])
    columns = np.log([[0.6, 0.3], [0.4, 0.7]])
    got = split_decode.split_viterbi(frames, ["symbol"], lambda c: columns[c["symbol"]], model, block=2000)
    paths = got.orderBy("frame").collect()
    symbols = np.asarray([r.symbol for r in frames.orderBy("frame").collect()])
    path, _ = split_decode.viterbi_blocks(model, columns[symbols], np.arange(2), block=2000)
    assert [r.state for r in paths] == path.tolist() == viterbi(model, columns[symbols], np.arange(2))[0].tolist()


def pulses(rng, n, period, noise):
    a = np.clip(rng.random(n) * noise, 0, 1)
    a[::period] = 0.9
    return np.clip(a, 1e-3, 0.97)


def test_beats_of_split_tracks(spark):
    rng = np.random.default_rng(3)
    curves = {"a": pulses(rng, 900, 12, 0.3), "b": np.concatenate([pulses(rng, 500, 11, 0.2), pulses(rng, 500, 16, 0.5)]), "silent": np.zeros(200)}
    acts = spark.createDataFrame([(t, f, float(x)) for t, c in curves.items() for f, x in enumerate(c)], "track string, frame bigint, a double")
    args = dict(fps=20, min_bpm=60, max_bpm=180)
    for threshold in (0.0, 0.5):
        whole, split = (sorted(map(tuple, beats.dbn_beats(acts, threshold=threshold, block=b, **args).collect())) for b in (None, 128))
        assert whole == split and len({t for t, _ in whole}) == 2
    with pytest.raises(ValueError):
        beats.dbn_beats(acts, correct=False, block=128, **args)


def test_downbeats_of_split_tracks(spark):
    rng = np.random.default_rng(4)
    rows = []
    for track, (period, bar) in {"three": (10, 3), "four": (12, 4)}.items():
        beat, down = rng.random(720) * 0.1 + 0.01, rng.random(720) * 0.1 + 0.01
        beat[::period], down[:: period * bar] = 0.7, 0.8
        beat[:: period * bar] = 0.1
        rows += [(track, f, float(b), float(d)) for f, (b, d) in enumerate(zip(beat, down))]
    acts = spark.createDataFrame(rows, "track string, frame bigint, beat double, downbeat double")
    args = dict(fps=20, min_bpm=80, max_bpm=160, num_tempi=None)
    whole, split = (sorted(map(tuple, beats.dbn_downbeats(acts, block=b, **args).collect())) for b in (None, 200))
    assert whole == split
    assert {(t, max(n for u, _, n in whole if u == t)) for t, _, _ in whole} == {("three", 3), ("four", 4)}


@pytest.mark.parametrize("alpha", [0.79, [0.5, 1.0, -0.9]])
@pytest.mark.parametrize("block", [7, 64])
def test_comb_filters_of_split_tracks(spark, alpha, block):
    rng = np.random.default_rng(block)
    signals = {"a": rng.normal(size=500), "b": rng.normal(size=block), "c": rng.normal(size=3)}
    rows = [(t, i, float(v)) for t, x in signals.items() for i, v in enumerate(x)]
    frame, taus = spark.createDataFrame(rows, "track string, n bigint, x double").repartition(3), [1, 5, 12]
    got = {(r.track, r.n, r.tau): r.y for r in tempo.comb_bank(frame, taus, alpha, block=block).collect()}
    factors = [float(np.float32(f)) for f in (alpha if isinstance(alpha, list) else [alpha] * 3)]
    for t, x in signals.items():
        for tau, factor in zip(taus, factors):
            y = []
            for i, v in enumerate(x):
                y.append(v + (factor * y[i - tau] if i >= tau else 0))
            assert np.allclose([got[t, i, tau] for i in range(len(x))], y, atol=1e-9, rtol=1e-9)
    assert len(got) == 3 * len(rows)


def test_comb_filter_of_columns(spark):
    x = np.random.default_rng(8).normal(size=(300, 2))
    frame = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "track string, n bigint, x array<double>")
    got = np.asarray([r.y for r in tempo.comb_backward_columns(frame, 9, 0.6, 2, 50).orderBy("n").collect()])
    want = x.copy()
    for i in range(9, 300):
        want[i] += float(np.float32(0.6)) * want[i - 9]
    assert np.allclose(got, want, atol=1e-9)


def test_interpolated_tempo_estimation(spark):
    """A pulse every 20.5 frames: between the histogram's bins with interpolation, at a whole delay without."""
    a = np.zeros(2000)
    for k in range(95):
        at = 20.5 * k
        a[int(at)] += 1 - at % 1
        a[int(at) + 1] += at % 1
    acts = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(a)], "track string, frame bigint, a double")
    first = lambda **kw: tempo.estimate_tempo(acts, 100.0, 200.0, 400.0, "acf", None, 7, **kw).filter("rank = 1").first().bpm
    assert abs(6000 / first(interpolate=True) - 20.5) < 0.2
    assert 6000 / first() in (20.0, 21.0)
