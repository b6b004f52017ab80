"""Beats by successor tables against walking from every start, and local beats against their definition."""

import numpy as np
import pytest

from cantus.operators import beats, tempo
from cantus.operators.signal import hamming


def value(a, i):
    return a[i] if 0 <= i < len(a) else 0.0


def walked(a, interval, look_aside):
    """Every start of the first interval is walked by itself."""
    aside = max(1, int(interval * look_aside))
    taper = hamming(2 * aside)
    chains = []
    for at in range(min(interval, len(a))):
        chain = []
        while at < len(a):
            near = [value(a, at - aside + k) * taper[k] for k in range(2 * aside)]
            k = near.index(max(near))
            chain.append(at + k - aside if k else at)
            at = chain[-1] + interval
        chains.append(chain)
    return max(chains, key=lambda c: round(sum(a[i] for i in c), 9)) if chains else []


@pytest.mark.parametrize("seed", range(200))
def test_successors_equal_walking(seed):
    rng = np.random.default_rng(seed)
    n, interval = int(rng.integers(1, 400)), int(rng.integers(1, 60))
    a = rng.random(n) ** 3 * (rng.random(n) < 0.4)
    aside = (0.1, 0.2, 0.5)[seed % 3]
    assert beats.follow_beats(a, interval, aside).tolist() == walked(a, interval, aside)


def test_long_curves():
    a = np.zeros(300_000)
    a[7::50] = 1.0
    assert beats.follow_beats(a, 50).tolist() == list(range(7, 300_000, 50))


def test_no_beats():
    assert beats.follow_beats(np.zeros(0), 5).tolist() == [] and beats.follow_beats(np.ones(4), 0).tolist() == []
    with pytest.raises(ValueError):
        beats.follow_beats(np.ones(9), 2, 3.0)


def looked_ahead(a, fps, ahead, look_aside, taus, alpha, hist_smooth):
    """The local tracker from its definition: scene around the expected place, its tempo, its beats, the nearest of them."""
    found, expected, earliest = [], 0, 0
    while expected < len(a):
        scene = np.asarray([value(a, expected - ahead + i) for i in range(2 * ahead)])
        interval = int(tempo.dominant(tempo.comb_bins(scene, taus, alpha), taus, hist_smooth))
        places = [p + expected - ahead for p in walked(scene, interval, look_aside)]
        places = [p for p in places if p >= earliest]
        if not places:
            break
        beat = min(places, key=lambda p: (abs(p - expected), p))
        found.append(beat)
        expected, earliest = beat + interval, beat + int(taus[0])
    return [p / fps for p in found]


@pytest.mark.parametrize("seed", range(6))
def test_look_ahead_equals_its_definition(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.random(420) * 0.2
    at = 4.0
    while at < 420:  # a tempo that drifts
        a[int(at)] += 0.8
        at += 8 + 4 * at / 420 + rng.normal() * 0.3
    acts = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(a)], "track string, frame bigint, a double")
    got = sorted(r.t for r in beats.beat_detection(acts, 10.0, look_ahead=4.0, min_bpm=40, max_bpm=120, act_smooth=0.0).collect())
    want = looked_ahead(a, 10.0, 40, 0.2, tempo.intervals(10.0, 40, 120), 0.79, 9)
    assert got == pytest.approx([t for t in want if t >= 0]) and len(got) > 30
