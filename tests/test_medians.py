"""Running medians by a selection network against sorting every neighbourhood."""

import numpy as np
import pytest

from cantus.operators import spectrogram as sg


@pytest.mark.parametrize("count", [1, 3, 5, 9, 15, 31])
def test_selection_network(count):
    x = np.random.default_rng(count).integers(0, 6, (count, 400)).astype(float)
    assert np.array_equal(sg.selected_median(list(x)), np.median(x, 0))


@pytest.mark.parametrize("size, axis", [(5, 0), (4, 1), (15, 0), (1, 1), (9, 1)])
def test_running_medians(size, axis):
    x = np.random.default_rng(size).random((12, 7))
    reach = size // 2
    wide = np.pad(x, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
    want = np.median(np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis), -1)
    assert np.array_equal(sg.running_median(x, size, axis), want)


@pytest.mark.parametrize("run", [256, 6])
def test_medians_of_recordings(spark, monkeypatch, run):
    monkeypatch.setattr(sg, "RUN", run)
    rng = np.random.default_rng(run)
    specs = {"a": rng.random((40, 5)), "b": rng.random((6, 5)), "c": rng.random((2, 3)), "d": rng.random((13, 1))}
    rows = [(t, f, b, float(v)) for t, x in specs.items() for f, line in enumerate(x) for b, v in enumerate(line)]
    spec = spark.createDataFrame(rows, "track string, frame bigint, bin bigint, mag double").repartition(3)
    got = {(r.track, r.frame, r.bin): r for r in sg.hpss(spec, 2.0, 9, 3).collect()}
    assert len(got) == len(rows)
    for t, x in specs.items():
        h, p = sg.running_median(x, 9, 0), sg.running_median(x, 3, 1)
        for (f, b), v in np.ndenumerate(x):
            r = got[t, f, b]
            assert (r.h, r.p) == (h[f, b], p[f, b])
            assert abs(r.harmonic - v * h[f, b] ** 2 / (h[f, b] ** 2 + p[f, b] ** 2)) < 1e-12
    alone = {(r.track, r.frame, r.bin): r.m for r in sg.median_filter(spec, 3, "bin", "m").collect()}
    assert all(alone[k] == r.p for k, r in got.items())


def test_incomplete_spectra_are_an_error(spark):
    spec = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 1.0), ("a", 1, 0, 1.0)], "track string, frame bigint, bin bigint, mag double")
    with pytest.raises(Exception, match="whole spectra"):
        sg.hpss(spec).collect()
