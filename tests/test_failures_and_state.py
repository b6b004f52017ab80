"""Recordings that fail without ending the job, and recurrent networks whose state goes on."""

import numpy as np
import pytest

from cantus.operators import nn
from cantus.operators.series import failures_kept, map_series
from cantus.plans import analysis
from cantus.sources import wav
from cantus.streaming import stateful


def test_a_broken_file_leaves_the_others(spark, tmp_path, monkeypatch):
    tone = (np.sin(np.arange(44100) * 0.1) * 20000 * (np.arange(44100) % 11025 < 3000)).astype("<i2")
    for name in ("a", "c"):
        (tmp_path / f"{name}.wav").write_bytes(wav.build_wav(44100, tone))
    (tmp_path / "b.wav").write_bytes(b"RIFF" + bytes(4) + b"WAVEnonsense")
    with pytest.raises(Exception, match="without data"):
        wav.read_wav(spark, str(tmp_path)).count()
    for direct in (wav.DIRECT, ()):
        monkeypatch.setattr(wav, "DIRECT", direct)
        tables, failures = analysis.analyze_files(spark, str(tmp_path), ("onsets",))
        (failed,) = failures.collect()
        assert failed.track.endswith("b.wav") and failed.step == "read_wav" and failed.error == "ValueError: a WAV file without data"
        assert sorted({r.track[-5:] for r in tables["onsets"].collect()}) == ["a.wav", "c.wav"]


def test_a_failing_kernel_is_listed_by_recording(spark, tmp_path):
    tone = (np.sin(np.arange(22050) * 0.1) * 20000).astype("<i2")
    noise = np.random.default_rng(1).integers(-30000, 30000, 22050).astype("<i2")
    for name, x in (("a", tone), ("loud", noise), ("c", tone)):
        (tmp_path / f"{name}.wav").write_bytes(wav.build_wav(44100, x))
    samples = analysis.mono(wav.read_wav(spark, str(tmp_path)), 44100)
    levels = {r.track[-8:]: np.mean(r.x) for r in analysis.branches(samples, 44100).filter("frame = 20").collect()}
    others, limit = [v for t, v in levels.items() if t != "loud.wav"], levels["loud.wav"] / 2
    assert max(others) < limit / 2

    def network(x):
        if x.mean() > limit:
            raise ArithmeticError("too loud")
        return x[:, :3]

    tables, failures = analysis.analyze_files(spark, str(tmp_path), ("downbeats", "mfcc"), networks={"downbeats": [network]})
    (failed,) = failures.collect()
    assert failed.track.endswith("loud.wav") and failed.error == "ArithmeticError: too loud" and "run" in failed.step
    assert {r.track[-5:] for r in tables["mfcc"].select("track").distinct().collect()} == {"a.wav", "c.wav"}


def test_kernels_fail_outside_the_block(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.0)], "track string, frame bigint, x double")

    def inverse(c):
        if not c["x"].all():
            raise ZeroDivisionError("zero")
        return {"y": 1 / c["x"]}

    with failures_kept() as kept:
        made = map_series(rows, ["x"], inverse, "y double")
    assert [tuple(r) for r in made.collect()] == [("a", 1.0)]
    assert [(r.track, r.error) for r in kept.table(spark).collect()] == [("b", "ZeroDivisionError: zero")]
    with pytest.raises(Exception, match="zero"):
        map_series(rows, ["x"], inverse, "y double").collect()


def layers(seed):
    rng = np.random.default_rng(seed)
    w = lambda *shape: rng.normal(size=shape) * 0.4
    lstm = nn.Lstm(tuple((w(3, 4), w(4), w(4, 4), w(4) if i != 2 else None) for i in range(4)), w(4), w(4))
    gru = nn.Gru((w(4, 2), w(2), w(2, 2)), (w(4, 2), w(2), w(2, 2)), (w(4, 2), w(2), w(2, 2)), w(2))
    return nn.Network((nn.Recurrent(w(3, 3), w(3), w(3, 3)), lstm, gru, np.tanh))


def test_parts_equal_the_whole():
    network, x = layers(1), np.random.default_rng(2).normal(size=(50, 3))
    whole, state, parts = network(x), network.start(), []
    for lo, hi in ((0, 1), (1, 20), (20, 20), (20, 50)):
        made, state = network.resume(x[lo:hi], state)
        parts.append(made.reshape(-1, 2))
    assert np.allclose(np.concatenate(parts), whole, atol=1e-12)


def test_layers_that_see_other_frames_cannot_go_on():
    one = layers(3).layers[0]
    for layer in (nn.Bidirectional(one, one), nn.Context(3)):
        with pytest.raises(ValueError):
            nn.Network((layer,)).resume(np.zeros((4, 3)), np.zeros(0))


def test_state_goes_on_from_batch_to_batch(spark, tmp_path):
    network, rng = layers(4), np.random.default_rng(5)
    clips = {t: rng.normal(size=(24, 3)) for t in ("a", "b")}
    provider = "spark.sql.streaming.stateStore.providerClass"
    schema = "track string, frame bigint, x array<double>"
    for batch in range(3):
        rows = [(t, f, x[f].tolist()) for t, x in clips.items() for f in range(8 * batch, 8 * batch + 8)]
        if batch == 2:
            rows.append(("a", 3, [9.0, 9.0, 9.0]))  # late: dropped
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        features = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = stateful.continued_network(features, network).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None and not query.isActive
    finally:
        spark.conf.unset(provider)
    got = {(r.track, r.frame): r.y for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 48
    for t, x in clips.items():
        assert np.allclose([got[t, f] for f in range(24)], network(x), atol=1e-12)
