"""Sources, streaming, the analyzer and the registered queries."""

import hashlib

import numpy as np
import pytest

from cantus.operators import frames, labels, nn, onsets, sequence, spectra
from cantus.plans import analysis, catalog
from cantus.sources import models, wav
from cantus.streaming import stateful


def tone(seconds, rate=8000, hz=440.0):
    t = np.arange(int(seconds * rate)) / rate
    return np.sin(2 * np.pi * hz * t) * (np.floor(t * 2) % 2 == 0)


@pytest.mark.parametrize("kind", ["<i2", "<i4", "<f4", "<f8"])
def test_wav_round_trip(spark, tmp_path, kind):
    full = np.iinfo(kind).max if kind[1] == "i" else 1
    stereo = np.column_stack((tone(0.1), -tone(0.1))) * full * 0.5
    (tmp_path / "a.wav").write_bytes(wav.build_wav(8000, stereo.astype(kind)))
    rows = wav.read_wav(spark, str(tmp_path)).orderBy("n", "ch").collect()
    assert len(rows) == 1600 and rows[0].sample_rate == 8000
    assert np.allclose([r.x for r in rows], stereo.ravel() / full, atol=1e-4)
    part = wav.read_wav(spark, str(tmp_path), start=0.05, stop=0.06)
    assert part.count() == 160
    with pytest.raises(Exception, match="rate"):
        wav.read_wav(spark, str(tmp_path), sample_rate=44100).count()


def test_a_large_file_is_read_in_ranges(spark, tmp_path, monkeypatch):
    """Three gigabytes with a hole in the middle: only what is asked for is read, wherever it lies."""
    rate, frames = 48000, 800_000_000
    head = wav.build_wav(rate, np.zeros((0, 2), "<i2"))
    tail = (np.arange(20000) % 7).astype("<i2")
    large = bytearray(head)
    large[-4:] = (4 * frames).to_bytes(4, "little")
    with open(tmp_path / "large.wav", "wb") as file:
        file.write(large)
        file.truncate(len(head) + 4 * frames)
        file.seek(len(head) + 4 * (frames - 10000))
        file.write(tail.tobytes())
    got = wav.read_chunks(spark, str(tmp_path), start=(frames - 10500) / rate, scale=False)
    samples = np.concatenate([r.samples for r in got.orderBy("first").collect()])
    assert np.array_equal(samples, np.concatenate((np.zeros(1000), tail)))
    monkeypatch.setattr(wav, "RANGE_BYTES", 1 << 30)
    assert wav.read_chunks(spark, str(tmp_path)).rdd.getNumPartitions() >= 4 * frames // wav.TASK_BYTES


def test_ranges_equal_whole_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wav, "CHUNK", 37)
    rng = np.random.default_rng(3)
    for i, kind in enumerate(("i2", "f4", "u1", "i4", "f8")):
        (tmp_path / f"{i}.wav").write_bytes(wav.build_wav(1000, (rng.random((900 + i, 1 + i % 2)) * 100).astype(kind)))
    wide = wav.build_wav(1000, np.zeros(0, "<i2"))[:20] + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + (1000).to_bytes(4, "little") + (3000).to_bytes(4, "little") + (3).to_bytes(2, "little") + (24).to_bytes(2, "little")
    body = rng.integers(0, 256, 3 * 400, np.uint8).tobytes()
    (tmp_path / "deep.wav").write_bytes(wide + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + b"data" + len(body).to_bytes(4, "little") + body)
    for start, stop in ((None, None), (0.1, 0.35), (0.85, 9.0), (2.0, None)):
        read = lambda: sorted((r.track, r.n, r.ch, r.x, r.sample_rate) for r in wav.read_wav(spark, str(tmp_path), start, stop).collect())
        ranged = read()
        with monkeypatch.context() as whole:
            whole.setattr(wav, "DIRECT", ())
            assert read() == ranged
    assert ranged == []


def test_very_large_headers():
    import io

    def header(data_length, ds64=b""):
        form = b"fmt " + (16).to_bytes(4, "little") + bytes([1, 0, 1, 0]) + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + bytes([2, 0, 16, 0])
        return (b"RF64" if ds64 else b"RIFF") + b"\xff" * 4 + b"WAVE" + ds64 + form + b"data" + data_length.to_bytes(4, "little")

    size = 10 << 32
    ds64 = b"ds64" + (28).to_bytes(4, "little") + size.to_bytes(8, "little") + (9 << 32).to_bytes(8, "little") + bytes(12)
    assert wav.read_header(io.BytesIO(header(0xFFFFFFFF, ds64)), size)[4:] == (len(header(0, ds64)), 9 << 32)
    assert wav.read_header(io.BytesIO(header(0xFFFFFFFF)), size)[5] == size - len(header(0))
    assert wav.read_header(io.BytesIO(header(100)), len(header(0)) + 40)[5] == 40


def test_wav_errors():
    with pytest.raises(ValueError):
        wav.parse_wav(b"nothing")
    rate, wide = wav.parse_wav(b"RIFF" + bytes(4) + b"WAVEfmt " + (16).to_bytes(4, "little") + bytes([1, 0, 1, 0, 64, 31, 0, 0, 192, 93, 0, 0, 3, 0, 24, 0]) + b"data" + (6).to_bytes(4, "little") + bytes([0, 0, 64, 0, 0, 192]))
    assert rate == 8000 and wide.ravel().tolist() == [1 << 30, -(1 << 30)]


REGISTRY = """
base_url = "https://models.example.org"
[schema]
version = 1
[models.beats]
license = "none"
files = [{{path = "beats/a.npz", sha256 = "{a}"}}, {{path = "beats/b.npz", sha256 = "{b}"}}]
[models.key]
files = [{{path = "key/k.npz", sha256 = "{a}"}}]
"""


def test_registry(spark, tmp_path):
    (tmp_path / "beats").mkdir()
    for name in "ab":
        np.savez(tmp_path / "beats" / f"{name}.npz", w=np.arange(3.0))
    digest = hashlib.sha256((tmp_path / "beats/a.npz").read_bytes()).hexdigest()
    catalogue = models.checkpoint_catalog(spark, REGISTRY.format(a=digest, b="0" * 64))
    info = {r.family: r for r in models.cache_info(catalogue, models.file_digests(spark, str(tmp_path))).collect()}
    assert (info["beats"].files, info["beats"].exist, info["beats"].verified, info["beats"].complete) == (2, 2, 1, False)
    assert (info["key"].exist, info["key"].complete) == (0, False)
    assert models.load_weights(spark, str(tmp_path / "beats/a.npz"), digest)["w"].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        models.load_weights(spark, str(tmp_path / "beats/a.npz"), "0" * 64)
    with pytest.raises(KeyError):
        models.family(catalogue, "drums")
    for bad in (REGISTRY.replace("version = 1", "version = 2"), REGISTRY.replace("https", "http"), REGISTRY.replace("key/k", "../k")):
        with pytest.raises(ValueError):
            models.parse_registry(bad.format(a=digest, b=digest))
    with pytest.raises(ValueError):
        models.parse_registry(REGISTRY.format(a="xyz", b=digest))


def stream_of(spark, tmp_path, rows, schema, batches=2):
    source, n = tmp_path / "in", -(-len(rows) // batches)
    for b in range(batches):
        spark.createDataFrame(rows[b * n : (b + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))


def drain(df, spark, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_streaming_difference(spark, tmp_path):
    rows = [(0, f, [float(f * f), 1.0]) for f in range(6)]
    got = drain(stateful.difference(stream_of(spark, tmp_path, rows, "track int, frame bigint, x array<double>"), 2), spark, tmp_path, "diffs")
    diffs = {r.frame: r["diff"] for r in got.collect()}
    assert set(diffs) <= set(range(6)) and all(d == ([0.0, 0.0] if f == 0 else [2.0 * f - 1, 0.0]) or f == min(diffs) for f, d in diffs.items())


def test_streaming_filter_equals_the_batch_form(spark, tmp_path):
    rng = np.random.default_rng(3)
    model, emit = sequence.Transitions.of([0, 0, 1, 1], [0, 1, 0, 1], [0.9, 0.1, 0.25, 0.75]), [[0.9, 0.1], [0.2, 0.8]]
    rows = [(0, f, int(rng.integers(0, 2))) for f in range(12)]
    schema = "track int, frame bigint, symbol int"
    got = drain(stateful.hmm_filter(stream_of(spark, tmp_path, rows, schema, 3), model, emit), spark, tmp_path, "filtered").collect()
    probs = {(r.frame, r.state): r.prob for r in sequence.forward_symbols(spark.createDataFrame(rows, schema), model, np.asarray(emit)).collect()}
    assert {r.frame: r.state for r in got} == {f: int(probs[f, 1] > probs[f, 0]) for f in range(12)}


def test_streaming_buffer_holds_the_last_values(spark, tmp_path):
    values = [(0, f, float(f)) for f in range(7)]
    kept = drain(stateful.ring_buffer(stream_of(spark, tmp_path, values, "track int, frame bigint, a double", 3), 4), spark, tmp_path, "kept").collect()
    assert {r.frame: r.window for r in kept} == {last: [float(max(0, last - 3 + k)) if last - 3 + k >= 0 else 0.0 for k in range(4)] for last in (2, 5, 6)}


def test_analyzer(spark):
    rate = 8000
    x = tone(2.0, rate)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track string, n bigint, x double")
    found = analysis.detect_onsets(rows, rate, fps=50.0, threshold=0.3)
    assert found.count() >= 1
    network = nn.Network((lambda v: v.mean(1, keepdims=True), nn.sigmoid))
    with analysis.Analyzer(rows, analysis.MODEL_RATE, {"beats": [network]}, fps=50.0) as analyzer:
        assert set(analyzer.analyze(("mfcc", "hpss"))) == {"mfcc", "hpss"}
        with pytest.raises(KeyError):
            analyzer.key()
        with pytest.raises(ValueError):
            analyzer.analyze(("nothing",))


@pytest.fixture(scope="module")
def recording(spark):
    """A second and a half at the models' rate: A4, silence, A4."""
    rows = [("a", i, float(v)) for i, v in enumerate(tone(1.5, analysis.MODEL_RATE))]
    return spark.createDataFrame(rows, "track string, n bigint, x double").repartition(2).persist()


@pytest.mark.parametrize("method", sorted(onsets.METHODS))
def test_onset_functions_of_samples(recording, method):
    acts = {r.frame: r.a for r in analysis.onset_activations(recording, analysis.MODEL_RATE, method, 50.0).collect()}
    assert sorted(acts) == list(range(75)) and all(np.isfinite(a) and a >= 0 for a in acts.values())
    if method not in ("phase_deviation", "normalized_weighted_phase_deviation", "high_frequency_content"):
        # apart from the beginning, the largest value is where the tone sets in again or ends
        assert min(abs(max((f for f in acts if f > 4), key=acts.get) - edge) for edge in (25, 50, 75)) <= 3


def test_every_task(recording):
    mean = nn.Network((lambda v: v.mean(1, keepdims=True), nn.sigmoid))
    pulses = lambda unit, units, period: nn.Network((lambda v: np.where((np.arange(len(v)) % period == 3)[:, None] & (np.arange(units) == unit), 0.9, 0.02),))
    level = lambda lo, hi: (lambda n: np.where((np.arange(n) >= lo) & (np.arange(n) < hi), 0.95, 0.02))
    played = nn.Network((lambda v: np.stack([level(20, 40)(len(v) - 10), level(20, 23)(len(v) - 10), level(40, 42)(len(v) - 10)], 1),))
    networks = {
        "beats": [pulses(0, 1, 25)] * 2, "downbeats": [pulses(1, 3, 25)], "key": [nn.Network((lambda v: np.eye(24)[[7]],))], "notes": [played],
        "chroma": [nn.Network((lambda v: np.tile(np.eye(12)[9], (len(v), 1)),))], "onsets": [nn.Network((lambda v: np.where(np.abs(np.arange(len(v) - 14) - 60) < 2, 0.9, 0.01)[:, None],))],
    }
    crf = sequence.ConditionalRandomField(np.zeros(25), np.zeros(25), np.zeros(25), np.eye(25), np.eye(12, 25) * 5)
    with analysis.Analyzer(recording, analysis.MODEL_RATE, networks, crf, fps=50.0) as analyzer:
        found = {task: [tuple(r)[1:] for r in df.collect()] for task, df in analyzer.analyze(analyzer.TASKS).items()}
        spec = {(r.frame, r.bin): r.mag for r in analysis.spectrogram(recording, analysis.MODEL_RATE, 2048, 50.0).collect()}
    # half a tenth of a second is two frames here, whose smoothing never reaches the threshold
    assert found["onsets"] == []
    with analysis.Analyzer(recording, analysis.MODEL_RATE, networks) as analyzer:
        assert [r.t for r in analyzer.onsets().collect()] == [0.6]
    assert np.allclose(np.diff(sorted(t for (t,) in found["beats"])), 0.5, atol=0.03)
    assert sorted(found["tempo"])[0][1] == pytest.approx(120, abs=4)
    assert sorted(found["downbeats"]) == [(0.06, 2), (0.56, 3), (1.06, 4)]
    assert found["key"] == [(labels.KEYS[7],)]
    assert [(round(p), on) for p, on, _ in found["notes"]] == [(21, pytest.approx(0.4, abs=0.03))]
    assert {(f, u) for f, u, x in found["chroma"] if x > 0.5} == {(f, 9) for f in range(15)}
    assert [c[-1] for c in found["chords"]] == ["F#:maj"]
    cepstra = {(f, b): x for f, b, x in found["mfcc"]}
    # the logarithm of silence is not finite
    assert len(cepstra) == 75 * 30 and all(np.isfinite(x) == (not 27 <= f <= 48) for (f, _), x in cepstra.items())
    parts = {}
    for frame, bin_, *values in found["hpss"]:
        parts[frame, bin_] = values
    assert set(parts) == set(spec) and all(any(abs(v - spec[k]) < 1e-9 for v in values) for k, values in parts.items())
    assert analysis.Analyzer(recording, analysis.MODEL_RATE).chroma().filter("x > 0").count() > 0
    assert analysis.network_activation(analysis.onset_features(recording, analysis.MODEL_RATE, online=True, fps=10.0), [mean]).count() == 15


def test_chord_features_average_three_frames_and_all_bins(recording):
    network = nn.Network((lambda v: np.stack([v[11:-11], 2 * v[11:-11]], -1),))
    got = analysis.chord_features(recording, analysis.MODEL_RATE, [network]).orderBy("frame").collect()
    spec = np.stack([r.x for r in analysis.arrays_of(analysis.log_filtered(recording, analysis.MODEL_RATE, 8192, 10.0, 24, 60.0, 2600.0)).orderBy("frame").collect()])
    want = [spec[i : i + 3].mean() for i in range(len(spec) - 2)]
    assert np.allclose([r.x for r in got], [(w, 2 * w) for w in want])


def test_frames_and_padding(spark):
    x = np.arange(1.0, 41.0)
    table = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track string, n bigint, x double")
    for size, hop, origin, pad in ((8, 3, 0, 0.0), (8, 2.5, "right", 7.0), (6, 4, "left", "repeat"), (10, 5, 0, "repeat")):
        got = frames.map_frames(table, size, lambda block: {"x": block}, "x array<double>", hop, origin=origin, pad=pad).orderBy("frame").collect()
        before = size // 2 + frames.origin_of(origin, size)
        at = lambda n: x[n] if 0 <= n < 40 else (x[0] if n < 0 else x[-1]) if pad == "repeat" else pad  # noqa: E731, B023
        assert [r.x for r in got] == [[at(int(f * hop) - before + k) for k in range(size)] for f in range(int(np.ceil(40 / hop)))]


def test_transform_of_many_runs(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=300)
    table = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track string, n bigint, x double")
    rows = lambda df: [(r.frame, np.asarray(r.re), np.asarray(r.im)) for r in df.orderBy("frame").collect()]
    want = rows(spectra.stft(frames.frame(table, 16, 5), 16, circular_shift=True, fft_size=32))
    monkeypatch.setattr(frames, "RUN", 4)
    got = rows(spectra.stft_of(table, 16, 5, circular_shift=True, fft_size=32))
    assert len(got) == len(want) == 60 and all(a == b and np.allclose(p, q) and np.allclose(s, t) for (a, p, s), (b, q, t) in zip(got, want))


def test_sections_equal_the_whole_recursion():
    bands = analysis.filterbanks.semitone_bands()[20:26]
    x = np.random.default_rng(2).normal(size=(6, 333))
    got = analysis.filterbanks.SectionFilters([b["sections"] for b in bands])(x)
    for band, row, y in zip(bands, x, got):
        b, a, want = np.asarray(band["b"]), np.asarray(band["a"]), []
        for i in range(len(row)):
            want.append((sum(b[k] * row[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * want[i - k] for k in range(1, len(a)) if i >= k)) / a[0])
        assert np.allclose(y, want, atol=1e-8)


def test_sections_of_an_odd_order():
    fb = analysis.filterbanks
    b, a, radius = fb.elliptic_sections(3, 1.0, 40.0, 0.2, 0.3)
    whole = fb.elliptic_bandpass(3, 1.0, 40.0, 0.2, 0.3)
    product = lambda rows: np.polymul(np.polymul(rows[0], rows[1]), rows[2])
    assert np.allclose(product(b), whole[0]) and np.allclose(product(a), whole[1]) and radius < 1


def test_semitone_energies_in_runs_equal_the_whole(spark):
    """Runs with halos against filtering all samples at once, where a recording is many runs and where it is one."""
    fb, fps, rate = analysis.filterbanks, 50.0, 4410
    bands = [b for b in fb.semitone_bands() if b["rate"] == rate][10:14]
    rng = np.random.default_rng(6)
    signals = {"long": rng.normal(size=30000), "short": rng.normal(size=200), "tiny": rng.normal(size=20), "one": np.ones(1)}
    rows = spark.createDataFrame([(t, i, float(v)) for t, x in signals.items() for i, v in enumerate(x)], "track string, n bigint, x double").repartition(3)
    got = {t: {} for t in signals}
    for r in analysis._band_energies(rows, bands, rate, fps, 40).collect():
        assert (r.frame, r.midi) not in got[r.track]
        got[r.track][r.frame, r.midi] = r.energy
    size, hop = int(round(2 * rate / fps)), rate / fps
    for track, x in signals.items():
        pad = min(len(x) - 1, 27)
        wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
        filters = fb.SectionFilters([b["sections"] for b in bands])
        y = filters(filters(np.tile(wide, (len(bands), 1)))[:, ::-1])[:, ::-1][:, pad : pad + len(x)]
        want = {}
        for f in range(int(np.ceil(len(x) / hop))):
            start = int(np.floor(f * hop)) - size // 2
            for k, band in enumerate(bands):
                want[f, band["midi"]] = (y[k, max(0, start) : max(0, start + size)] ** 2).sum() / rate * 22050
        assert set(want) == set(got[track])
        assert all(abs(got[track][k] - v) < 1e-9 * max(1, v) for k, v in want.items())


def test_bar_activations(spark):
    rate, x = 8000, tone(2.0, 8000)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track string, n bigint, x double")
    times = spark.createDataFrame([("a", 0.5 * k + 0.1) for k in range(4)], "track string, t double")
    network = nn.Network((lambda v: v.mean(1, keepdims=True), nn.sigmoid))
    quick = analysis.filterbanks.semitone_bands
    analysis.filterbanks.semitone_bands = lambda fmin, fmax: [b for b in quick(fmin, fmax) if 60 <= b["midi"] < 72 and b["rate"] == 4410]
    try:
        got = analysis.bar_activations(rows, rate, times, [network], [network]).orderBy("t").collect()
    finally:
        analysis.filterbanks.semitone_bands = quick
    assert len(got) == 4 and np.isnan(got[-1].a) and all(0 < r.a < 1 for r in got[:-1])


def test_composition(spark):
    chain = analysis.sequential(None, lambda d: d.filter("id > 2"), analysis.sequential(lambda d: d.limit(3)))
    assert chain(spark.range(10)).count() == 3
    assert [d.count() for d in analysis.parallel(lambda d: d, lambda d: d.limit(1))(spark.range(4))] == [4, 1]


@pytest.mark.parametrize("name", ["levels", "frame_fractional_hop", "stft_complex", "superflux_chain", "onset_times", "combine_mean", "hpss_soft", "hmm_forward", "crf_decode", "gmm_full", "bar_transitions", "sync_features", "chord_segments", "lstm"])
def test_query_equals_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    result = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    got = sorted(repr(tuple(r)) for r in catalog.queries()[name](spark, small).select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql_read_their_whole_tables(spark, small, monkeypatch):
    from cantus.plans import queries_nn, queries_sequence

    read = {}
    monkeypatch.setattr(queries_sequence.beats, "dbn_bars", lambda marked: read.setdefault("bars", marked))
    outputs = lambda features, networks: read.setdefault("rnn", features).selectExpr("track", "frame", "0L AS unit", "0D AS x")
    monkeypatch.setattr(queries_nn.nn, "run_networks", outputs)
    queries = __import__("cantus.plans.catalog", fromlist=["queries"]).queries()
    queries["dbn_bars"](spark, small), queries["bidirectional_rnn"](spark, small)
    blocks = {}
    for r in queries_sequence.act_view(spark, small).collect():
        blocks.setdefault((r.track, r.frame // 12 * 6.0), []).append(r.a)
    want = {k: min(max(sum(v) / len(v), 0.01), 0.99) for k, v in blocks.items()}
    assert {(r.track, r.t): r.a for r in read["bars"].collect()} == pytest.approx(want)
    row = read["rnn"].first()
    assert len(row.x) == 64
