"""Tasks on recordings: from sample tables to events.

Every task takes samples (track, n, x) at a known rate and gives a table of events. Networks are supplied by the
caller, as array functions; what several tasks need is computed once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import beats, filterbanks, frontend, labels, nn, onsets, sequence, spectra, tempo
from ..operators import spectrogram as sg
from ..operators.series import failures_kept, map_series
from ..operators.signal import resample
from ..session import checkpointed
from ..sources.wav import read_wav

Transform = Callable[[DataFrame], DataFrame]
MODEL_RATE = 44100


def sequential(*stages: Transform | None) -> Transform:
    """One transformation after the other; None passes its input on."""
    return lambda df: reduce(lambda d, f: d if f is None else d.transform(f), stages, df)


def parallel(*branches: Transform) -> Callable[[DataFrame], list[DataFrame]]:
    return lambda df: [df.transform(b) for b in branches]


def mono(samples: DataFrame, sample_rate: int, target: int = MODEL_RATE) -> DataFrame:
    """One channel at the target rate."""
    mixed = samples.groupBy("track", "n").agg(F.avg("x").alias("x")) if "ch" in samples.columns else samples.select("track", "n", "x")
    return mixed if sample_rate == target else resample(mixed, target, sample_rate)


def spectrogram(samples: DataFrame, sample_rate: float, size: int = 2048, fps: float = 100.0, origin: int | str = 0) -> DataFrame:
    """Magnitudes (track, frame, bin, mag)."""
    return spectra.magnitude(spectra.bins_of(spectra.stft_of(samples, size, fps=fps, sample_rate=sample_rate, origin=origin))).select("track", "frame", "bin", "mag")


def phases(samples: DataFrame, sample_rate: float, size: int = 2048, fps: float = 100.0) -> DataFrame:
    """Magnitudes and phases that refer to the frames' middles: (track, frame, bin, mag, phase)."""
    rows = spectra.bins_of(spectra.stft_of(samples, size, fps=fps, sample_rate=sample_rate, circular_shift=True))
    return spectra.phase(spectra.magnitude(rows)).select("track", "frame", "bin", "mag", "phase")


def log_filtered(samples: DataFrame, sample_rate: float, size: int, fps: float, per_octave: int, fmin: float = 30.0, fmax: float = 17000.0, mul: float = 1.0, add: float = 1.0, norm: bool = True) -> DataFrame:
    bank = filterbanks.log_filterbank(samples.sparkSession, size // 2, sample_rate, per_octave, fmin, fmax, norm=norm)
    return sg.log_compress(sg.apply_filterbank(spectrogram(samples, sample_rate, size, fps), bank), mul, add)


def branches(samples: DataFrame, sample_rate: float, plan: tuple[tuple[int, int], ...] = ((1024, 3), (2048, 6), (4096, 12)), fps: float = 100.0, diff_ratio: float = 0.5, mul: float = 1.0) -> DataFrame:
    """Stacked log spectra and their positive differences at several resolutions: (track, frame, x array)."""
    return frontend.front_end(samples, sample_rate, frontend.log_branches(samples.sparkSession, sample_rate, plan, fps, diff_ratio), fps, mul)


def mel_branches(samples: DataFrame, sample_rate: float, sizes: tuple[int, ...] = (2048, 1024, 4096), bands: int = 80, fps: float = 100.0) -> DataFrame:
    """Log mel energies at several resolutions side by side: (track, frame, x array)."""
    made = frontend.mel_branches(samples.sparkSession, sample_rate, sizes, bands, 27.5, 16000.0)
    return frontend.front_end(samples, sample_rate, made, fps, 1.0, onsets.EPSILON, math.e, interleaved=True)


def beat_features(samples: DataFrame, sample_rate: float, online: bool = False, fps: float = 100.0) -> DataFrame:
    """What the beat networks see: one resolution of twelve bands an octave where no later sample may be waited for."""
    return branches(samples, sample_rate, ((2048, 12),) if online else ((1024, 6), (2048, 6), (4096, 6)), fps)


def note_features(samples: DataFrame, sample_rate: float, fps: float = 100.0) -> DataFrame:
    """What the recurrent note network sees: three resolutions of twelve bands an octave."""
    return branches(samples, sample_rate, ((1024, 12), (2048, 12), (4096, 12)), fps, 0.5, 5.0)


#: Onset functions that look at phases, bin by bin of the unfiltered spectrum.
PHASED = ("phase_deviation", "weighted_phase_deviation", "normalized_weighted_phase_deviation", "complex_domain", "rectified_complex_domain")


def onset_activations(samples: DataFrame, sample_rate: float, method: str = "superflux", fps: float = 100.0) -> DataFrame:
    """A spectral onset function of samples: (track, frame, a)."""
    bank = filterbanks.log_filterbank(samples.sparkSession, 1024, sample_rate, 24, norm=False)
    if method in PHASED:
        return onsets.onset_function(phases(samples, sample_rate, 2048, fps), method)
    if method == "complex_flux":
        delays = spectra.local_group_delay(phases(samples, sample_rate, 2048, fps))
        spec = sg.log_compress(sg.apply_filterbank(delays, bank))
        return onsets.complex_flux(spec, delays=delays, filterbank=bank)
    return onsets.onset_function(sg.log_compress(sg.apply_filterbank(spectrogram(samples, sample_rate, 2048, fps), bank)), method)


def detect_onsets(samples: DataFrame, sample_rate: float, method: str = "superflux", fps: float = 100.0, threshold: float = 1.1, **picking: float) -> DataFrame:
    """Onsets without a network: a spectral function and its peaks."""
    spans = {"pre_max": 0.01, "post_max": 0.05, "pre_avg": 0.15, "post_avg": 0.0, "combine": 0.03} | picking
    return onsets.pick_onsets(onset_activations(samples, sample_rate, method, fps), fps, threshold, **spans)


def onset_features(samples: DataFrame, sample_rate: float, online: bool = False, fps: float = 100.0) -> DataFrame:
    """What the recurrent onset networks see: shorter frames where no later sample may be waited for."""
    sizes = (512, 1024, 2048) if online else (1024, 2048, 4096)
    return branches(samples, sample_rate, tuple((s, 6) for s in sizes), fps, 0.25, 5.0)


def arrays_of(spec: DataFrame) -> DataFrame:
    """Spectra as one array per frame: (track, frame, x)."""
    rows = spec.groupBy("track", "frame").agg(F.sort_array(F.collect_list(F.struct("bin", "mag"))).alias("s"))
    return rows.select("track", "frame", F.col("s.mag").alias("x"))


def widened(width: int, networks: list[nn.Layer], value: float | None = None) -> list[nn.Layer]:
    """Networks that shorten a clip by twice ``width``, on clips with so many more frames at both ends."""
    return [nn.Network((nn.Pad(width, (0,), value), n)) for n in networks]


def chord_features(samples: DataFrame, sample_rate: float, networks: list[nn.Layer]) -> DataFrame:
    """Features of convolutional chord networks: (track, frame, x array), means over three frames and all bins.

    A network maps (frames, bins) to (frames less 22, bins, features).
    """
    spec = arrays_of(log_filtered(samples, sample_rate, 8192, 10.0, 24, 60.0, 2600.0))
    made = nn.run_networks(spec, [nn.Network((n, nn.Means(3))) for n in widened(11, networks, 0.0)])
    rows = made.groupBy("track", "frame").agg(F.sort_array(F.collect_list(F.struct("unit", "x"))).alias("s"))
    return rows.select("track", "frame", F.col("s.x").alias("x"))


def network_activation(features: DataFrame, networks: list[nn.Layer], unit: int = 0, name: str = "a") -> DataFrame:
    return nn.run_networks(features, networks).filter(F.col("unit") == unit).select("track", "frame", F.col("x").alias(name))


class Analyzer:
    """Tasks over one table of samples. ``networks`` holds lists of array functions by task; activations are kept.

    ``online`` beat networks see features that wait for no later sample; of ``recurrent_notes`` there is a network that
    gives one onset activation per pitch.
    """

    TASKS = ("onsets", "beats", "downbeats", "tempo", "key", "chords", "notes", "chroma", "mfcc", "hpss")

    def __init__(self, samples: DataFrame, sample_rate: int, networks: dict[str, list[nn.Layer]] | None = None, crf: sequence.ConditionalRandomField | None = None, fps: float = 100.0, online: bool = False) -> None:
        self.samples, self.rate, self.networks, self.crf, self.fps = mono(samples, sample_rate), MODEL_RATE, networks or {}, crf, fps
        self.online, self._kept = online, {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make().persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[name]

    def _nets(self, task: str) -> list[nn.Layer]:
        if task not in self.networks:
            raise KeyError(f"{task} needs networks")
        return self.networks[task]

    def release(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def __enter__(self) -> Analyzer:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def activations(self) -> DataFrame:
        return self._once("beats", lambda: network_activation(beat_features(self.samples, self.rate, self.online, self.fps), self._nets("beats")))

    def onsets(self) -> DataFrame:
        if "onsets" not in self.networks:
            return detect_onsets(self.samples, self.rate, fps=self.fps)
        acts = network_activation(mel_branches(self.samples, self.rate, fps=self.fps), widened(7, self._nets("onsets")))
        return onsets.pick_onsets(acts, self.fps, 0.54, 0.05, pre_max=1 / self.fps, post_max=1 / self.fps)

    def beats(self) -> DataFrame:
        return beats.dbn_beats(self.activations(), self.fps)

    def tempo(self) -> DataFrame:
        return tempo.estimate_tempo(self.activations(), self.fps)

    def downbeats(self) -> DataFrame:
        made = self._once("downbeats", lambda: nn.run_networks(branches(self.samples, self.rate, fps=self.fps), self._nets("downbeats")))
        acts = made.groupBy("track", "frame").agg(F.max(F.when(F.col("unit") == 1, F.col("x"))).alias("beat"), F.max(F.when(F.col("unit") == 2, F.col("x"))).alias("downbeat"))
        return beats.dbn_downbeats(acts, self.fps)

    def chroma(self) -> DataFrame:
        """Network chroma if there is a network, else the pitch class profile."""
        if "chroma" not in self.networks:
            bank = filterbanks.pitch_class_filterbank(self.samples.sparkSession, 4096, self.rate)
            return sg.pitch_class_profile(spectrogram(self.samples, self.rate, 8192, 10.0), bank).select("track", "frame", F.col("bin").alias("unit"), F.col("mag").alias("x"))
        spec = arrays_of(log_filtered(self.samples, self.rate, 8192, 10.0, 24, 65.0, 2100.0))
        return self._once("chroma", lambda: nn.run_networks(spec, [nn.Network((nn.Context(15), n)) for n in self._nets("chroma")]))

    def chords(self) -> DataFrame:
        """From learned features if there are networks for them, else from chroma."""
        if self.crf is None:
            raise KeyError("chords need a conditional random field")
        if "chords" in self.networks:
            rows = chord_features(self.samples, self.rate, self._nets("chords"))
        else:
            rows = arrays_of(self.chroma().withColumnsRenamed({"unit": "bin", "x": "mag"}))
        return labels.chord_segments(sequence.crf_decode(rows, self.crf), 10.0)

    def key(self) -> DataFrame:
        scores = nn.run_networks(arrays_of(log_filtered(self.samples, self.rate, 8192, 5.0, 24, 65.0, 2100.0)), self._nets("key"))
        return labels.key_labels(scores.filter("frame = 0").select("track", F.col("unit").alias("state"), F.col("x").alias("p")))

    def notes(self) -> DataFrame:
        """Networks give note, onset and offset activations per pitch, three units in a row, for frames but five at each end."""
        if "recurrent_notes" in self.networks:
            return self.note_onsets()
        rows = arrays_of(log_filtered(self.samples, self.rate, 4096, 50.0, 24, 30.0, 10000.0))
        made = nn.run_networks(rows, widened(5, self._nets("notes")))
        kind = lambda i: F.max(F.when(F.col("unit") % 3 == i, F.col("x")))
        acts = made.groupBy("track", F.expr("unit div 3").alias("pitch"), "frame").agg(kind(0).alias("note"), kind(1).alias("onset"), kind(2).alias("offset"))
        return beats.adsr_notes(acts)

    def note_onsets(self, threshold: float = 0.35, combine: float = 0.05, pitch_offset: int = 21) -> DataFrame:
        """(track, pitch, t) by the recurrent network: peaks of each pitch's activation."""
        made = nn.run_networks(note_features(self.samples, self.rate, self.fps), self._nets("recurrent_notes"))
        acts = made.select("track", (F.col("unit") + pitch_offset).alias("pitch"), "frame", F.col("x").alias("a"))
        return labels.note_onsets(acts, self.fps, threshold, pre_max=1 / self.fps, post_max=1 / self.fps, combine=combine)

    def mfcc(self, bands: int = 30) -> DataFrame:
        spec = self._once("spectrogram", lambda: spectrogram(self.samples, self.rate, 2048, self.fps))
        return sg.mfcc(spec, filterbanks.mel_filterbank(spec.sparkSession, 1024, self.rate, bands, 40.0, 15000.0), bands)

    def hpss(self, masking: str | float = "binary") -> DataFrame:
        spec = self._once("spectrogram", lambda: spectrogram(self.samples, self.rate, 2048, self.fps))
        return sg.hpss(spec, masking)

    def analyze(self, tasks: tuple[str, ...]) -> dict[str, DataFrame]:
        unknown = set(tasks) - set(self.TASKS)
        if unknown:
            raise ValueError(f"no such tasks: {', '.join(sorted(unknown))}")
        return {t: getattr(self, t)() for t in tasks}


def analyze_files(spark: SparkSession, path: str, tasks: tuple[str, ...], sample_rate: int = MODEL_RATE, **options: object) -> tuple[dict[str, DataFrame], DataFrame]:
    """One table per task for the WAV files of a folder, and the failures (track, step, error).

    A file that can't be read, or on which a kernel of a task fails, is in the failures and in none of the tables; the
    others are analysed. ``options`` are the analyzer's.
    """
    with failures_kept() as kept:
        tables = Analyzer(read_wav(spark, path, sample_rate=sample_rate), sample_rate, **options).analyze(tasks)
    failures = checkpointed(kept.table(spark), "failures")
    failed = failures.select("track").distinct()
    return {t: df.join(failed, "track", "left_anti") for t, df in tables.items()}, failures


def _per_beat(features: DataFrame, times: DataFrame, divisions: int, fps: float) -> DataFrame:
    """Beat-synchronous features as one array per beat."""
    synced = beats.sync_features(features, times, divisions, fps)
    rows = synced.groupBy("track", "beat").agg(F.sort_array(F.collect_list(F.struct("division", "bin", "mag"))).alias("s"))
    return rows.select("track", F.col("beat").cast("bigint").alias("frame"), F.col("s.mag").alias("x"))


def bar_activations(samples: DataFrame, sample_rate: int, times: DataFrame, rhythmic: list[nn.Layer], harmonic: list[nn.Layer], fps: float = 100.0) -> DataFrame:
    """Downbeat activations of beats (track, t): (track, t, a), the mean of a rhythmic and a harmonic ensemble.

    The rhythmic one sees spectral differences in four parts of a beat, the harmonic one chroma in two. The last beat has
    NaN, as nothing follows it.
    """
    flux = sg.difference(log_filtered(samples, sample_rate, 2048, fps, 6), 1, 3, positive=True).select("track", "frame", "bin", F.col("diff").alias("mag"))
    chroma = sg.clp_chroma(semitone_energies(samples, sample_rate, fps)).select("track", "frame", F.col("pc").cast("bigint").alias("bin"), F.col("value").alias("mag"))
    parts = [nn.run_networks(_per_beat(f, times, d, fps), nets) for f, d, nets in ((flux, 4, rhythmic), (chroma, 2, harmonic))]
    acts = parts[0].unionByName(parts[1]).groupBy("track", "frame").agg(F.avg("x").alias("a"))
    numbered = times.withColumn("frame", (F.row_number().over(Window.partitionBy("track").orderBy("t")) - 1).cast("bigint"))
    return numbered.join(acts, ["track", "frame"], "left").select("track", "t", F.coalesce("a", F.lit(float("nan"))).alias("a"))


def pattern_features(samples: DataFrame, sample_rate: float, crossovers: tuple[float, ...] = (270.0,), fps: float = 50.0) -> DataFrame:
    """Positive differences of a few bands, as pattern models see them: (track, frame, x array)."""
    logged = log_filtered(samples, sample_rate, 2048, fps, 12)
    diff = sg.difference(logged, 1, positive=True).select("track", "frame", "bin", F.col("diff").alias("mag"))
    edges = [0, *(int(12 * math.log2(c / 30.0)) for c in crossovers), 10_000]
    band = F.lit(0)
    for low in edges[1:-1]:
        band = band + (F.col("bin") >= low).cast("int")
    means = diff.groupBy("track", "frame", band.alias("band")).agg(F.avg("mag").alias("mag"))
    rows = means.groupBy("track", "frame").agg(F.sort_array(F.collect_list(F.struct("band", "mag"))).alias("s"))
    return rows.select("track", "frame", F.col("s.mag").alias("x"))


def semitone_energies(samples: DataFrame, sample_rate: int, fps: float = 50.0, fmin: float = 27.5, fmax: float = 4200.0, frames_per_run: int | None = None) -> DataFrame:
    """Energy of each semitone's band per frame: (track, frame, midi, energy).

    Each rate's signal is made once by resampling; all its bands are filtered forth and back together, and only their
    energies in half-overlapping frames leave the task. A recording is cut into runs of frames with so many samples
    around them that the filters, whose poles are known, forget what lies beyond, but for 1e-13 of it.
    """
    bands = filterbanks.semitone_bands(fmin, fmax)
    parts = []
    for rate in sorted({b["rate"] for b in bands}):
        mine = [b for b in bands if b["rate"] == rate]
        at_rate = samples.select("track", "n", "x") if rate == sample_rate else resample(samples, rate, sample_rate)
        parts.append(_band_energies(at_rate, mine, rate, fps, frames_per_run))
    return reduce(DataFrame.unionByName, parts)


def _band_energies(samples: DataFrame, bands: list[dict], rate: int, fps: float, frames_per_run: int | None = None) -> DataFrame:
    size, hop = int(round(2 * rate / fps)), rate / fps
    numbers = np.asarray([b["midi"] for b in bands], np.int32)
    edge = 27  # samples of the odd extension at a recording's ends
    around = max(filterbanks.run_up(max(b["radius"] for b in bands)), edge + 1) + size
    count = frames_per_run or math.ceil(8 * around / hop)
    n = F.col("n")
    low, high = F.floor((n - around - size) / (count * hop)) - 1, F.floor((n + around + size) / (count * hop))
    dealt = samples.select("track", "n", F.col("x").cast("double").alias("x")).withColumn("run", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("bigint")), high)))

    def run(c):
        first = int(c["run"][0]) * count
        begin, end = math.floor(first * hop) - size // 2 - around, math.floor((first + count - 1) * hop) - size // 2 + size + around
        inside = (c["n"] >= begin) & (c["n"] < end)
        x, lo = c["x"][inside], max(0, begin)
        hi = lo + len(x)  # the recording's end, if it ends in here
        frames = np.arange(first, min(first + count, math.ceil(hi / hop)))
        if not len(frames) or not len(x):
            return {"frame": np.zeros(0, np.int64), "midi": numbers[:0], "energy": np.zeros(0)}
        filters = filterbanks.SectionFilters([b["sections"] for b in bands])
        pad = min(len(x) - 1, edge)
        # odd extension at both ends, filtered forth and back; what it does inside a recording is forgotten
        wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
        y = filters(filters(np.tile(wide, (len(bands), 1)))[:, ::-1])[:, ::-1][:, pad : pad + len(x)]
        total = np.concatenate((np.zeros((len(bands), 1)), np.cumsum(y * y, 1)), 1)
        start = np.floor(frames * hop).astype(np.int64) - size // 2
        energy = total[:, np.clip(start + size, lo, hi) - lo] - total[:, np.clip(start, lo, hi) - lo]
        return {"frame": np.tile(frames, len(bands)), "midi": np.repeat(numbers, len(frames)), "energy": np.maximum(energy, 0).ravel() / rate * 22050}

    return map_series(dealt, ["n", "x", "run"], run, "frame bigint, midi int, energy double", ("track", "run"), "n").drop("run")
