"""Beat, bar, pattern and note decoding of activation tables.

A track's frames are gathered in one task and decoded in order; models are built once, on the driver. Rows in are
(track, frame, ...activations); rows out are event tables with seconds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import states, tempo
from .sequence import Mixture, viterbi
from .series import map_series
from .split_decode import split_viterbi
from .signal import hamming


def threshold_activations(acts: DataFrame, threshold: float, value: Column | str = "a") -> DataFrame:
    """Frames between the first and last that reach the threshold; none if the only one is frame 0."""
    hits = acts.filter(F.col(value) >= threshold if isinstance(value, str) else value >= threshold)
    ends = hits.groupBy("track").agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi")).filter("_hi > 0")
    return acts.join(ends, "track").filter("frame BETWEEN _lo AND _hi").select(*acts.columns)


def _regions(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _local_minima_around(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero((x < np.roll(x, 1)) & (x < np.roll(x, -1)))


def _split_beats(path: DataFrame, values: DataFrame, marks: np.ndarray, numbers: np.ndarray, reach: int, fps: float, block: int) -> DataFrame:
    """(track, t, beat, log_prob): of each stretch of marked states the frame with the largest value, the first of equals.

    ``values`` are (track, frame, v). A stretch belongs to the block it begins in; it is at most ``reach`` frames long, so
    the block gets as many of the next one's frames, and the last one before it to tell whether a stretch goes on.
    """
    size = max(block, reach + 1)
    at = F.floor(F.col("frame") / size).cast("bigint")
    place = F.col("frame") - at * size
    to = F.array_compact(F.array(at, F.when(place < reach, at - 1), F.when(place == size - 1, at + 1)))
    dealt = path.join(values, ["track", "frame"]).withColumn("block", F.explode(to))

    def pick(c):
        best = [(lo, lo + int(np.argmax(c["v"][lo:hi]))) for lo, hi in _regions(marks[c["state"]])]
        found = np.asarray([i for lo, i in best if c["frame"][lo] // size == c["block"][lo]], np.int64)
        return {"t": c["frame"][found] / fps, "beat": numbers[c["state"][found]], "log_prob": c["log_prob"][found]}

    return map_series(dealt, ["frame", "state", "v", "block", "log_prob"], pick, "t double, beat bigint, log_prob double", ("track", "block")).drop("block")


def dbn_beats(acts: DataFrame, fps: float, min_bpm: float = 55.0, max_bpm: float = 215.0, num_tempi: int | None = None, transition_lambda: float = 100.0, observation_lambda: int = 16, threshold: float = 0.0, correct: bool = True, block: int | None = None) -> DataFrame:
    """Beats (track, t) of activations (track, frame, a). With ``block``, tracks are decoded in blocks of so many frames, whatever their length."""
    space = states.beat_space(60 * fps / max_bpm, 60 * fps / min_bpm, num_tempi)
    model, pointers = states.beat_transitions(space, transition_lambda), states.beat_pointers(space, observation_lambda)

    def decode(c):
        a, at = c["a"], c["frame"]
        if not a.any():
            return {"t": np.zeros(0)}
        path, _ = viterbi(model, states.beat_densities(a, observation_lambda), pointers)
        if not len(path):
            return {"t": np.zeros(0)}
        if correct:
            found = [lo + int(np.argmax(a[lo:hi])) for lo, hi in _regions(pointers[path] == 1)]
        else:
            low = _local_minima_around(space.position[path])
            found = low[pointers[path[low]] == 1]
        return {"t": at[np.asarray(found, np.int64)] / fps}

    chosen = threshold_activations(acts, threshold) if threshold else acts
    if block:
        if not correct:
            raise ValueError("split tracks have corrected beats only")
        heard = chosen.groupBy("track").agg(F.max(F.abs("a")).alias("_top")).filter("_top > 0").select("track")
        path = split_viterbi(chosen.join(heard, "track", "left_semi"), ["a"], lambda c: states.beat_densities(c["a"], observation_lambda), model, pointers, block=block)
        reach = math.ceil(int(space.interval.max()) / observation_lambda) + 1
        return _split_beats(path, chosen.select("track", "frame", F.col("a").alias("v")), pointers == 1, np.ones(space.states, np.int64), reach, fps, block).select("track", "t")
    return map_series(chosen, ["frame", "a"], decode, "t double")


def dbn_intervals(acts: DataFrame, fps: float, min_bpm: float = 40.0, max_bpm: float = 250.0, transition_lambda: float = 100.0, observation_lambda: int = 16) -> DataFrame:
    """How many frames the best path spends at each interval: (track, tau, bin)."""
    space = states.beat_space(60 * fps / max_bpm, 60 * fps / min_bpm)
    model, pointers = states.beat_transitions(space, transition_lambda), states.beat_pointers(space, observation_lambda)

    def decode(c):
        path, _ = viterbi(model, states.beat_densities(c["a"], observation_lambda), pointers)
        tau = np.unique(space.interval)
        return {"tau": tau, "bin": np.bincount(space.interval[path], minlength=tau[-1] + 1)[tau].astype(float)}

    return map_series(acts, ["a"], decode, "tau bigint, bin double")


def per_model(count: int, **values: object) -> list[tuple]:
    """One value of each parameter per model: a single one serves all."""
    columns = []
    for name, value in values.items():
        column = list(value) if isinstance(value, (list, tuple)) else [value] * count
        if len(column) != count:
            raise ValueError(f"{name} has {len(column)} values for {count} models")
        columns.append(column)
    return list(zip(*columns))


PerModel = float | tuple[float, ...]


def dbn_downbeats(acts: DataFrame, fps: float, beats_per_bar: tuple[int, ...] = (3, 4), min_bpm: PerModel = 55.0, max_bpm: PerModel = 215.0, num_tempi: PerModel | None = 60, transition_lambda: PerModel = 100.0, observation_lambda: int = 16, threshold: float = 0.05, correct: bool = True, block: int | None = None) -> DataFrame:
    """Beats with their number in the bar (track, t, beat) of activations (track, frame, beat, downbeat).

    Each bar length is a series of its own per track; the likeliest of a track stays (the first of equals). Tempo limits,
    number of tempi and transition parameter may differ by bar length. With ``block``, tracks are decoded in blocks of so
    many frames, whatever their length.
    """
    models = []
    for beats, (low, high, tempi, change) in zip(beats_per_bar, per_model(len(beats_per_bar), min_bpm=min_bpm, max_bpm=max_bpm, num_tempi=num_tempi, transition_lambda=transition_lambda)):
        space = states.bar_space(beats, 60 * fps / high, 60 * fps / low, tempi)
        models.append((space, states.bar_transitions(space, change), states.downbeat_pointers(space, observation_lambda)))
    chosen = threshold_activations(acts, threshold, F.greatest("beat", "downbeat")) if threshold else acts
    if block:
        if not correct:
            raise ValueError("split tracks have corrected beats only")
        parts = []
        heard = chosen.groupBy("track").agg(F.max(F.greatest(F.abs("beat"), F.abs("downbeat"))).alias("_top")).filter("_top > 0").select("track")
        sounding, values = chosen.join(heard, "track", "left_semi"), chosen.select("track", "frame", F.greatest("beat", "downbeat").alias("v"))
        for meter, (space, model, pointers) in enumerate(models):
            path = split_viterbi(sounding, ["beat", "downbeat"], lambda c: states.downbeat_densities(c["beat"], c["downbeat"], observation_lambda), model, pointers, block=block)
            reach = math.ceil(int(space.interval.max()) / observation_lambda) + 1
            found = _split_beats(path, values, pointers >= 1, space.position.astype(np.int64) + 1, reach, fps, block)
            parts.append((path.groupBy("track").agg(F.max("log_prob").alias("score")).withColumn("meter", F.lit(meter)), found.withColumn("meter", F.lit(meter))))
        scores, beats = (reduce(DataFrame.unionByName, p) for p in zip(*parts))
        chosen_meter = scores.groupBy("track").agg((-F.max(F.struct("score", (-F.col("meter")).alias("m")))["m"]).alias("meter"))
        return beats.join(chosen_meter, ["track", "meter"], "left_semi").select("track", "t", "beat")
    spread = chosen.withColumn("meter", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))))

    def decode(c):
        space, model, pointers = models[int(c["meter"][0])]
        beat, down, at = c["beat"], c["downbeat"], c["frame"]
        nothing = {"score": [-math.inf], "t": [math.nan], "beat": [0]}
        if not (beat.any() or down.any()):
            return nothing
        path, score = viterbi(model, states.downbeat_densities(beat, down, observation_lambda), pointers)
        if not len(path):
            return nothing
        number = space.position[path].astype(np.int64) + 1
        if correct:
            best = np.maximum(beat, down)
            found = np.asarray([lo + int(np.argmax(best[lo:hi])) for lo, hi in _regions(pointers[path] >= 1)], np.int64)
        else:
            found = np.flatnonzero(np.diff(number)) + 1
        if not len(found):
            return {"score": [score], "t": [math.nan], "beat": [0]}
        return {"score": np.full(len(found), score), "t": at[found] / fps, "beat": number[found]}

    decoded = map_series(spread, ["frame", "beat", "downbeat", "meter"], decode, "score double, t double, beat bigint", ("track", "meter"))
    best = F.max(F.struct(F.col("score"), (-F.col("meter")).alias("m"))).over(Window.partitionBy("track"))
    return decoded.withColumn("_best", best).filter("_best.m = -meter AND NOT isnan(t)").select("track", "t", "beat")


def dbn_bars(beats: DataFrame, beats_per_bar: tuple[int, ...] = (3, 4), observation_weight: int = 100, meter_change: float = 1e-7) -> DataFrame:
    """Number the beats (track, t, a), a being the downbeat activation; the last beat follows from the one before."""
    spaces = [states.bar_space(b, 1, 1) for b in beats_per_bar]
    space = states.multi_pattern_space(spaces)
    model = states.multi_pattern_transitions([states.bar_transitions(s, 1.0) for s in spaces], space, meter_change)
    pointers = states.beat_pointers(space, observation_weight)

    def decode(c):
        path, _ = viterbi(model, states.beat_densities(c["a"][:-1], observation_weight), pointers)
        if not len(path):
            return {"t": np.zeros(0), "beat": np.zeros(0, np.int64)}
        number = space.position[path].astype(np.int64) + 1
        meter = beats_per_bar[space.pattern[path[-1]]]
        return {"t": c["t"], "beat": np.concatenate((number, [number[-1] % meter + 1]))}

    return map_series(beats, ["t", "a"], decode, "t double, beat bigint", order="t")


def pattern_beats(features: DataFrame, fps: float, patterns: list[tuple[int, list[Mixture]]], min_bpm: PerModel, max_bpm: PerModel, num_tempi: PerModel | None = None, transition_lambda: PerModel = 100.0, change: float | None = None) -> DataFrame:
    """Beats with numbers (track, t, beat) of features (track, frame, x array); a pattern is its beats and its mixtures."""
    limits = per_model(len(patterns), min_bpm=min_bpm, max_bpm=max_bpm, num_tempi=num_tempi, transition_lambda=transition_lambda)
    spaces = [states.bar_space(b, 60 * fps / high, 60 * fps / low, tempi) for (b, _), (low, high, tempi, _) in zip(patterns, limits)]
    space = states.multi_pattern_space(spaces)
    model = states.multi_pattern_transitions([states.bar_transitions(s, limit[3]) for s, limit in zip(spaces, limits)], space, change)
    pointers = states.pattern_pointers(space, [len(m) for _, m in patterns], [b for b, _ in patterns])
    mixtures = [m for _, ms in patterns for m in ms]

    def decode(c):
        path, _ = viterbi(model, states.pattern_densities(np.stack(c["x"]).astype(float), mixtures), pointers)
        number = space.position[path].astype(np.int64) + 1
        found = np.flatnonzero(np.diff(number)) + 1
        return {"t": c["frame"][found] / fps, "beat": number[found]}

    return map_series(features, ["frame", "x"], decode, "t double, beat bigint")


# --- beats from a tempo ---------------------------------------------------------------------------------------------


def _window(a: np.ndarray, middle: int, size: int) -> np.ndarray:
    """``size`` values around a place, zeros outside."""
    lo = middle - size // 2
    out = np.zeros(size)
    take = slice(max(0, lo), max(0, min(len(a), lo + size)))
    part = a[take]
    out[take.start - lo : take.start - lo + len(part)] = part
    return out


def beat_successors(a: np.ndarray, interval: int, look_aside: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """For every place the beat found there, which is where the weighted activation nearby is largest, and the place after it.

    The place after a beat is an interval on; past the end it is the length of ``a``.
    """
    n, aside = len(a), max(1, int(interval * look_aside))
    if aside > interval:
        raise ValueError("beats must not be looked for farther aside than they are apart")
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(aside), a, np.zeros(aside))), 2 * aside)[:n]
    step = np.argmax(around * np.asarray(hamming(2 * aside)), 1)
    beat = np.arange(n) + np.where(step > 0, step - aside, 0)
    return beat, np.minimum(beat + interval, n)


def follow_beats(a: np.ndarray, interval: int, look_aside: float = 0.2) -> np.ndarray:
    """Beats about ``interval`` apart, from the start within the first interval whose beats' activations have the largest sum.

    Where a place leads doesn't depend on the start, so sums of all chains are found at once: each round doubles the
    stretch that a place's sum covers, by adding the sum of the place where that stretch ends.
    """
    if not len(a) or interval < 1:
        return np.zeros(0, np.int64)
    beat, after = beat_successors(a, int(interval), look_aside)
    total, jump = np.append(a[beat], 0.0), np.append(after, len(a))
    while (jump < len(a)).any():
        total, jump = total + total[jump], jump[jump]
    at, found = int(np.argmax(total[: min(int(interval), len(a))])), []
    while at < len(a):
        found.append(int(beat[at]))
        at = int(after[at])
    return np.asarray(found, np.int64)


def local_beats(a: np.ndarray, ahead: int, shortest: int, interval_of: Callable[[np.ndarray], int], look_aside: float = 0.2) -> np.ndarray:
    """Beats whose interval may change: each is the one nearest to where the last lets expect it.

    Intervals and beats are those of the ``ahead`` frames on either side of that place; two beats are never nearer to
    each other than ``shortest``. Where no beat follows, the track ends.
    """

    def after(expected: int, earliest: float) -> tuple[int, int] | None:
        scene = _window(a, expected, 2 * ahead)
        interval = interval_of(scene)
        places = follow_beats(scene, interval, look_aside) + (expected - ahead)
        distance = np.where(places >= earliest, np.abs(places - expected), np.inf)
        nearest = int(np.argmin(distance)) if len(places) else 0
        return (int(places[nearest]), interval) if len(places) and np.isfinite(distance[nearest]) else None

    found: list[int] = []
    step = after(0, 0)
    while step is not None:
        found.append(step[0])
        step = after(sum(step), step[0] + shortest) if sum(step) < len(a) else None
    return np.asarray(found, np.int64)


def beat_detection(acts: DataFrame, fps: float, look_aside: float = 0.2, look_ahead: float | None = None, min_bpm: float = 40.0, max_bpm: float = 250.0, act_smooth: float = 0.14, hist_smooth: int = 9, alpha: float = 0.79) -> DataFrame:
    """Beats (track, t) at a global tempo, or with ``look_ahead`` seconds at the tempo around each beat."""
    taus = tempo.intervals(fps, min_bpm, max_bpm)

    def main_interval(a):
        return int(tempo.dominant(tempo.comb_bins(a, taus, alpha), taus, hist_smooth))

    def decode(c):
        a = tempo.smoothed(c["a"], int(fps * act_smooth))
        found = follow_beats(a, main_interval(a), look_aside) if look_ahead is None else local_beats(a, int(look_ahead * fps), int(taus[0]), main_interval, look_aside)
        t = found / fps
        return {"t": t[t >= 0]}

    return map_series(acts, ["a"], decode, "t double")


def crf_transition(interval: int, sigma: float) -> np.ndarray:
    """Normal density over the octaves by which a move differs from the interval."""
    move = np.arange(2 * interval, dtype=float)
    move[0] = 1e-6
    p = np.exp(-0.5 * ((np.log2(move) - math.log2(interval)) / sigma) ** 2)
    return (p / p.sum()).astype(np.float32)


def crf_norm(a: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """What the next moves can reach from each frame."""
    padded = np.concatenate((a, np.zeros(len(transition))))
    return np.lib.stride_tricks.sliding_window_view(padded, len(transition))[: len(a)] @ transition


def crf_sequence(a: np.ndarray, interval: int, sigma: float) -> tuple[np.ndarray, float]:
    """Best sequence of beats about ``interval`` apart and its log probability, in single precision.

    There are as many beats as whole intervals; the first one lies in the first interval, anywhere with weight one, so
    that its place favours no interval. A clip shorter than the interval has no beats.
    """
    a = a.astype(np.float32)
    n, transition = len(a), crf_transition(interval, sigma)
    beats = n // interval
    if not beats:
        return np.zeros(0, np.int64), -math.inf
    with np.errstate(divide="ignore", invalid="ignore"):
        start = np.where(np.arange(n) < interval, 0.0, -np.inf).astype(np.float32)
        moves, norm, act = np.log(transition), np.log(crf_norm(a, transition).astype(np.float32)), np.log(a)
        gain = act + norm
        score, back = start + act + norm, np.zeros((beats, n), np.int64)
        for k in range(1, beats):
            best, by = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
            for j in range(min(len(moves), n - 1)):
                through = score[1 : n - j] + moves[j]
                better = through > best[j + 1 :]
                best[j + 1 :][better] = through[better]
                by[j + 1 :][better] = j
            back[k] = np.arange(n) - by
            score = best + gain
        final = score - norm
    final[np.isnan(final)] = -np.inf
    path = np.empty(beats, np.int64)
    path[-1] = int(np.argmax(final))
    for k in range(beats - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path, float(final.max())


def crf_beats(acts: DataFrame, fps: float, sigma: float = 0.18, use_factors: bool = False, num_intervals: int = 5, factors: tuple[float, ...] = (0.5, 0.67, 1.0, 1.5, 2.0), min_bpm: float = 20.0, max_bpm: float = 240.0, act_smooth: float = 0.09, hist_smooth: int = 7, alpha: float = 0.79) -> DataFrame:
    """Beats (track, t): each likely interval is decoded by itself, and the likeliest a beat wins."""
    taus = tempo.intervals(fps, min_bpm, max_bpm)

    def decode(c):
        smooth = tempo.smoothed(c["a"], int(round(fps * act_smooth)))
        bins = tempo.smoothed(tempo.comb_bins(smooth, taus, alpha), hist_smooth)
        found = tempo.peaks(bins, 60.0 * fps / taus)
        spans = fps * 60.0 / np.asarray([bpm for bpm, _ in found])
        spans = spans[np.isfinite(spans)]
        if not len(spans):
            return {"t": np.zeros(0)}
        tried = [int(spans[0] * f) for f in factors if taus[0] <= int(spans[0] * f) <= taus[-1]] if use_factors else [int(s) for s in spans[:num_intervals]]
        a = tempo.smoothed(c["a"], int(fps * act_smooth))
        results = [r for i in sorted(tried, reverse=True) if len((r := crf_sequence(a, i, sigma))[0])]
        best = max(results, key=lambda r: r[1] / len(r[0]), default=(np.zeros(0), 0.0))
        return {"t": best[0] / fps}

    return map_series(acts, ["a"], decode, "t double")


def select_model(predictions: DataFrame) -> DataFrame:
    """Of each track's models (track, model, frame, a), the one nearest to their mean by squared error."""
    mean = F.avg("a").over(Window.partitionBy("track", "frame"))
    errors = predictions.withColumn("_e", F.pow(F.col("a") - mean, 2)).groupBy("track", "model").agg(F.sum("_e").alias("error"))
    best = errors.groupBy("track").agg(F.min_by("model", F.struct("error", "model")).alias("model"))
    return predictions.join(best, ["track", "model"])


def sync_features(features: DataFrame, beats: DataFrame, divisions: int, fps: float) -> DataFrame:
    """Mean features (track, frame, bin, mag) of each beat's divisions: (track, beat, division, bin, mag).

    A beat (track, t) reaches up to a little before the next one. Frames find their division through an equi-join on
    the frames that each beat generates, so there is no range join. An empty division has NaN.
    """
    order = Window.partitionBy("track").orderBy("t")
    ends = features.groupBy("track").agg(((F.max("frame") + 1) / fps).alias("_end"))
    inside = beats.join(ends, "track").filter(F.col("t") <= F.col("_end"))
    offset = F.least((F.lead("t").over(order) - F.col("t")) * (0.5 / divisions), F.lit(0.05))
    numbered = inside.select("track", "t", (F.row_number().over(order) - 1).alias("beat"), F.floor((F.lead("t").over(order) - offset) * fps).alias("_stop"))
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("t") - 0.02) * fps))
    spans = numbered.select("track", "beat", F.when(F.col("beat") == 0, first).otherwise(F.lag("_stop").over(order)).alias("_start"), "_stop").filter("_stop IS NOT NULL")
    frames = spans.filter("_stop > _start").withColumn("frame", F.explode(F.sequence("_start", F.col("_stop") - 1)))
    placed = frames.select("track", "beat", "frame", F.floor((F.col("frame") - F.col("_start")) * float(divisions) / (F.col("_stop") - F.col("_start"))).cast("int").alias("division"))
    means = features.join(placed, ["track", "frame"]).groupBy("track", "beat", "division", "bin").agg(F.avg("mag").alias("mag"))
    bins = features.select("track", "bin").distinct()
    grid = spans.select("track", "beat").withColumn("division", F.explode(F.sequence(F.lit(0), F.lit(divisions - 1)))).join(bins, "track")
    return grid.join(means, ["track", "beat", "division", "bin"], "left").withColumn("mag", F.coalesce("mag", F.lit(float("nan"))))


# --- notes ----------------------------------------------------------------------------------------------------------


def adsr_notes(acts: DataFrame, fps: float = 50.0, onset_prob: float = 0.8, note_prob: float = 0.8, offset_prob: float = 0.5, attack: float = 0.04, decay: float = 0.04, release: float = 0.02, complete: bool = True, onset_threshold: float = 0.5, note_threshold: float = 0.5, pitch_offset: int = 21) -> DataFrame:
    """Notes (track, pitch, onset, duration) of activations (track, pitch, frame, note, onset, offset); frames start at 0.

    Each pitch is decoded as a series of its own. Where its states begin to sound or cease to, a stretch ends; every
    second stretch is a note, from the frame before it sounds to its last but one. A note stays if both activations
    reach their thresholds and, with ``complete``, it goes through all states from attack to release.
    """
    space = states.NoteStates(*(max(1, int(x * fps)) for x in (attack, decay, release)))
    model, pointers = states.note_transitions(space, onset_prob, note_prob, offset_prob), states.note_pointers(space)

    def decode(c):
        path, _ = viterbi(model, states.note_densities(c["note"], c["onset"], c["offset"]), pointers)
        return {k: v[: len(path)] for k, v in {**c, "state": path}.items()}

    decoded = map_series(acts, ["frame", "note", "onset", "offset"], decode, "frame bigint, note double, onset double, state bigint", ("track", "pitch"))
    series = Window.partitionBy("track", "pitch").orderBy("frame")
    sounds = (F.col("state") > space.attack) & (F.col("state") < space.release)
    turns = F.coalesce(sounds != F.lead(sounds).over(series), F.lit(False)).cast("int")
    stretches = decoded.withColumn("turns", turns).withColumn("stretch", F.sum("turns").over(series))
    inside = F.when((F.col("state") >= space.attack) & (F.col("state") < space.release), F.col("state"))
    notes = stretches.filter("stretch % 2 = 1").groupBy("track", "pitch", "stretch").agg(F.min("frame").alias("first"), F.count("*").alias("frames"), F.max("note").alias("note"), F.max("onset").alias("struck"), F.count_distinct(inside).alias("stages"))
    kept = notes.filter((F.col("note") >= note_threshold) & (F.col("struck") >= onset_threshold))
    if complete:
        kept = kept.filter(F.col("stages") == space.release - space.attack)
    return kept.select("track", (F.col("pitch") + pitch_offset).alias("pitch"), (F.col("first") / fps).alias("onset"), (F.col("frames") / fps).alias("duration"))
