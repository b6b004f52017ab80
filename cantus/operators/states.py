"""State spaces and transition models of beats, bars, patterns and notes.

They follow from their parameters alone and are built at plan time as small arrays; ``table`` methods give them as
DataFrames.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .sequence import Mixture, Transitions

EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Space:
    """Per state its position (in beats), interval (frames a beat) and pattern; first and last states per beat."""

    position: np.ndarray
    interval: np.ndarray
    pattern: np.ndarray
    first: list[np.ndarray]
    last: list[np.ndarray]

    @property
    def states(self) -> int:
        return len(self.position)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(self.states), self.position.tolist(), self.interval.tolist(), self.pattern.tolist()))
        return spark.createDataFrame(rows, "state bigint, position double, interval bigint, pattern bigint")


def beat_intervals(shortest: float, longest: float, count: int | None = None) -> np.ndarray:
    """All whole intervals, or about ``count`` of them in equal ratios."""
    every = np.arange(round(shortest), round(longest) + 1)
    if count is None or count >= len(every):
        return every
    # rounding makes some ratios meet, so more of them are tried until enough are left
    for tried in itertools.count(count):
        found = np.unique(np.rint(np.geomspace(shortest, longest, tried)).astype(np.int64))
        if len(found) >= count:
            return found


def beat_space(shortest: float, longest: float, count: int | None = None) -> Space:
    """One beat: an interval of n frames has n states at k / n."""
    intervals = beat_intervals(shortest, longest, count)
    last = np.cumsum(intervals) - 1
    first = last - intervals + 1
    interval = np.repeat(intervals, intervals)
    position = (np.arange(len(interval)) - np.repeat(first, intervals)) / interval
    return Space(position, interval, np.zeros(len(interval), np.int64), [first], [last])


def bar_space(beats: int, shortest: float, longest: float, count: int | None = None) -> Space:
    one = beat_space(shortest, longest, count)
    shift = [b * one.states for b in range(beats)]
    return Space(
        np.concatenate([one.position + b for b in range(beats)]), np.tile(one.interval, beats), np.zeros(beats * one.states, np.int64), [one.first[0] + s for s in shift], [one.last[0] + s for s in shift]
    )


def exponential_transition(before: np.ndarray, after: np.ndarray, factor: float | None, threshold: float = EPSILON, norm: bool = True) -> np.ndarray:
    """Probability of each change of interval (before x after); no factor means none changes."""
    if factor is None:
        return np.diag(np.diag(np.ones((len(before), len(after)))))
    prob = np.exp(-factor * np.abs(np.asarray(after, float)[None, :] / np.asarray(before, float)[:, None] - 1))
    prob[prob <= threshold] = 0
    return prob / prob.sum(1, keepdims=True) if norm else prob


def bar_transitions(space: Space, factors: list[float | None] | float | None) -> Transitions:
    """Within a beat on by one; from a beat's last states to the next one's first by the change of interval."""
    beats = len(space.first)
    factors = list(factors) if isinstance(factors, (list, tuple)) else [factors] * beats
    if len(factors) != beats:
        raise ValueError("one factor per beat")
    inner = np.setdiff1d(np.arange(space.states), np.concatenate(space.first))
    src, dst, prob = [inner - 1], [inner], [np.ones(len(inner))]
    for b in range(beats):
        start, end = space.first[b], space.last[b - 1]
        p = exponential_transition(space.interval[end], space.interval[start], factors[b])
        i, j = np.nonzero(p)
        src.append(end[i])
        dst.append(start[j])
        prob.append(p[i, j])
    return Transitions.of(np.concatenate(src), np.concatenate(dst), np.concatenate(prob), space.states)


beat_transitions = bar_transitions


def multi_pattern_space(spaces: list[Space]) -> Space:
    shift = np.cumsum([0, *(s.states for s in spaces)])
    return Space(
        np.concatenate([s.position for s in spaces]),
        np.concatenate([s.interval for s in spaces]),
        np.repeat(np.arange(len(spaces)), [s.states for s in spaces]),
        [s.first[0] + o for s, o in zip(spaces, shift)],
        [s.last[-1] + o for s, o in zip(spaces, shift)],
    )


def multi_pattern_transitions(models: list[Transitions], space: Space, change: float | None = None) -> Transitions:
    """Patterns side by side; a change goes from a pattern's last states to another's first ones of the same rank."""
    shift = np.cumsum([0, *(m.states for m in models)])
    src, dst, prob = (np.concatenate([getattr(m, f) + (o if f != "prob" else 0) for m, o in zip(models, shift)]) for f in ("src", "dst", "prob"))
    if change and len(models) > 1:
        # the edges by which each pattern starts anew, in the order of their targets
        turns = [np.flatnonzero(np.isin(src, space.last[p]) & np.isin(dst, space.first[p])) for p in range(len(models))]
        if len({len(t) for t in turns}) > 1:
            raise ValueError("patterns change into each other only with equally many entering and leaving states")
        moves = [(src[turns[q]], dst[turns[p]], prob[turns[p]] * change / (len(models) - 1)) for p in range(len(models)) for q in range(len(models)) if p != q]
        prob = prob.copy()
        prob[np.concatenate(turns)] *= 1 - change
        src, dst, prob = (np.concatenate([own, *(m[i] for m in moves)]) for i, own in enumerate((src, dst, prob)))
    return Transitions.of(src, dst, prob, space.states)


# --- observation models: log densities per frame, and each state's column -------------------------------------------


def beat_pointers(space: Space, parts: int) -> np.ndarray:
    return (space.position < 1 / parts).astype(np.int64)


def beat_densities(activation: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.column_stack(((1 - activation) / (parts - 1), activation)))


def downbeat_pointers(space: Space, parts: int) -> np.ndarray:
    """0: no beat, 1: beat, 2: downbeat."""
    border = 1 / parts
    return np.where(space.position < border, 2, np.where(space.position % 1 < border, 1, 0))


def downbeat_densities(beat: np.ndarray, downbeat: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.column_stack(((1 - (beat + downbeat)) / (parts - 1), beat, downbeat)))


def pattern_pointers(space: Space, mixtures: list[int], beats: list[int]) -> np.ndarray:
    """Each pattern's mixtures in equal shares of its length."""
    offset = np.cumsum([0, *mixtures])
    share = np.asarray(mixtures)[space.pattern] / np.asarray(beats)[space.pattern]
    return (np.floor(space.position * share) + offset[space.pattern]).astype(np.int64)


def pattern_densities(features: np.ndarray, mixtures: list[Mixture]) -> np.ndarray:
    return np.column_stack([log_density(features, m) for m in mixtures])


def log_density(x: np.ndarray, mixture: Mixture) -> np.ndarray:
    white, log_det = mixture.whitening()
    scores = np.column_stack([-0.5 * (x.shape[1] * math.log(2 * math.pi) + log_det[k] + (((x - mixture.means[k]) @ white[k].T) ** 2).sum(1)) + math.log(mixture.weights[k]) for k in range(len(white))])
    top = scores.max(1)
    return top + np.log(np.exp(scores - top[:, None]).sum(1))


# --- notes ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NoteStates:
    """Silence, then the states of attack, decay, sustain and release."""

    attack_length: int = 1
    decay_length: int = 1
    release_length: int = 1

    @property
    def silence(self) -> int:
        return 0

    @property
    def attack(self) -> int:
        return 1

    @property
    def decay(self) -> int:
        return self.attack + self.attack_length

    @property
    def sustain(self) -> int:
        return self.decay + self.decay_length

    @property
    def release(self) -> int:
        return self.sustain + self.release_length

    @property
    def states(self) -> int:
        return self.release + 1


def note_transitions(space: NoteStates, onset: float = 0.8, note: float = 0.8, offset: float = 0.2, end: float = 1.0) -> Transitions:
    """Silence may start a note; attack and decay run on or fall silent; a held note goes on, starts anew or is released."""
    s, total = space, onset + note + offset
    edges = [(s.silence, s.silence, 1 - onset), (s.silence, s.attack, onset)]
    for state in range(s.attack, s.sustain):
        on = onset if state < s.decay else note
        edges += [(state, state + 1, on), (state, s.silence, 1 - on)]
    edges += [(s.sustain, s.sustain, note / total), (s.sustain, s.attack, onset / total), (s.sustain, s.sustain + 1, offset / total)]
    for state in range(s.sustain + 1, s.release):
        edges += [(state, s.sustain, offset), (state, state + 1, 1 - offset)]
    edges += [(s.release, s.silence, end), (s.release, s.release, 1 - end)]
    src, dst, prob = zip(*[e for e in edges if e[2] > 0])
    return Transitions.of(src, dst, prob, s.states)


def note_pointers(space: NoteStates) -> np.ndarray:
    """0: silence, 1: onset, 2: note, 3: offset."""
    states = np.arange(space.states)
    return np.select([states == 0, states < space.decay, states <= space.sustain], [0, 1, 2], 3)


def note_densities(note: np.ndarray, onset: np.ndarray, offset: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.column_stack((1 - onset, onset, note, offset)))
