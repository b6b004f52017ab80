"""Viterbi over split series: a track of any length is decoded in blocks of frames that run in parallel.

A block turns the scores at its start (its entry) into those at its end (its exit). Log probabilities are rounded to
2^-32, and a block's scores count from its best one, so sums of a block are exact up to 2^21 and the path is the same
however the track is cut: ties go to the first predecessor everywhere.

* A small model's blocks are (max, +) products, one row per state of departure; a scan over them gives every entry.
* A large model's blocks guess their entry from a run-up of frames before them, where survivors mostly merge. A block
  whose entry is not the exit of the block before runs again from that exit, all such blocks at once, until none is
  left; this ends with the entries of an unsplit run, after one round per block at worst.

Back-pointers of a block lead from each of its last states to one before its first; following them from the track's
best last state, block by block, gives every block the state that its path ends in, and the paths are read in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .series import Columns, headed, map_series, scan_series

if TYPE_CHECKING:
    from .sequence import Transitions

#: States up to which blocks are (max, +) products; back-pointers that a block holds; frames of a run-up.
SMALL, POINTERS, RUN_UP = 32, 1 << 26, 1000
_UNIT = float(1 << 32)

Densities = Callable[[Columns], np.ndarray]


def rounded(log_values: np.ndarray) -> np.ndarray:
    return np.round(np.asarray(log_values, float) * _UNIT) / _UNIT


class Steps:
    """The recursion over a model's edges, for one vector of scores or several at once."""

    def __init__(self, model: Transitions, pointers: np.ndarray) -> None:
        self.src, self.dst, self.pointers, self.states = model.src, model.dst, pointers, model.states
        starts = model.pointers
        self.begin, self.filled = starts[:-1], np.diff(starts) > 0
        with np.errstate(divide="ignore"):
            self.weights = rounded(np.log(model.prob))
        widest = int(np.diff(starts).max()) if model.states else 0
        self.kind = np.uint8 if widest < 256 else np.uint16 if widest < 65536 else np.uint32
        self.place = np.arange(len(self.src)) - self.begin[self.dst]

    def scores(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arriving along each edge, best of each state) of scores (..., states)."""
        arriving = before[..., self.src] + self.weights
        best = np.full(before.shape, -np.inf)
        if self.filled.any():
            best[..., self.filled] = np.maximum.reduceat(arriving, self.begin[self.filled], axis=-1)
        return arriving, best

    def advance(self, score: np.ndarray, densities: np.ndarray) -> np.ndarray:
        for row in densities:
            score = self.scores(score)[1] + row[self.pointers]
        return score

    def follow(self, score: np.ndarray, densities: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores at the end, and per frame and state the place of the best predecessor, the first of equals."""
        back = np.zeros((len(densities), self.states), self.kind)
        for t, row in enumerate(densities):
            arriving, best = self.scores(score)
            hit = np.flatnonzero(arriving == best[self.dst])[::-1]
            back[t, self.dst[hit]] = self.place[hit]
            score = best + row[self.pointers]
        return score, back

    def before(self, back: np.ndarray, state):
        return self.src[self.begin[state] + back[state]]


def levelled(score: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores counted from the best one, and that one; a dead vector stays dead."""
    top = float(score.max(initial=-np.inf))
    return (score - top, top) if np.isfinite(top) else (np.full(len(score), -np.inf), -math.inf)


def entry_of(model: Transitions, initial: np.ndarray | None) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return rounded(np.log(np.full(model.states, 1 / model.states) if initial is None else np.asarray(initial, float)))


def viterbi_blocks(model: Transitions, log_densities: np.ndarray, pointers: np.ndarray, initial: np.ndarray | None = None, block: int = 1 << 16) -> tuple[np.ndarray, float]:
    """The same path in one go, block after block: what the split run equals."""
    steps, score, total, backs = Steps(model, pointers), entry_of(model, initial), 0.0, []
    for lo in range(0, len(log_densities), block):
        score, back = steps.follow(score, rounded(log_densities[lo : lo + block]))
        score, top = levelled(score)
        backs.append(back)
        total += top
    if not backs or not math.isfinite(total):
        return np.zeros(0, np.int64), -math.inf
    back, state = np.concatenate(backs), int(np.argmax(score))
    path = np.empty(len(back), np.int64)
    for t in range(len(path) - 1, -1, -1):
        path[t] = state
        state = int(steps.before(back[t], state))
    return path, total


def split_viterbi(frames: DataFrame, columns: list[str], densities: Densities, model: Transitions, pointers: np.ndarray | None = None, initial: np.ndarray | None = None, block: int | None = None, run_up: int | None = None, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """Viterbi over series (keys, frame, ...columns) of any length: (keys, frame, state, log_prob).

    ``densities`` gives the log densities (frames x columns of ``pointers``) of some frames' columns. Frames of a series
    follow each other without gaps; a series whose model is dead has no rows.
    """
    of = np.arange(model.states) if pointers is None else np.asarray(pointers)
    steps, first = Steps(model, of), entry_of(model, initial)
    size = int(block or min(1 << 16, max(256, POINTERS // max(1, model.states))))
    ahead = min(size, RUN_UP if run_up is None else run_up) if model.states > SMALL else 0
    frames = frames.select(*dict.fromkeys([*keys, "frame", *columns]))
    at = F.floor(F.col("frame") / size).cast("bigint")
    owned = frames.withColumn("block", at)
    keyed = (*keys, "block")

    def log_densities(c: Columns, chosen) -> np.ndarray:
        return rounded(densities({k: c[k][chosen] for k in columns}))

    result = "entry array<double>, exit array<double>, gain double, back array<int>"

    def forward(entry: np.ndarray, rows: np.ndarray) -> dict:
        score, back = steps.follow(entry, rows)
        score, gain = levelled(score)
        state = np.arange(model.states)
        for t in range(len(back) - 1, -1, -1):
            state = steps.before(back[t], state)
        return {"entry": entry[None], "exit": score[None], "gain": np.asarray([gain]), "back": state[None].astype(np.int32)}

    none = {"entry": np.zeros((0, 1)), "exit": np.zeros((0, 1)), "gain": np.zeros(0), "back": np.zeros((0, 1), np.int32)}

    def guessed(c):
        own = c["frame"] // size == c["block"]
        if not own.any():
            return none
        # the run-up is part of the frames dealt; a block without one begins its series
        entry = levelled(steps.advance(np.zeros(model.states), log_densities(c, ~own)))[0] if not own.all() else first
        return forward(entry, log_densities(c, own))

    def entered(c):
        here = np.arange(len(c["frame"])) > 0
        return forward(np.asarray(c["entry"][0], float), log_densities(c, here))

    def run_entered(headers: DataFrame) -> DataFrame:
        return map_series(headed(owned, headers, columns, keyed, some=True), ["frame", *columns, "entry"], entered, result, keyed)

    if ahead:
        near = (F.col("frame") - at * size) >= size - ahead
        dealt = frames.withColumn("block", F.explode(F.when(near, F.array(at, at + 1)).otherwise(F.array(at))))
        blocks = map_series(dealt, ["frame", *columns, "block"], guessed, result, keyed)
    else:

        def product(c):
            m = np.full((model.states, model.states), -np.inf)
            np.fill_diagonal(m, 0.0)
            return {"product": steps.advance(m, log_densities(c, slice(None))).reshape(1, -1)}

        def enter(entry, row):
            passed = levelled((entry[:, None] + row["product"].reshape(model.states, -1)).max(0))[0]
            return passed, {"entry": entry.tolist()}

        products = map_series(owned, ["frame", *columns], product, "product array<double>", keyed)
        blocks = run_entered(scan_series(products, ["product"], lambda: first, enter, "entry array<double>", keys))
    blocks = checkpointed(blocks, "split")
    series = Window.partitionBy(*keys).orderBy("block")  # over one row per block, without its vectors
    links = checkpointed(blocks.select(*keyed).withColumn("last", F.lag("block").over(series)), "split")
    while True:
        exits = blocks.select(*keys, F.col("block").alias("last"), F.col("exit").alias("passed"))
        due = links.join(exits, [*keys, "last"], "left").select(*keyed, F.coalesce("passed", F.array(*(F.lit(float(x)) for x in first)) if model.states <= SMALL else F.lit(first.tolist()).cast("array<double>")).alias("entry"))
        wrong = checkpointed(due.join(blocks.select(*keyed, F.col("entry").alias("taken")), [*keyed]).filter(~F.col("entry").eqNullSafe(F.col("taken"))).select(*keyed, "entry"), "split")
        if wrong.isEmpty():
            break
        blocks = checkpointed(blocks.join(wrong.select(*keyed), [*keyed], "left_anti").unionByName(run_entered(wrong)), "split")

    def leave(state, row):
        state = int(np.argmax(row["exit"])) if state is None else state
        return int(row["back"][state]), {"goal": state, "entry": row["entry"].tolist()}

    totals = blocks.groupBy(*keys).agg(F.sum("gain").alias("log_prob")).filter(F.col("log_prob") > -math.inf)
    goals = scan_series(blocks, ["exit", "back", "entry"], lambda: None, leave, "goal bigint, entry array<double>", keys, descending=True)
    goals = goals.join(totals, [*keys])

    def read(c):
        rows = log_densities(c, np.arange(len(c["frame"])) > 0)
        _, back = steps.follow(np.asarray(c["entry"][0], float), rows)
        state, path = int(c["goal"][0]), np.empty(len(back), np.int64)
        for t in range(len(back) - 1, -1, -1):
            path[t] = state
            state = int(steps.before(back[t], state))
        return {"frame": c["frame"][1:], "state": path, "log_prob": np.full(len(path), float(c["log_prob"][0]))}

    held = headed(owned, goals.select(*keyed, "entry", "goal", "log_prob"), columns, keyed, some=True)
    return map_series(held, ["frame", *columns, "entry", "goal", "log_prob"], read, "frame bigint, state bigint, log_prob double", keyed).drop("block")
