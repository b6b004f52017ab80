"""Sequence models: hidden Markov models, linear-chain conditional random fields and Gaussian mixtures.

Models are small tables fixed at plan time; they travel to the workers with the function. A track's decoding is a
fold over its frames and runs in one task; tracks are spread over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .series import map_series
from .split_decode import split_viterbi


@dataclass(frozen=True)
class Transitions:
    """Edges of a Markov chain sorted by target, then source: dst, src and probability arrays over ``states`` states."""

    dst: np.ndarray
    src: np.ndarray
    prob: np.ndarray
    states: int

    @staticmethod
    def of(src, dst, prob, states: int | None = None, check: bool = True) -> Transitions:
        """Build from edges; repeated edges add up, and every state's edges must sum to 1."""
        src, dst, prob = np.asarray(src, np.int64), np.asarray(dst, np.int64), np.asarray(prob, float)
        count = int(states if states is not None else max(src.max(), dst.max()) + 1)
        if check:
            leaving = np.bincount(src, prob, count)
            if not np.allclose(leaving[np.unique(src)], 1):
                raise ValueError("the probabilities of leaving a state must sum to 1")
        code, at = np.unique(dst * count + src, return_inverse=True)
        return Transitions(code // count, code % count, np.bincount(at, prob, len(code)), count)

    @property
    def pointers(self) -> np.ndarray:
        return np.searchsorted(self.dst, np.arange(self.states + 1))

    def dense(self) -> np.ndarray:
        out = np.zeros((self.states, self.states))
        out[self.src, self.dst] = self.prob
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.dst.tolist(), self.src.tolist(), self.prob.tolist()))
        return spark.createDataFrame(rows, "dst bigint, src bigint, prob double")


def make_sparse(edges: DataFrame) -> DataFrame:
    """Edge rows (src, dst, prob) with repeated ones added up: (dst, src, prob, total), total being the source's sum."""
    summed = edges.groupBy("dst", "src").agg(F.sum("prob").alias("prob"))
    return summed.withColumn("total", F.sum("prob").over(Window.partitionBy("src")))


def _grouped_max(values: np.ndarray, starts: np.ndarray, filled: np.ndarray) -> np.ndarray:
    out = np.full(len(filled), -np.inf)
    if filled.any():
        out[filled] = np.maximum.reduceat(values, starts[filled])
    return out


def viterbi(transitions: Transitions, log_densities: np.ndarray, pointers: np.ndarray, initial: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Best state path and its log probability; of equal predecessors the first wins, and a dead model has no path.

    Back-pointers are kept as the place among a state's predecessors, in the least type that holds it.
    """
    states, edges = transitions.states, transitions
    starts = edges.pointers
    filled = np.diff(starts) > 0
    begin = starts[:-1]
    with np.errstate(divide="ignore"):
        weights = np.log(edges.prob)
        score = np.log(np.full(states, 1 / states) if initial is None else np.asarray(initial, float))
    widest = int(np.diff(starts).max()) if states else 0
    back = np.zeros((len(log_densities), states), np.uint8 if widest < 256 else np.uint16 if widest < 65536 else np.uint32)
    place = np.arange(len(edges.src)) - begin[edges.dst]
    for t, row in enumerate(log_densities):
        arriving = np.nan_to_num(score[edges.src] + weights, nan=-np.inf, neginf=-np.inf, posinf=np.inf)
        best = _grouped_max(arriving, begin, filled)
        hit = np.flatnonzero(arriving == best[edges.dst])[::-1]
        back[t, edges.dst[hit]] = place[hit]  # written backwards, so the first of equals stays
        score = best + row[pointers]
        score[np.isnan(score)] = -np.inf
    if len(log_densities) == 0 or not np.isfinite(score.max()):
        return np.zeros(0, np.int64), -math.inf
    path = np.empty(len(log_densities), np.int64)
    state = int(np.argmax(score))
    best_score = float(score[state])
    for t in range(len(path) - 1, -1, -1):
        path[t] = state
        state = int(edges.src[begin[state] + back[t, state]])
    return path, best_score


def forward(transitions: Transitions, densities: np.ndarray, pointers: np.ndarray, initial: np.ndarray | None = None) -> np.ndarray:
    """Normalised forward probabilities per frame."""
    states = transitions.states
    now = np.full(states, 1 / states) if initial is None else np.asarray(initial, float)
    out = np.empty((len(densities), states))
    for t, row in enumerate(densities):
        now = np.bincount(transitions.dst, now[transitions.src] * transitions.prob, states) * row[pointers]
        now = now / now.sum()
        out[t] = now
    return out


def decode_symbols(observations: DataFrame, transitions: Transitions, probabilities: np.ndarray, initial: np.ndarray | None = None, block: int | None = None) -> DataFrame:
    """Viterbi over symbols (track, frame, symbol): (track, frame, state, log_prob). With ``block``, tracks are split in blocks of so many frames."""
    probabilities = np.asarray(probabilities, float)
    if not np.allclose(probabilities.sum(1), 1):
        raise ValueError("a state's observation probabilities must sum to 1")
    with np.errstate(divide="ignore"):
        columns = np.log(probabilities.T)
    pointers = np.arange(transitions.states)
    if block:
        return split_viterbi(observations, ["symbol"], lambda c: columns[c["symbol"]], transitions, pointers, initial, block)

    def decode(c):
        path, score = viterbi(transitions, columns[c["symbol"]], pointers, initial)
        return {"frame": c["frame"][: len(path)], "state": path, "log_prob": np.full(len(path), score)}

    return map_series(observations, ["frame", "symbol"], decode, "frame bigint, state bigint, log_prob double")


def decode_densities(frames: DataFrame, transitions: Transitions, initial: np.ndarray | None = None, pointers: np.ndarray | None = None, block: int | None = None) -> DataFrame:
    """Viterbi over any observation model, given as log densities (track, frame, densities array): (track, frame, state, log_prob).

    ``pointers`` name the density of each state, the state's own without them. With ``block``, tracks are split in blocks
    of so many frames.
    """
    of = np.arange(transitions.states) if pointers is None else np.asarray(pointers)
    if block:
        return split_viterbi(frames, ["densities"], lambda c: np.stack(c["densities"]).astype(float), transitions, of, initial, block)

    def decode(c):
        path, score = viterbi(transitions, np.stack(c["densities"]).astype(float), of, initial)
        return {"frame": c["frame"][: len(path)], "state": path, "log_prob": np.full(len(path), score)}

    return map_series(frames, ["frame", "densities"], decode, "frame bigint, state bigint, log_prob double")


def forward_symbols(observations: DataFrame, transitions: Transitions, probabilities: np.ndarray, initial: np.ndarray | None = None) -> DataFrame:
    """Forward probabilities over symbols: (track, frame, state, prob)."""
    columns = np.asarray(probabilities, float).T

    def run(c):
        probs = forward(transitions, columns[c["symbol"]], np.arange(transitions.states), initial)
        n, s = probs.shape
        return {"frame": np.repeat(c["frame"], s), "state": np.tile(np.arange(s), n), "prob": probs.ravel()}

    return map_series(observations, ["frame", "symbol"], run, "frame bigint, state bigint, prob double")


@dataclass(frozen=True)
class ConditionalRandomField:
    """Linear-chain model: initial, final and bias scores per state, transition (from, to), observation (feature, state)."""

    initial: np.ndarray
    final: np.ndarray
    bias: np.ndarray
    transition: np.ndarray
    observation: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.zeros(0, np.int64)
        local = features @ self.observation + self.bias
        score = self.initial + local[0]
        back = np.zeros((len(features), len(score)), np.int64)
        for t in range(1, len(features)):
            arriving = score[:, None] + self.transition
            back[t] = arriving.argmax(0)
            score = arriving.max(0) + local[t]
        path = np.empty(len(features), np.int64)
        path[-1] = int((score + self.final).argmax())
        for t in range(len(path) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def crf_decode(features: DataFrame, model: ConditionalRandomField) -> DataFrame:
    """Best states of features (track, frame, x array): (track, frame, state)."""
    decode = lambda c: {"frame": c["frame"], "state": model.decode(np.stack(c["x"]).astype(float))}
    return map_series(features, ["frame", "x"], decode, "frame bigint, state bigint")


# --- Gaussian mixtures ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mixture:
    """Weights (K), means (K, D) and covariances: diag (K, D), spherical (K,), tied (D, D) or full (K, D, D)."""

    weights: np.ndarray
    means: np.ndarray
    covars: np.ndarray
    kind: str = "diag"

    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """Per component a matrix that makes its covariance the identity, and the covariance's log determinant."""
        k, d = self.means.shape
        if self.kind == "diag":
            return np.stack([np.diag(1 / np.sqrt(c)) for c in self.covars]), np.log(self.covars).sum(1)
        if self.kind == "spherical":
            return np.stack([np.eye(d) / math.sqrt(c) for c in self.covars]), d * np.log(self.covars)
        if self.kind not in ("full", "tied"):
            raise ValueError(f"no covariance type {self.kind!r}")
        roots = []
        for c in self.covars if self.kind == "full" else [self.covars] * k:
            try:
                roots.append(np.linalg.cholesky(c))
            except np.linalg.LinAlgError:
                roots.append(np.linalg.cholesky(c + 1e-7 * np.eye(d)))
        return np.stack([np.linalg.inv(r) for r in roots]), np.asarray([2 * np.log(np.diag(r)).sum() for r in roots])


def pseudo_inverse(a: np.ndarray, cutoff: float = 1e-10) -> np.ndarray:
    """Pseudo-inverse of a Hermitian matrix."""
    values, vectors = np.linalg.eigh(a)
    keep = np.abs(values) > cutoff * np.abs(values).max()
    return (vectors[:, keep] / values[keep]) @ vectors[:, keep].conj().T


def log_sum_exp(x: Column, over: WindowSpec) -> Column:
    """Stable log of the sum of exponentials over a window."""
    top = F.max(x).over(over)
    return top + F.ln(F.sum(F.exp(x - top)).over(over))


def mixture_scores(vectors: DataFrame, mixture: Mixture) -> DataFrame:
    """Rows (keys..., x array) to (keys..., component, log_prob, responsibility), log_prob being the whole mixture's.

    Components are a table of fixed size; each row meets them all by a generator, and distances are array expressions.
    """
    white, log_det = mixture.whitening()
    if vectors.schema["x"].dataType.simpleString() not in ("array<double>", "array<float>"):
        raise ValueError("x must be an array of numbers")
    d = mixture.means.shape[1]
    lit = lambda row: F.array(*[F.lit(float(v)) for v in row])
    parts = []
    for k in range(len(mixture.means)):
        centred = F.zip_with("x", lit(mixture.means[k]), lambda a, m: a - m)
        rows = [F.aggregate(F.zip_with(centred, lit(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for w in white[k]] if mixture.kind in ("full", "tied") else None
        if rows is None:
            scaled = F.zip_with(centred, lit(np.diag(white[k])), lambda a, b: a * b)
            distance = F.aggregate(F.transform(scaled, lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
        else:
            distance = sum((r * r for r in rows[1:]), rows[0] * rows[0])
        constant = -0.5 * (d * math.log(2 * math.pi) + float(log_det[k])) + math.log(mixture.weights[k])
        parts.append(F.struct(F.lit(k).alias("component"), (distance * -0.5 + constant).alias("score")))
    scored = vectors.withColumn("_s", F.array(*parts))
    top = F.array_max(F.transform("_s", lambda s: s["score"]))
    total = F.aggregate(F.transform("_s", lambda s: F.exp(s["score"] - top)), F.lit(0.0), lambda a, v: a + v)
    keyed = scored.withColumn("log_prob", top + F.ln(total)).withColumn("_c", F.explode("_s"))
    keys = [c for c in vectors.columns if c != "x"]
    return keyed.select(*keys, F.col("_c.component").alias("component"), "log_prob", F.exp(F.col("_c.score") - F.col("log_prob")).alias("responsibility"))
