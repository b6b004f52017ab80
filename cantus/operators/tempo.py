"""Interval histograms and tempo estimation, and comb filters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import headed, map_series, scan_series
from .signal import hamming, smooth


def intervals(fps: float, min_bpm: float, max_bpm: float) -> np.ndarray:
    return np.arange(math.floor(60.0 * fps / max_bpm), math.ceil(60.0 * fps / min_bpm) + 1)


# --- comb filters ---------------------------------------------------------------------------------------------------


def comb_forward(df: DataFrame, tau: int, alpha: float) -> DataFrame:
    """x plus its delayed copy: (track, n, x) with ``y``."""
    if tau <= 0:
        raise ValueError("a delay must be positive")
    return df.withColumn("y", F.col("x") + F.coalesce(F.lag("x", tau).over(Window.partitionBy("track").orderBy("n")), F.lit(0.0)) * alpha)


#: Delays that one task filters a track with.
TOGETHER = 16


def factors_of(taus: list[int], alpha: float | list[float]) -> list[float]:
    """One factor per delay: a number serves all of them."""
    factors = [float(alpha)] * len(taus) if isinstance(alpha, (int, float)) else [float(a) for a in alpha]
    if len(factors) != len(taus):
        raise ValueError(f"{len(factors)} factors for {len(taus)} delays")
    if min(taus) <= 0:
        raise ValueError("a delay must be positive")
    return factors


def resonated(x: np.ndarray, tau: int, factor: float) -> np.ndarray:
    """x plus the delayed output; the factor has single precision."""
    y, factor = np.array(x, float), float(np.float32(factor))
    for lo in range(tau, len(y), tau):  # a delay's worth of samples depends on the one before as a whole
        part = y[lo : lo + tau]
        part += factor * y[lo - tau : lo - tau + len(part)]
    return y


def carried(state: np.ndarray, tau: int, factor: float, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What the ``tau`` outputs before a block (tau x columns) add to its ``length`` outputs, and to the last ``tau`` of both together."""
    at = np.arange(length)
    added = float(np.float32(factor)) ** (at // tau + 1)[:, None] * state[at % tau]
    return added, np.concatenate((state, added))[-tau:]


def _resonate_split(df: DataFrame, taus: list[int], factors: list[float], block: int, width: int) -> DataFrame:
    """Backward filters of tracks of any length, by an affine scan: (track, n, tau, y array).

    Blocks of samples run from silence and report their last outputs; a scan over the blocks adds what each one's state
    becomes of the state before it, through powers of the factor; with its state, each block is filtered for good.
    Samples of a track follow each other without gaps; ``x`` are arrays of ``width``.
    """
    size, keys = max(block, *taus), ("track", "block")
    owned = df.select("track", "n", "x").withColumn("block", F.floor(F.col("n") / size).cast("bigint"))
    pairs = list(zip(taus, factors))
    cuts = np.cumsum([0, *taus])

    def tails(c):
        x = np.stack(c["x"]).astype(float)
        ends = [np.concatenate((np.zeros((t, width)), resonated(x, t, f)))[-t:] for t, f in pairs]
        return {"tail": np.concatenate(ends).reshape(1, -1), "length": np.asarray([len(x)])}

    def step(state, row):
        tail, length = row["tail"].reshape(-1, width), int(row["length"])
        after = [tail[lo:hi] + carried(state[lo:hi], t, f, length)[1] for (t, f), lo, hi in zip(pairs, cuts, cuts[1:])]
        return np.concatenate(after), {"state": state.ravel().tolist()}

    def filtered(c):
        x, state = np.stack(c["x"][1:]).astype(float), np.asarray(c["state"][0], float).reshape(-1, width)
        y = [resonated(x, t, f) + carried(state[lo:hi], t, f, len(x))[0] for (t, f), lo, hi in zip(pairs, cuts, cuts[1:])]
        return {"n": np.tile(c["n"][1:], len(pairs)), "tau": np.repeat(taus, len(x)), "y": np.concatenate(y)}

    blocks = map_series(owned, ["n", "x"], tails, "tail array<double>, length bigint", keys, "n")
    states = scan_series(blocks, ["tail", "length"], lambda: np.zeros((int(cuts[-1]), width)), step, "state array<double>")
    return map_series(headed(owned, states, ["x"], keys, "n"), ["n", "x", "state"], filtered, "n bigint, tau int, y array<double>", keys, "n").drop("block")


def _resonate(df: DataFrame, taus: list[int], alpha: float | list[float], block: int | None = None) -> DataFrame:
    """Backward filters, a series per track and some delays: (track, n, tau, y). With ``block``, tracks are split in blocks of so many samples."""
    factors = factors_of(taus, alpha)
    if block:
        arrays = df.select("track", "n", F.array(F.col("x").cast("double")).alias("x"))
        return _resonate_split(arrays, taus, factors, block, 1).select("track", "n", "tau", F.col("y")[0].alias("y"))
    blocks = [list(zip(taus, factors))[i : i + TOGETHER] for i in range(0, len(taus), TOGETHER)]
    spread = df.select("track", "n", "x", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))).alias("block")) if len(blocks) > 1 else df.select("track", "n", "x", F.lit(0).alias("block"))

    def filtered(c):
        mine, n = blocks[int(c["block"][0])], len(c["x"])
        return {"n": np.tile(c["n"], len(mine)), "tau": np.repeat([t for t, _ in mine], n), "y": np.concatenate([resonated(c["x"], t, f) for t, f in mine])}

    return map_series(spread, ["n", "x", "block"], filtered, "n bigint, tau int, y double", ("track", "block"), "n").drop("block")


def comb_backward(df: DataFrame, tau: int, alpha: float, block: int | None = None) -> DataFrame:
    """x plus the delayed output: (track, n, x) with ``y``. With ``block``, tracks are split in blocks of so many samples."""
    return df.join(_resonate(df, [tau], alpha, block).drop("tau"), ["track", "n"])


def comb_backward_columns(df: DataFrame, tau: int, alpha: float, width: int, block: int = 1 << 16) -> DataFrame:
    """The same for signals of several columns, each filtered alone: (track, n, x array of ``width``) to (track, n, y array)."""
    (factor,) = factors_of([tau], alpha)
    return _resonate_split(df, [tau], [factor], block, width).drop("tau")


def comb_bank(df: DataFrame, taus: list[int], alpha: float | list[float], backward: bool = True, block: int | None = None) -> DataFrame:
    """One filter per delay, with a factor for all or one for each: (track, n, tau, y). With ``block``, backward filters split tracks."""
    if backward:
        return _resonate(df, taus, alpha, block)
    factors, series = factors_of(taus, alpha), Window.partitionBy("track").orderBy("n")
    filtered = [F.struct(F.lit(int(t)).alias("tau"), (F.col("x") + F.coalesce(F.lag("x", int(t)).over(series), F.lit(0.0)) * f).alias("y")) for t, f in zip(taus, factors)]
    return df.select("track", "n", F.array(*filtered).alias("all")).select("track", "n", F.inline("all"))


# --- histograms -----------------------------------------------------------------------------------------------------


def acf_histogram(acts: DataFrame, taus: list[int]) -> DataFrame:
    """Autocorrelation at each delay: (track, tau, bin); an equi-join with the shifted series."""
    later = acts.select("track", (F.col("frame")).alias("_at"), F.col("a").alias("_b"))
    shifted = acts.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus]))).withColumn("_at", F.col("frame") + F.col("tau"))
    pairs = shifted.join(later, ["track", "_at"]).groupBy("track", "tau").agg(F.sum(F.abs(F.col("a") * F.col("_b"))).alias("bin"))
    return pairs


def comb_histogram(acts: DataFrame, taus: list[int], alpha: float = 0.79) -> DataFrame:
    """Per frame the resonators with the largest output count with it: (track, tau, bin)."""
    bank = comb_bank(acts.select("track", F.col("frame").alias("n"), F.col("a").alias("x")), taus, alpha)
    best = F.max("y").over(Window.partitionBy("track", "n"))
    won = bank.withColumn("_w", F.when(F.col("y") == best, F.col("y")).otherwise(F.lit(0.0)))
    return won.groupBy("track", "tau").agg(F.sum("_w").alias("bin"))


def smooth_histogram(histogram: DataFrame, by: int | list[float]) -> DataFrame:
    return smooth(histogram, by, ("track",), "tau", "bin")


def dominant_interval(histogram: DataFrame) -> DataFrame:
    """(track, tau): the largest bin's delay, the shorter of equals."""
    return histogram.groupBy("track").agg(F.max_by("tau", F.struct("bin", -F.col("tau"))).alias("tau"))


def spline_between(x: np.ndarray, y: np.ndarray, step: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Places every ``step`` from the first x up to the last, and the quadratic spline through (x, y) there.

    Its knots lie half way between neighbouring x, but for the outermost of these, and three times at each end.
    """
    knots = np.concatenate((x[:1].repeat(3), ((x[1:] + x[:-1]) / 2)[1:-1], x[-1:].repeat(3)))

    def basis(at: np.ndarray) -> np.ndarray:
        inside = np.clip(np.searchsorted(knots, at, "right") - 1, 2, len(x) - 1)
        values = np.zeros((len(at), len(knots) - 1))
        values[np.arange(len(at)), inside] = 1
        for degree in (1, 2):
            count = len(knots) - 1 - degree
            rise, fall = knots[degree : degree + count] - knots[:count], knots[degree + 1 : degree + 1 + count] - knots[1 : count + 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(rise > 0, (at[:, None] - knots[:count]) / rise, 0.0)
                down = np.where(fall > 0, (knots[degree + 1 : degree + 1 + count] - at[:, None]) / fall, 0.0)
            values = up * values[:, :count] + down * values[:, 1 : count + 1]
        return values

    places = np.arange(x[0], x[-1], step)
    return places, basis(places) @ np.linalg.solve(basis(x), y)


def detect_tempo(histogram: DataFrame, fps: float, interpolate: bool = False) -> DataFrame:
    """(track, rank, bpm, strength) of the histogram's peaks, both ends being neighbours; without peaks (NaN, 0).

    With ``interpolate`` the histogram is read every hundredth of a frame from the quadratic spline through it.
    """
    if interpolate:
        finer = lambda c: dict(zip(("tau", "bin"), spline_between(c["tau"].astype(float), c["bin"])))
        histogram = map_series(histogram, ["tau", "bin"], finer, "tau double, bin double", order="tau")
    order, whole = Window.partitionBy("track").orderBy("tau"), Window.partitionBy("track")
    ends = histogram.withColumn("_lo", F.min_by("bin", "tau").over(whole)).withColumn("_hi", F.max_by("bin", "tau").over(whole))
    marked = ends.withColumn("_p", F.coalesce(F.lag("bin").over(order), F.col("_hi"))).withColumn("_n", F.coalesce(F.lead("bin").over(order), F.col("_lo")))
    found = marked.filter((F.col("bin") > F.col("_p")) & (F.col("bin") > F.col("_n")))
    ranked = found.select("track", F.row_number().over(whole.orderBy(F.desc("bin"), F.desc("tau"))).alias("rank"), (F.lit(60.0) * fps / F.col("tau")).alias("bpm"), (F.col("bin") / F.sum("bin").over(whole)).alias("strength"))
    none = histogram.select("track").distinct().join(found.select("track").distinct(), "track", "left_anti")
    return ranked.unionByName(none.select("track", F.lit(1).alias("rank"), F.lit(float("nan")).alias("bpm"), F.lit(0.0).alias("strength")))


def estimate_tempo(acts: DataFrame, fps: float, min_bpm: float = 40.0, max_bpm: float = 250.0, method: str = "comb", act_smooth: float | None = 0.14, hist_smooth: int = 9, alpha: float = 0.79, interpolate: bool = False) -> DataFrame:
    """Tempi of activations: smooth, histogram, smooth, peaks; with ``interpolate`` between the histogram's bins, too."""
    taus = intervals(fps, min_bpm, max_bpm).tolist()
    if method == "dbn":
        from .beats import dbn_intervals

        histogram = dbn_intervals(acts, fps, min_bpm, max_bpm)
    else:
        smoothed_acts = smooth(acts, round(fps * act_smooth) if act_smooth else None, ("track",), "frame", "a")
        if method not in ("comb", "acf"):
            raise ValueError(f"no tempo method {method!r}")
        histogram = comb_histogram(smoothed_acts, taus, alpha) if method == "comb" else acf_histogram(smoothed_acts, taus)
    return detect_tempo(smooth_histogram(histogram, hist_smooth), fps, interpolate)


# --- the same on arrays, for decoders that need a histogram on the way ------------------------------------------------


def smoothed(x: np.ndarray, size: int) -> np.ndarray:
    return np.convolve(x, hamming(size), "same") if size and size > 1 and len(x) >= size else np.asarray(x, float)


def comb_bins(a: np.ndarray, taus: np.ndarray, alpha: float) -> np.ndarray:
    y = np.stack([resonated(a, int(t), alpha) for t in taus], 1)
    return (y * (y == y.max(1, keepdims=True))).sum(0)


def dominant(bins: np.ndarray, taus: np.ndarray, smooth_by: int) -> int:
    return int(taus[np.argmax(smoothed(bins, smooth_by))])


def peaks(bins: np.ndarray, tempi: np.ndarray) -> list[tuple[float, float]]:
    at = np.flatnonzero((bins > np.roll(bins, 1)) & (bins > np.roll(bins, -1)))
    if not len(at):
        return [(math.nan, 0.0)]
    at = at[np.argsort(bins[at], kind="stable")[::-1]]
    return list(zip(tempi[at].tolist(), (bins[at] / bins[at].sum()).tolist()))
