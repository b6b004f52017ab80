"""Streaming forms of the operators that keep state: differences to earlier frames, HMM filtering, ring buffers.

Frames of a track must come in order; what arrives late is dropped. State is per track and of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.nn import Network
from ..operators.sequence import Transitions


def _stateful(df: DataFrame, fn, out: str, state: str) -> DataFrame:
    return df.groupBy("track").applyInPandasWithState(fn, out, state, "append", GroupStateTimeout.NoTimeout)


def _in_order(pages: Iterator[pd.DataFrame], last: int) -> pd.DataFrame:
    rows = pd.concat(list(pages), ignore_index=True)
    return rows[rows.frame > last].drop_duplicates("frame").sort_values("frame")


def difference(frames: DataFrame, bins: int, lag: int = 1, positive: bool = True) -> DataFrame:
    """(track, frame, diff array) of (track, frame, x array): the difference to ``lag`` frames before, zero at the start."""
    kind = frames.schema["track"].dataType.simpleString()

    def step(key, pages, state: GroupState):
        last, kept = state.get if state.exists else (-1, [])
        past = np.asarray(kept, float).reshape(-1, bins)
        rows = _in_order(pages, last)
        if not len(rows):
            return
        block = np.vstack([past, np.stack(rows.x.to_numpy())])
        at = np.arange(len(past), len(block))
        diff = np.where((at >= lag)[:, None], block[at] - block[np.maximum(at - lag, 0)], 0.0)
        state.update((int(rows.frame.iloc[-1]), block[-lag:].ravel().tolist()))
        yield pd.DataFrame({"track": key[0], "frame": rows.frame, "diff": list(np.maximum(diff, 0) if positive else diff)})

    return _stateful(frames.select("track", "frame", "x"), step, f"track {kind}, frame bigint, diff array<double>", "last bigint, kept array<double>")


def hmm_filter(symbols: DataFrame, transitions: Transitions, probabilities: np.ndarray) -> DataFrame:
    """(track, frame, state): the likeliest state now, by forward probabilities that go on from batch to batch."""
    kind, emit = symbols.schema["track"].dataType.simpleString(), np.asarray(probabilities, float).T

    def step(key, pages, state: GroupState):
        last, now = state.get if state.exists else (-1, [1 / transitions.states] * transitions.states)
        now, rows = np.asarray(now), _in_order(pages, last)
        if not len(rows):
            return
        best = []
        for symbol in rows.symbol:
            now = np.bincount(transitions.dst, now[transitions.src] * transitions.prob, transitions.states) * emit[symbol]
            now = now / now.sum()
            best.append(int(now.argmax()))
        state.update((int(rows.frame.iloc[-1]), now.tolist()))
        yield pd.DataFrame({"track": key[0], "frame": rows.frame, "state": best})

    return _stateful(symbols.select("track", "frame", "symbol"), step, f"track {kind}, frame bigint, state bigint", "last bigint, now array<double>")


def ring_buffer(values: DataFrame, length: int) -> DataFrame:
    """(track, frame, window array): the last ``length`` values as of each batch."""
    kind = values.schema["track"].dataType.simpleString()

    def step(key, pages, state: GroupState):
        last, kept = state.get if state.exists else (-1, [0.0] * length)
        rows = _in_order(pages, last)
        if not len(rows):
            return
        kept = (list(kept) + rows.a.tolist())[-length:]
        state.update((int(rows.frame.iloc[-1]), kept))
        yield pd.DataFrame({"track": [key[0]], "frame": [int(rows.frame.iloc[-1])], "window": [kept]})

    return _stateful(values.select("track", "frame", "a"), step, f"track {kind}, frame bigint, window array<double>", "last bigint, kept array<double>")


class _Continued(StatefulProcessor):
    """A network's state per track, typed: the last frame and the values of all recurrent layers."""

    def __init__(self, network: Network, out: StructType) -> None:
        self.network, self.out = network, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last bigint, kept array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, kept = self.state.get() if self.state.exists() else (-1, self.network.start())
        fresh = _in_order(rows, last)
        if not len(fresh):
            return
        made, state = self.network.resume(np.stack(fresh.x.to_numpy()).astype(float), np.asarray(kept, float))
        self.state.update((int(fresh.frame.iloc[-1]), state.tolist()))
        yield pd.DataFrame({"track": key[0], "frame": fresh.frame, "y": list(made.reshape(len(made), -1))})

    def close(self) -> None:
        pass


def continued_network(features: DataFrame, network: Network) -> DataFrame:
    """(track, frame, y array) of features (track, frame, x array) by a recurrent network whose state goes on from batch to batch.

    The session's state store must be RocksDB's, as for any operator with typed state.
    """
    kind = features.schema["track"].dataType.simpleString()
    out = StructType.fromDDL(f"track {kind}, frame bigint, y array<double>")
    return features.select("track", "frame", "x").groupBy("track").transformWithStateInPandas(_Continued(network, out), out, "Append", "None")


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours", key: str = "event_type", time: str = "ts") -> DataFrame:
    """Events a window and kind, as a running activation curve; a window is out when ``late`` has passed."""
    marked = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = marked.groupBy(F.window("_t", width), F.col(key).alias("track")).agg(F.count("*").alias("a"))
    return counted.select("track", F.col("window.start").alias("start"), "a")
