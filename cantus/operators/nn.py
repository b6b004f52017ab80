"""Neural-network inference.

Two forms. Feed-forward layers are joins with weight tables over rows (track, frame, unit, x) or, for images,
(track, frame, bin, ch, x). Whole networks are array functions. Where every layer has a ``reach``, the frames before and
after that an output depends on, a clip is run in blocks of frames and its length is no limit; networks with recurrences
need whole clips and are spread over tracks and models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import map_series

Array = np.ndarray
Layer = Callable[[Array], Array]
#: Frames before and after; negative where a layer moves its input on.
Reach = tuple[int, int]
#: Frames whose outputs a task makes at a time where a network allows it.
BLOCK = 1024


# --- layers as joins ------------------------------------------------------------------------------------------------


def weight_table(spark: SparkSession, weights: Array, names: tuple[str, ...]) -> DataFrame:
    """An array of weights as rows of its indices and ``w``."""
    rows = [(*at, float(w)) for at, w in np.ndenumerate(weights)]
    return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names) + ", w double")


#: Outputs up to which a layer is one aggregation with a sum for each.
SUMS = 32


def dense(rows: DataFrame, weights: Array, bias: Array, activation: Callable[[Column], Column] | None = None) -> DataFrame:
    """x W + b over units.

    Few outputs are sums of one aggregation, combined before the shuffle; a layer with more of them meets its weights in
    a broadcast join, whose size the layer fixes.
    """
    act = activation or (lambda x: x)
    if len(bias) <= SUMS:
        at = lambda j: F.get(F.array(*[F.lit(float(w)) for w in np.asarray(weights)[:, j]]), F.col("unit").cast("int"))
        sums = rows.groupBy("track", "frame").agg(*[F.sum(F.col("x") * at(j)).alias(f"_{j}") for j in range(len(bias))])
        made = F.array(*[act(F.col(f"_{j}") + float(b)) for j, b in enumerate(bias)])
        return sums.select("track", "frame", F.posexplode(made).alias("unit", "x")).withColumn("unit", F.col("unit").cast("bigint"))
    spark = rows.sparkSession
    table = weight_table(spark, weights, ("unit", "out"))
    biases = spark.createDataFrame([(j, float(b)) for j, b in enumerate(bias)], "out bigint, b double")
    summed = rows.join(F.broadcast(table), "unit").groupBy("track", "frame", "out").agg(F.sum(F.col("x") * F.col("w")).alias("_s"))
    return summed.join(F.broadcast(biases), "out").select("track", "frame", F.col("out").alias("unit"), act(F.col("_s") + F.col("b")).alias("x"))


def batch_norm(rows: DataFrame, beta: float, gamma: float, mean: float, inv_std: float, activation: Callable[[Column], Column] | None = None) -> DataFrame:
    x = (F.col("x") - mean) * (gamma * inv_std) + beta
    return rows.withColumn("x", activation(x) if activation else x)


def convolve(rows: DataFrame, kernel: Array, bias: float = 0.0, activation: Callable[[Column], Column] | None = None) -> DataFrame:
    """Valid convolution (the kernel is turned round) over (frame, bin): every value meets the places it reaches."""
    height, width = kernel.shape
    taps = F.array(*[F.struct(F.lit(i).alias("df"), F.lit(j).alias("db"), F.lit(float(w)).alias("w")) for (i, j), w in np.ndenumerate(kernel)])
    reach = rows.select("track", "frame", "bin", "x", F.inline(taps)).select("track", (F.col("frame") + F.col("df") - (height - 1)).alias("frame"), (F.col("bin") + F.col("db") - (width - 1)).alias("bin"), (F.col("x") * F.col("w")).alias("_p"))
    summed = reach.groupBy("track", "frame", "bin").agg(F.sum("_p").alias("_s"), F.count("*").alias("_n")).filter(F.col("_n") == height * width)
    x = F.col("_s") + bias
    return summed.select("track", "frame", "bin", (activation(x) if activation else x).alias("x"))


def max_pool(rows: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Largest value of each whole block."""
    blocks = rows.groupBy("track", F.expr(f"frame div {size[0]}").alias("frame"), F.expr(f"bin div {size[1]}").alias("bin")).agg(F.max("x").alias("x"), F.count("*").alias("_n"))
    return blocks.filter(F.col("_n") == size[0] * size[1]).drop("_n")


def average(rows: DataFrame, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("x").alias("x"))


def pad_frames(rows: DataFrame, width: int, value: float | None = 0.0) -> DataFrame:
    """Frames before and after: constant, or repeating the first and last where the value is None. Frames start anew at 0."""
    ends = rows.groupBy("track").agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi"))
    sized = rows.join(ends, "track")
    copies = F.array(*[F.lit(i) for i in range(1, width + 1)])
    before = sized.filter("frame = _lo").withColumn("_i", F.explode(copies)).withColumn("frame", F.col("_lo") - F.col("_i"))
    after = sized.filter("frame = _hi").withColumn("_i", F.explode(copies)).withColumn("frame", F.col("_hi") + F.col("_i"))
    edges = before.unionByName(after).drop("_i")
    if value is not None:
        edges = edges.withColumn("x", F.lit(float(value)))
    return sized.unionByName(edges).withColumn("frame", F.col("frame") - F.col("_lo") + width).drop("_lo", "_hi")


def stride_blocks(rows: DataFrame, block: int, bins: int) -> DataFrame:
    """Each run of ``block`` frames as one row of units."""
    last = rows.groupBy("track").agg(F.max("frame").alias("_last"))
    spread = rows.join(last, "track").withColumn("_k", F.explode(F.array(*[F.lit(i) for i in range(block)])))
    return spread.select("track", (F.col("frame") - F.col("_k")).alias("frame"), (F.col("_k") * bins + F.col("bin")).alias("unit"), "x", "_last").filter(f"frame >= 0 AND frame <= _last - {block - 1}").drop("_last")


def transpose(rows: DataFrame) -> DataFrame:
    return rows.select("track", F.col("bin").alias("frame"), F.col("frame").alias("bin"), "x")


def reshape(rows: DataFrame, bins: int, to_bins: int) -> DataFrame:
    """Row-major: the same values in rows of another length."""
    place = F.col("frame") * bins + F.col("bin")
    return rows.select("track", F.floor(place / to_bins).alias("frame"), (place % to_bins).alias("bin"), "x")


def average_predictions(predictions: DataFrame, keys: tuple[str, ...] = ("track", "frame", "unit")) -> DataFrame:
    """Mean of an ensemble's outputs (keys, model, x)."""
    return predictions.groupBy(*keys).agg(F.avg("x").alias("x"))


# --- layers as array functions, for whole networks ------------------------------------------------------------------


def sigmoid(x: Array) -> Array:
    return 0.5 * (1 + np.tanh(0.5 * x))


def elu(x: Array) -> Array:
    return np.where(x < 0, np.expm1(np.minimum(x, 0)), x)


def relu(x: Array) -> Array:
    return np.maximum(x, 0)


def softmax(x: Array) -> Array:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass(frozen=True)
class Dense:
    weights: Array
    bias: Array
    activation: Layer | None = None
    reach = (0, 0)

    def __call__(self, x: Array) -> Array:
        y = x @ self.weights + self.bias
        return self.activation(y) if self.activation else y


def _state(initial: Array | None, size: int) -> Array:
    """State before the first frame: every clip starts from it anew."""
    return np.zeros(size) if initial is None else np.asarray(initial, float)


@dataclass(frozen=True)
class Recurrent:
    weights: Array
    bias: Array
    recurrent: Array
    activation: Layer = np.tanh
    initial: Array | None = None

    def start(self) -> Array:
        return _state(self.initial, len(self.recurrent))

    def resume(self, x: Array, state: Array) -> tuple[Array, Array]:
        """Outputs from a state on, and the state after them."""
        inputs, h = x @ self.weights + self.bias, state
        out = np.empty((len(x), len(h)))
        for t, now in enumerate(inputs):
            out[t] = h = self.activation(now + h @ self.recurrent)
        return out, h

    def __call__(self, x: Array) -> Array:
        return self.resume(x, self.start())[0]


@dataclass(frozen=True)
class Bidirectional:
    forward: Layer
    backward: Layer

    def __call__(self, x: Array) -> Array:
        return np.hstack((self.forward(x), self.backward(x[::-1])[::-1]))


@dataclass(frozen=True)
class Lstm:
    """Gates in the order input, forget, cell, output, each (weights, bias, recurrent, peephole or None)."""

    gates: tuple[tuple[Array, Array, Array, Array | None], ...]
    initial: Array | None = None
    initial_cell: Array | None = None

    def start(self) -> Array:
        size = len(self.gates[0][1])
        return np.concatenate((_state(self.initial, size), _state(self.initial_cell, size)))

    def __call__(self, x: Array) -> Array:
        return self.resume(x, self.start())[0]

    def resume(self, x: Array, state: Array) -> tuple[Array, Array]:
        """Outputs from a state (outputs, then cells) on, and the state after them."""
        pre = [x @ w + b for w, b, _, _ in self.gates]
        size = len(self.gates[0][1])
        h, c, out = state[:size], state[size:], np.empty((len(x), size))
        peep = [p if p is not None else np.zeros(size) for *_, p in self.gates]
        rec = [r for _, _, r, _ in self.gates]
        for t in range(len(x)):
            i = sigmoid(pre[0][t] + h @ rec[0] + c * peep[0])
            f = sigmoid(pre[1][t] + h @ rec[1] + c * peep[1])
            c = f * c + i * np.tanh(pre[2][t] + h @ rec[2])
            o = sigmoid(pre[3][t] + h @ rec[3] + c * peep[3])  # sees the new cell
            out[t] = h = o * np.tanh(c)
        return out, np.concatenate((h, c))


@dataclass(frozen=True)
class Gru:
    """Reset, update and cell, each (weights, bias, recurrent)."""

    reset: tuple[Array, Array, Array]
    update: tuple[Array, Array, Array]
    cell: tuple[Array, Array, Array]
    initial: Array | None = None

    def start(self) -> Array:
        return _state(self.initial, len(self.cell[1]))

    def __call__(self, x: Array) -> Array:
        return self.resume(x, self.start())[0]

    def resume(self, x: Array, state: Array) -> tuple[Array, Array]:
        """Outputs from a state on, and the state after them."""
        pre = [x @ w + b for w, b, _ in (self.reset, self.update, self.cell)]
        h, out = state, np.empty((len(x), len(self.cell[1])))
        for t in range(len(x)):
            r, u = sigmoid(pre[0][t] + h @ self.reset[2]), sigmoid(pre[1][t] + h @ self.update[2])
            c = np.tanh(pre[2][t] + r * (h @ self.cell[2]))
            out[t] = h = u * c + (1 - u) * h
        return out, h


@dataclass(frozen=True)
class Conv:
    """Weights (in, out, height, width) over (frames, bins, channels); kernels are turned round."""

    weights: Array
    bias: Array
    activation: Layer | None = None
    pad: str = "valid"
    stride: tuple[int, int] = (1, 1)

    @property
    def reach(self) -> Reach | None:
        h = self.weights.shape[2]
        before = h // 2 if self.pad == "same" else 0
        return (before, h - 1 - before) if self.stride[0] == 1 else None

    def __call__(self, x: Array) -> Array:
        x = x[..., None] if x.ndim == 2 else x
        h, w = self.weights.shape[2:]
        if self.pad == "same":
            x = np.pad(x, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2), (0, 0)))
        elif self.pad != "valid":
            raise ValueError(f"no padding {self.pad!r}")
        windows = np.lib.stride_tricks.sliding_window_view(x, (h, w), axis=(0, 1))[:: self.stride[0], :: self.stride[1]]
        y = np.einsum("fbchw,cohw->fbo", windows, self.weights[:, :, ::-1, ::-1], optimize=True) + self.bias
        return self.activation(y) if self.activation else y


@dataclass(frozen=True)
class MaxPool:
    """Largest values of blocks, or over a whole axis."""

    size: tuple[int, int] = (1, 1)
    stride: tuple[int, int] | None = None
    axis: int | None = None

    @property
    def reach(self) -> Reach | None:
        if self.axis is not None:
            return (0, 0) if self.axis > 0 else None
        return (0, self.size[0] - 1) if (self.stride or self.size)[0] == 1 else None

    def __call__(self, x: Array) -> Array:
        if self.axis is not None:
            return x.max(self.axis)
        step = self.stride or self.size
        windows = np.lib.stride_tricks.sliding_window_view(x, self.size, axis=(0, 1))
        return windows[:: step[0], :: step[1]].max((-2, -1))


@dataclass(frozen=True)
class Pad:
    """``width`` more values at both ends of each axis: a constant, or the outermost ones where the value is None."""

    width: int
    axes: tuple[int, ...] = (0,)
    value: float | None = 0.0

    @property
    def reach(self) -> Reach | None:
        if min(self.axes, default=0) < 0:
            return None
        return (self.width, -self.width) if 0 in self.axes else (0, 0)

    def __call__(self, x: Array) -> Array:
        widths = [(self.width, self.width) if axis in self.axes else (0, 0) for axis in range(x.ndim)]
        return np.pad(x, widths, mode="edge") if self.value is None else np.pad(x, widths, constant_values=self.value)


@dataclass(frozen=True)
class Context:
    """Each frame with its neighbours side by side, zeros beyond the clip."""

    frames: int

    @property
    def reach(self) -> Reach:
        return self.frames // 2, self.frames - 1 - self.frames // 2

    def __call__(self, x: Array) -> Array:
        before = self.frames // 2
        wide = np.pad(x, ((before, self.frames - 1 - before), (0, 0)))
        return np.lib.stride_tricks.sliding_window_view(wide, self.frames, axis=0).swapaxes(1, 2).reshape(len(x), -1)


@dataclass(frozen=True)
class BatchNorm:
    beta: Array
    gamma: Array
    mean: Array
    inv_std: Array
    activation: Layer | None = None
    reach = (0, 0)

    def __call__(self, x: Array) -> Array:
        y = (x - self.mean) * (self.gamma * self.inv_std) + self.beta
        return self.activation(y) if self.activation else y


@dataclass(frozen=True)
class Means:
    """Means over runs of ``frames`` frames and over whole other axes."""

    frames: int = 1
    axes: tuple[int, ...] = (1,)

    @property
    def reach(self) -> Reach:
        return 0, self.frames - 1

    def __call__(self, x: Array) -> Array:
        return np.lib.stride_tricks.sliding_window_view(x.mean(self.axes), self.frames, axis=0).mean(-1)


@dataclass(frozen=True)
class Network:
    layers: tuple[Layer, ...]

    @property
    def reach(self) -> Reach | None:
        """Sum of the layers' reaches; None where one of them has none."""
        all_of = [getattr(layer, "reach", None) for layer in self.layers]
        return None if None in all_of else (sum(r[0] for r in all_of), sum(r[1] for r in all_of))

    def __call__(self, x: Array) -> Array:
        for layer in self.layers:
            x = layer(x)
        return x

    def start(self) -> Array:
        """State of all recurrent layers before the first frame."""
        return np.concatenate([np.zeros(0), *(layer.start() for layer in self.layers if hasattr(layer, "resume"))])

    def resume(self, x: Array, state: Array) -> tuple[Array, Array]:
        """Outputs of further frames and the state after them; every other layer looks at one frame at a time."""
        kept, at = [], 0
        for layer in self.layers:
            if hasattr(layer, "resume"):
                size = len(layer.start())
                x, after = layer.resume(x, state[at : at + size])
                kept.append(after)
                at += size
            elif getattr(layer, "reach", None) in ((0, 0), None) and not isinstance(layer, Bidirectional):
                x = layer(x)
            else:
                raise ValueError(f"a {type(layer).__name__} sees frames that are yet to come or gone")
        return x, np.concatenate([np.zeros(0), *kept])


@dataclass(frozen=True)
class Pooled:
    """Scores of a whole clip: ``head`` of the mean of the body's outputs over frames."""

    body: Layer
    head: Layer

    def __call__(self, x: Array) -> Array:
        out = np.asarray(self.body(x))
        return self.head(out.reshape(len(out), -1).mean(0, keepdims=True))


_OUTPUTS = "frame bigint, unit bigint, x double"


def run_networks(features: DataFrame, networks: list[Layer], block: int | None = None) -> DataFrame:
    """Outputs of an ensemble on features (track, frame, x array): (track, frame, unit, x), the mean over networks.

    Of pooled networks Spark averages the bodies' outputs. Networks of one reach run in blocks of ``block`` frames; frames are then consecutive from 0 unless the reach is
    none. Else a track and a network are one series: a task holds one clip at a time and runs one network. The outputs
    of a network that changes a clip's length are numbered from 0.
    """
    if all(isinstance(n, Pooled) for n in networks):
        return _run_pooled(features, networks, block)
    reaches = {getattr(n, "reach", None) for n in networks}
    if len(reaches) == 1 and None not in reaches:
        return _run_blocks(features, networks, *reaches.pop(), block or BLOCK)
    spread = features.select("track", "frame", "x").withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(len(networks))])))

    def run(c):
        out = np.asarray(networks[int(c["model"][0])](np.stack(c["x"]).astype(float)))
        out = out.reshape(len(out), -1)
        n, units = out.shape
        frames = c["frame"] if n == len(c["frame"]) else np.arange(n)
        return {"frame": np.repeat(frames, units), "unit": np.tile(np.arange(units), n), "x": out.ravel()}

    return average_predictions(map_series(spread, ["frame", "x", "model"], run, _OUTPUTS, ("track", "model")))


def _run_blocks(features: DataFrame, networks: list[Layer], left: int, right: int, block: int) -> DataFrame:
    """Every frame goes once to its block and to those that it reaches; a task runs all networks on a block.

    Output j depends on frames j - left to j + right. A block has left + right frames more before it, so that the last one
    is never shorter than what a network needs, and at least one more after it, by which the clip's end is known.
    """
    inner = left == right == 0
    before, after = (0, 0) if inner else (max(left + right, left, 0), max(right, 1))
    frame = F.col("frame")
    runs = F.sequence(F.greatest(F.floor((frame - after) / block), F.lit(0).cast("bigint")), F.floor((frame + before) / block))
    own = F.floor(frame / block)
    dealt = features.select("track", "frame", "x", F.explode(F.array(own) if inner else runs).alias("run"))

    def run(c):
        at, first = c["frame"], int(c["run"][0]) * block
        end = first + block
        if not ((at >= first) & (at < end)).any():  # only the neighbours of a block beyond the clip
            return {"frame": at[:0], "unit": at[:0], "x": np.zeros(0)}
        if not inner and at[-1] - at[0] + 1 != len(at):
            raise ValueError("frames must be consecutive")
        x = np.stack(c["x"]).astype(float)
        outputs = [np.asarray(network(x)) for network in networks]
        made = np.mean([out.reshape(len(out), -1) for out in outputs], 0)
        numbers = at if inner else at[0] + np.arange(len(made))
        kept = (numbers >= first) & ((numbers < end) | (at[-1] < end))
        made, numbers, units = made[kept], numbers[kept], made.shape[1]
        return {"frame": np.repeat(numbers, units), "unit": np.tile(np.arange(units), len(made)), "x": made.ravel()}

    return map_series(dealt, ["frame", "x", "run"], run, _OUTPUTS, ("track", "run")).drop("run")


def _run_pooled(features: DataFrame, networks: list[Pooled], block: int | None) -> DataFrame:
    def score(c):
        made = np.asarray(networks[int(c["model"][0])].head(c["x"][None, :].astype(float))).ravel()
        return {"frame": np.zeros(len(made), np.int64), "unit": np.arange(len(made)), "x": made}

    means = [average(run_networks(features, [n.body], block), ("track", "unit")).select("track", F.col("unit").alias("place"), "x", F.lit(i).alias("model")) for i, n in enumerate(networks)]
    return average_predictions(map_series(reduce(DataFrame.unionByName, means), ["x", "model"], score, _OUTPUTS, ("track", "model"), "place"))
