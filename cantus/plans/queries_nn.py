"""Queries on the neural-network runtime, with weights from a formula."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import activations
from ..operators import nn
from .registry import query, r6, s6
from .views import SPECTROGRAM
from .views import spectrogram as spec_view

S = f"WITH {SPECTROGRAM} "
RS = f"WITH RECURSIVE {SPECTROGRAM}, "


def weights(rows: int, columns: int, salt: int = 0) -> np.ndarray:
    i, j = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
    return ((i * 7 + j * 13 + salt * 3) % 11 - 5) / 10.0


def formula(i: str, j: str, salt: int = 0) -> str:
    return f"((({i} * 7 + {j} * 13 + {salt * 3}) % 11 - 5) / 10.0::DOUBLE)"


def rows_of(spark, sf, bins=64):
    return spec_view(spark, sf).filter(F.col("bin") < bins).select("track", "frame", F.col("bin").alias("unit"), F.col("mag").alias("x"))


def image_of(spark, sf):
    return spec_view(spark, sf).withColumnRenamed("mag", "x")


def arrays_of(spark, sf, bins):
    frames = spec_view(spark, sf).filter(F.col("bin") < bins).groupBy("track", "frame").agg(F.sort_array(F.collect_list(F.struct("bin", "mag"))).alias("s"))
    return frames.select("track", "frame", F.col("s.mag").alias("x"))


@query("activations", S + f", c AS (SELECT track, frame, bin, mag * 5 - 0.5 AS x FROM spec) SELECT track, frame, bin, {s6('tanh(x)')} AS tanh, {s6('1 / (1 + exp(-x))')} AS sigmoid, {s6('greatest(x, 0)')} AS relu, {s6('CASE WHEN x < 0 THEN exp(x) - 1 ELSE x END')} AS elu, {s6('exp(x) / sum(exp(x)) OVER (PARTITION BY track, frame)')} AS softmax FROM c")
def _(spark, sf):
    centred = spec_view(spark, sf).select("track", "frame", "bin", (F.col("mag") * 5 - 0.5).alias("x"))
    named = {n: r6(activations.BY_NAME[n](F.col("x"))) for n in ("tanh", "sigmoid", "relu", "elu")}
    named["softmax"] = r6(activations.softmax(F.col("x"), activations.by_row("track", "frame")))
    return centred.withColumns(named).drop("x")


@query("dense", S + f"SELECT track, frame, j AS unit, {s6(f'greatest(sum(mag * {formula('bin', 'j')}) + j / 10.0, 0)')} AS x FROM spec, range(0, 8) t(j) GROUP BY track, frame, j")
def _(spark, sf):
    return nn.dense(rows_of(spark, sf), weights(64, 8), np.arange(8) / 10, activations.relu).withColumn("x", r6("x"))


@query("batch_norm", S + f"SELECT track, frame, bin AS unit, {s6('(mag - 0.1) * (1.5 * 2.0) + 0.25')} AS x FROM spec")
def _(spark, sf):
    return nn.batch_norm(rows_of(spark, sf), 0.25, 1.5, 0.1, 2.0).withColumn("x", r6("x"))


@query("convolve", S + f"SELECT a.track, a.frame, a.bin, {s6(f'sum(b.mag * {formula('(2 - i)', '(2 - j)')}) + 0.1')} AS x FROM spec a JOIN range(0, 3) r(i) ON true JOIN range(0, 3) q(j) ON true JOIN spec b ON b.track = a.track AND b.frame = a.frame + i AND b.bin = a.bin + j GROUP BY 1, 2, 3 HAVING count(*) = 9")
def _(spark, sf):
    return nn.convolve(image_of(spark, sf), weights(3, 3), 0.1).withColumn("x", r6("x"))


@query("max_pool", S + f"SELECT track, frame // 2 AS frame, bin // 4 AS bin, {s6('max(mag)')} AS x FROM spec GROUP BY 1, 2, 3 HAVING count(*) = 8")
def _(spark, sf):
    return nn.max_pool(image_of(spark, sf), (2, 4)).withColumn("x", r6("x"))


@query("average_layer", S + f"SELECT track, bin, {s6('avg(mag)')} AS x FROM spec GROUP BY 1, 2")
def _(spark, sf):
    return nn.average(image_of(spark, sf), ("track", "bin")).withColumn("x", r6("x"))


@query("pad_layer", S + f", e AS (SELECT track, max(frame) AS hi FROM spec GROUP BY 1), u AS (SELECT track, frame + 2 AS frame, bin, mag AS x FROM spec UNION ALL SELECT s.track, 2 - i, bin, mag FROM spec s, range(1, 3) t(i) WHERE frame = 0 UNION ALL SELECT s.track, hi + 2 + i, bin, mag FROM spec s JOIN e USING (track), range(1, 3) t(i) WHERE frame = hi) SELECT track, frame, bin, {s6('x')} AS x FROM u")
def _(spark, sf):
    return nn.pad_frames(image_of(spark, sf), 2, None).withColumn("x", r6("x"))


@query("stride_layer", S + f"SELECT a.track, a.frame, k * 64 + b.bin AS unit, {s6('b.mag')} AS x FROM vec a JOIN range(0, 3) t(k) ON true JOIN spec b ON b.track = a.track AND b.frame = a.frame + k JOIN (SELECT track, max(frame) AS hi FROM vec GROUP BY 1) e ON e.track = a.track AND a.frame <= hi - 2")
def _(spark, sf):
    return nn.stride_blocks(image_of(spark, sf), 3, 64).withColumn("x", r6("x"))


@query("transpose_reshape", S + f"SELECT track, (bin * 1000000 + frame) // 50 AS frame, (bin * 1000000 + frame) % 50 AS bin, {s6('mag')} AS x FROM spec")
def _(spark, sf):
    return nn.reshape(nn.transpose(image_of(spark, sf)), 1_000_000, 50).withColumn("x", r6("x"))


@query("ensemble_average", S + f", o AS (SELECT track, frame, j, m, sum(mag * (((bin * 7 + j * 13 + m * 3) % 11 - 5) / 10.0::DOUBLE)) AS x FROM spec, range(0, 4) t(j), range(0, 3) u(m) GROUP BY 1, 2, 3, 4) SELECT track, frame, j AS unit, {s6('avg(x)')} AS x FROM o GROUP BY 1, 2, 3")
def _(spark, sf):
    networks = [nn.Network((nn.Dense(weights(64, 4, m), np.zeros(4)),)) for m in range(3)]
    return nn.run_networks(arrays_of(spark, sf, 64), networks).withColumn("x", r6("x"))


def _in(salt: int, unit: int) -> str:
    return f"i.a{salt}_{unit}"


def _rec(salt: int, unit: int) -> str:
    return " + ".join(f"p.h{k} * {float(weights(2, 2, salt)[k, unit])}" for k in range(2))


_INPUT = "i AS (SELECT track, frame, " + ", ".join(f"sum(mag * {formula('bin', str(u), k)}) AS a{k}_{u}" for k in (0, 2, 4, 6) for u in (0, 1)) + " FROM spec GROUP BY 1, 2)"
_START = "SELECT DISTINCT track, -1::BIGINT AS frame, 0.0::DOUBLE AS h0, 0.0::DOUBLE AS h1"
_STEP = "FROM p JOIN i ON i.track = p.track AND i.frame = p.frame + 1"
_UNITS = f"SELECT track, frame, 0::BIGINT AS unit, {s6('h0')} AS x FROM p WHERE frame >= 0 UNION ALL SELECT track, frame, 1, {s6('h1')} FROM p WHERE frame >= 0"


def _layer(salt: int, inputs: int = 64):
    return weights(inputs, 2, salt), np.array([0.1, -0.1]), weights(2, 2, salt + 1)


@query("rnn", RS + f"{_INPUT}, p(track, frame, h0, h1) AS ({_START} FROM i UNION ALL SELECT i.track, i.frame, " + ", ".join(f"tanh({_in(0, u)} + {b} + {_rec(1, u)})" for u, b in ((0, 0.1), (1, -0.1))) + f" {_STEP}) {_UNITS}")
def _(spark, sf):
    return nn.run_networks(arrays_of(spark, sf, 64), [nn.Recurrent(*_layer(0))]).withColumn("x", r6("x"))


_SIG = "(1 / (1 + exp(-({}))))"


def _gru_sql() -> str:
    units = []
    for u, b in ((0, 0.1), (1, -0.1)):
        r, z = _SIG.format(f"{_in(0, u)} + {b} + {_rec(1, u)}"), _SIG.format(f"{_in(2, u)} + {b} + {_rec(3, u)}")
        c = f"tanh({_in(4, u)} + {b} + {r} * ({_rec(5, u)}))"
        units.append(f"{z} * {c} + (1 - {z}) * p.h{u}")
    return RS + f"{_INPUT}, p(track, frame, h0, h1) AS ({_START} FROM i UNION ALL SELECT i.track, i.frame, {units[0]}, {units[1]} {_STEP}) {_UNITS}"


@query("gru", _gru_sql())
def _(spark, sf):
    return nn.run_networks(arrays_of(spark, sf, 64), [nn.Gru(_layer(0), _layer(2), _layer(4))]).withColumn("x", r6("x"))


def _lstm_sql() -> str:
    cells, outs = [], []
    for u, b in ((0, 0.1), (1, -0.1)):
        i, f = _SIG.format(f"{_in(0, u)} + {b} + {_rec(1, u)} + p.c{u} * 0.3"), _SIG.format(f"{_in(2, u)} + {b} + {_rec(3, u)} + p.c{u} * 0.2")
        cells.append(f"{f} * p.c{u} + {i} * tanh({_in(4, u)} + {b} + {_rec(5, u)})")
        outs.append(f"{_SIG.format(f'{_in(6, u)} + {b} + {_rec(7, u)} + ({cells[u]}) * -0.4')} * tanh({cells[u]})")
    return RS + f"{_INPUT}, p(track, frame, h0, h1, c0, c1) AS ({_START}, 0.0::DOUBLE, 0.0::DOUBLE FROM i UNION ALL SELECT i.track, i.frame, {', '.join(outs + cells)} {_STEP}) {_UNITS}"


@query("lstm", _lstm_sql())
def _(spark, sf):
    peep = (np.full(2, 0.3), np.full(2, 0.2), None, np.full(2, -0.4))
    gates = tuple((*_layer(2 * g), peep[g]) for g in range(4))
    return nn.run_networks(arrays_of(spark, sf, 64), [nn.Lstm(gates)]).withColumn("x", r6("x"))


def _tanh_units(salt: int, name: str) -> str:
    return ", ".join(f"tanh({_in(salt, u)} + {b} + {_rec(salt + 1, u).replace('p.', name + '.')})" for u, b in ((0, 0.1), (1, -0.1)))


@query(
    "bidirectional_rnn",
    RS + f"{_INPUT}, p(track, frame, h0, h1) AS ({_START} FROM i UNION ALL SELECT i.track, i.frame, {_tanh_units(0, 'p')} {_STEP}), "
    f"q(track, frame, h0, h1) AS (SELECT track, max(frame) + 1, 0.0::DOUBLE, 0.0::DOUBLE FROM i GROUP BY 1 UNION ALL SELECT i.track, i.frame, {_tanh_units(2, 'q')} FROM q JOIN i ON i.track = q.track AND i.frame = q.frame - 1) "
    f"{_UNITS} UNION ALL SELECT q.track, q.frame, u + 2, {s6('CASE WHEN u = 0 THEN q.h0 ELSE q.h1 END')} FROM q JOIN i ON i.track = q.track AND i.frame = q.frame, range(0, 2) t(u)",
)
def _(spark, sf):
    return nn.run_networks(arrays_of(spark, sf, 64), [nn.Bidirectional(nn.Recurrent(*_layer(0)), nn.Recurrent(*_layer(2)))]).withColumn("x", r6("x"))


@query(
    "convolutional_network",
    S + f", c1 AS (SELECT track, frame - i AS frame, bin - j AS bin, o, sum((mag - 0.1) * 2.0 * (((2 - i) * 7 + (2 - j) * 13 + o * 3) % 11 - 5) / 10.0::DOUBLE) AS x FROM spec, range(0, 3) a(i), range(0, 3) b(j), range(0, 4) c(o) GROUP BY 1, 2, 3, 4 HAVING count(*) = 9), "
    "pl AS (SELECT track, frame, bin // 2 AS bin, o AS c, max(CASE WHEN x < 0 THEN exp(x) - 1 ELSE x END) AS x FROM c1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 2), "
    "pg AS (SELECT DISTINCT track, frame, bin FROM pl), "
    "c2 AS (SELECT pg.track, pg.frame, pg.bin, r.o, sum(x * r.w) AS x FROM (SELECT track, frame + 1 - i AS frame, bin + 1 - j AS bin, o, (((2 - i) * 7 + (2 - j) * 13 + (c + o) * 3) % 11 - 5) / 10.0::DOUBLE AS w, x FROM pl, range(0, 3) a(i), range(0, 3) b(j), range(0, 2) d(o)) r JOIN pg ON pg.track = r.track AND pg.frame = r.frame AND pg.bin = r.bin GROUP BY 1, 2, 3, 4), "
    f"mn AS (SELECT track, o, avg(greatest(x, 0)) AS x FROM c2 GROUP BY 1, 2) SELECT track, 0::BIGINT AS frame, o AS unit, {s6('exp(x) / sum(exp(x)) OVER (PARTITION BY track)')} AS x FROM mn",
)
def _(spark, sf):
    first, second = np.stack([np.stack([weights(3, 3, o) for o in range(4)])]), np.stack([np.stack([weights(3, 3, c + o) for o in range(2)]) for c in range(4)])
    body = nn.Network((nn.BatchNorm(0.0, 1.0, 0.1, 2.0), nn.Conv(first, np.zeros(4), nn.elu), nn.MaxPool((1, 2)), nn.Conv(second, np.zeros(2), nn.relu, "same"), nn.Means()))
    return nn.run_networks(arrays_of(spark, sf, 64), [nn.Pooled(body, nn.softmax)]).withColumn("x", r6("x"))
