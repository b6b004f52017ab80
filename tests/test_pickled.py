"""Pickled models are read as data: each layer round trips, and nothing else gets in."""

import hashlib
import os
import pickle
import subprocess
import sys
import types

import numpy as np
import pytest

from cantus.operators import nn
from cantus.sources import pickled

RNG = np.random.default_rng(1)
KINDS = {"ml.nn": ["NeuralNetwork"], "ml.nn.layers": ["FeedForwardLayer", "RecurrentLayer", "BidirectionalLayer", "Gate", "Cell", "LSTMLayer", "GRUCell", "GRULayer", "ConvolutionalLayer", "MaxPoolLayer", "BatchNormLayer", "PadLayer", "AverageLayer", "StrideLayer", "TransposeLayer", "ReshapeLayer"], "ml.crf": ["ConditionalRandomField"], "ml.gmm": ["GMM"], "processors": ["SequentialProcessor", "ParallelProcessor"]}


@pytest.fixture
def made(monkeypatch):
    """Classes and functions of the expected names in a package that exists while a file is written only."""
    for place in ("somewhere", "somewhere.ml", "somewhere.ml.nn.activations", *(f"somewhere.{p}" for p in KINDS)):
        monkeypatch.setitem(sys.modules, place, types.ModuleType(place))
    kinds = {}
    for place, names in KINDS.items():
        for name in names:
            kinds[name] = type(name, (), {"__module__": f"somewhere.{place}"})
            setattr(sys.modules[f"somewhere.{place}"], name, kinds[name])
    for name in ("tanh", "sigmoid", "relu", "linear", "softmax", "elu"):
        function = types.FunctionType((lambda x: x).__code__, {})
        function.__module__, function.__qualname__, function.__name__ = "somewhere.ml.nn.activations", name, name
        setattr(sys.modules["somewhere.ml.nn.activations"], name, function)
        kinds[name] = function

    def make(kind, **fields):
        thing = kinds[kind]()
        thing.__dict__.update({k: kinds[v] if k == "activation_fn" and v else v for k, v in fields.items()})
        return thing

    return make


def w(*shape):
    return RNG.normal(size=shape).astype("f4")


def gate(make, inputs, size, kind="Gate", activation="sigmoid", peephole=False):
    extra = {"peephole_weights": w(size)} if peephole else {}
    return make(kind, weights=w(inputs, size), bias=w(size), recurrent_weights=w(size, size), activation_fn=activation, **extra)


def parts(g):
    return g.weights, g.bias, g.recurrent_weights


def cases(make):
    frames, image = RNG.normal(size=(9, 4)), RNG.normal(size=(9, 8, 2))
    dense = make("FeedForwardLayer", weights=w(4, 3), bias=w(1, 3), activation_fn="softmax")
    recurrent = lambda: make("RecurrentLayer", weights=w(4, 3), bias=w(3), recurrent_weights=w(3, 3), activation_fn="tanh", init=w(3))
    one, two = recurrent(), recurrent()
    as_recurrent = lambda r: nn.Recurrent(r.weights, r.bias, r.recurrent_weights, np.tanh, r.init)
    i, f, o = (gate(make, 4, 2, peephole=True) for _ in range(3))
    c = gate(make, 4, 2, "Cell", "tanh")
    lstm = make("LSTMLayer", input_gate=i, forget_gate=f, cell=c, output_gate=o, activation_fn="tanh", init=w(2), cell_init=w(2))
    r, u, g = gate(make, 4, 2), gate(make, 4, 2), gate(make, 4, 2, "GRUCell", "tanh")
    gru = make("GRULayer", reset_gate=r, update_gate=u, cell=g, hid_init=w(2))
    conv = make("ConvolutionalLayer", weights=w(2, 3, 3, 3), bias=w(3), stride=None, pad="valid", activation_fn="relu")
    norm = make("BatchNormLayer", beta=np.float32(0.5), gamma=np.float32(2.0), mean=w(2), inv_std=w(2), activation_fn=None)
    return [
        (dense, frames, nn.Dense(dense.weights, dense.bias.ravel(), nn.softmax)),
        (one, frames, as_recurrent(one)),
        (make("BidirectionalLayer", fwd_layer=one, bwd_layer=two), frames, nn.Bidirectional(as_recurrent(one), as_recurrent(two))),
        (lstm, frames, nn.Lstm(tuple((*parts(x), getattr(x, "peephole_weights", None)) for x in (i, f, c, o)), lstm.init, lstm.cell_init)),
        (gru, frames, nn.Gru(parts(r), parts(u), parts(g), gru.hid_init)),
        (conv, image, nn.Conv(conv.weights, conv.bias, nn.relu)),
        (make("MaxPoolLayer", size=(1, 2), stride=None, axis=None), image, nn.MaxPool((1, 2))),
        (norm, image, nn.BatchNorm(0.5, 2.0, norm.mean, norm.inv_std)),
        (make("PadLayer", width=2, axes=(0, 1), value=1.5), image, nn.Pad(2, (0, 1), 1.5)),
        (make("AverageLayer", axis=1, dtype=None, keepdims=False), image, lambda x: x.mean(1)),
        (make("StrideLayer", block_size=3), frames, lambda x: np.stack([x[k : k + 3].ravel() for k in range(len(x) - 2)])),
        (make("TransposeLayer", axes=(2, 0, 1)), image, lambda x: x.transpose(2, 0, 1)),
        (make("ReshapeLayer", newshape=(-1, 6), order="F"), frames, lambda x: x.reshape((-1, 6), order="F")),
        (make("NeuralNetwork", layers=[one, make("FeedForwardLayer", weights=np.asfortranarray(w(3, 2)), bias=w(2), activation_fn="sigmoid")]), frames, None),
    ]


@pytest.mark.parametrize("protocol", range(5))
def test_layers_round_trip(made, protocol):
    for thing, x, want in cases(made):
        layer = pickled.layers_of(pickled.interpret(pickle.dumps(thing, protocol)))
        if want is None:
            first, second = thing.layers
            want = nn.Network((nn.Recurrent(first.weights, first.bias, first.recurrent_weights, np.tanh, first.init), nn.Dense(second.weights, second.bias, nn.sigmoid)))
        assert np.array_equal(layer(x), want(x)), type(thing).__name__


@pytest.mark.parametrize("protocol", [0, 2, 4])
def test_models_round_trip(made, protocol):
    crf = made("ConditionalRandomField", pi=w(3), tau=w(3), c=w(3), A=w(3, 3), W=w(4, 3))
    gmm = made("GMM", weights_=w(2), means_=w(2, 3), covars_=w(2, 3, 3), covariance_type="full")
    heads = made("ParallelProcessor", processors=[made("FeedForwardLayer", weights=w(4, 2), bias=w(2), activation_fn="linear") for _ in range(2)])
    graph = made("SequentialProcessor", processors=[heads, np.dstack])
    got = pickled.layers_of(pickled.interpret(pickle.dumps({"crf": crf, "gmms": [gmm], "graph": graph, "num_beats": 3, "same": [crf, crf]}, protocol)))
    assert np.array_equal(got["crf"].transition, crf.A) and np.array_equal(got["crf"].initial, crf.pi) and np.array_equal(got["crf"].observation, crf.W)
    assert np.array_equal(got["gmms"][0].covars, gmm.covars_) and got["gmms"][0].kind == "full" and got["num_beats"] == 3
    x = RNG.normal(size=(5, 4))
    assert np.array_equal(got["graph"](x), np.dstack([x @ h.weights + h.bias for h in heads.processors]))


class Evil:
    def __init__(self, function, *args):
        self.call = function, args

    def __reduce__(self):
        return self.call


@pytest.mark.parametrize("protocol", range(6))
def test_everything_else_is_refused(tmp_path, protocol):
    target = tmp_path / "ran"
    for thing in (Evil(os.system, f"touch {target}"), Evil(eval, "1"), Evil(getattr, 1, "real"), Evil(subprocess.call, ["touch", str(target)]), Evil(np.save, str(target), 1), Evil(open, str(target), "w"), [Evil(exec, "1")], os.path.join, complex(1, 2), {1}):
        with pytest.raises((pickled.UnknownName, ValueError)):
            pickled.interpret(pickle.dumps(thing, protocol))
    assert not target.exists()


def test_known_names_do_no_more_than_they_should():
    for body in (b"cnumpy\nndarray\n(I5\ntR.", b"c__builtin__\nobject\n(tR.", b"cnumpy\ndstack\n((lt)R.", b"citertools\nimap\n(I1\ntR.", b"ca.b.ml.nn.layers\nGate\n.", b"cnumpy.core\ndtype\n.", b"cnumpy\nload\n.", b"(I1\nI2\n", b"Pid\n."):
        with pytest.raises((pickled.UnknownName, ValueError, IndexError)):
            pickled.interpret(body)
    with pytest.raises(ValueError):
        pickled.interpret(pickle.dumps(np.asarray([object()], object), 2))
    with pytest.raises(pickled.UnknownName):
        pickled.layers_of(pickled.Record("Gate"))


def test_files_are_checked_before_they_are_read(spark, tmp_path, made):
    data = pickle.dumps(made("StrideLayer", block_size=2), 2)
    (tmp_path / "m.pkl").write_bytes(data)
    path = str(tmp_path / "m.pkl")
    assert pickled.load_pickled(spark, path, hashlib.sha256(data).hexdigest()) == pickled.Blocks(2)
    with pytest.raises(ValueError, match="digest"):
        pickled.load_pickled(spark, path, "0" * 64)
