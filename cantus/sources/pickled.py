"""Model files in the pickle format, read without running them.

The opcodes are interpreted over plain values: names of classes and functions stay names, and only those of the list
below are known. Arrays are built from their bytes, objects become records of their fields, and records of known layers
become the layers of ``operators.nn``. No class is imported and nothing in a file is called; any other name, and any
opcode that would do more than describe data, is an error.
"""

from __future__ import annotations

import pickletools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import nn, sequence

# Where a name may come from, the package's own name left open, and the names of each place.
KNOWN = {
    r"\w+\.ml\.nn": ("NeuralNetwork",),
    r"\w+\.ml\.nn\.layers": (
        "FeedForwardLayer", "RecurrentLayer", "BidirectionalLayer", "Gate", "Cell", "LSTMLayer", "GRUCell", "GRULayer", "ConvolutionalLayer", "MaxPoolLayer",
        "BatchNormLayer", "PadLayer", "AverageLayer", "StrideLayer", "TransposeLayer", "ReshapeLayer", "Layer",
    ),
    r"\w+\.ml\.nn\.activations": ("linear", "tanh", "sigmoid", "relu", "elu", "softmax"),
    r"\w+\.ml\.crf": ("ConditionalRandomField",),
    r"\w+\.ml\.gmm": ("GMM",),
    r"\w+\.processors": ("SequentialProcessor", "ParallelProcessor"),
    r"numpy(\._?core\.multiarray)?": ("_reconstruct", "scalar", "ndarray", "dtype"),
    r"numpy(\.lib\.(shape_base|_shape_base_impl))?": ("dstack",),
    r"copy_reg|copyreg": ("_reconstructor",),
    r"__builtin__|builtins": ("object",),
    r"_codecs": ("encode",),
    r"itertools": ("imap",),
}


class UnknownName(ValueError):
    """A file names something that model files don't need."""


@dataclass(frozen=True)
class Name:
    name: str


@dataclass
class Record:
    """An object as its class's name and its fields."""

    kind: str
    fields: dict = field(default_factory=dict)


@dataclass
class _Dtype:
    code: str
    order: str = "|"

    def of(self) -> np.dtype:
        if "O" in self.code or self.code[:1] in "VUS" or not re.fullmatch(r"[<>|=]?[biufc?]\d*", self.code):
            raise ValueError(f"arrays of {self.code!r} are no model's")
        kind = np.dtype(self.code)
        return kind.newbyteorder(self.order) if self.order in "<>" else kind


@dataclass
class _Array:
    value: np.ndarray | None = None


def _name(module: str, name: str) -> Name:
    if not any(re.fullmatch(place, module) and name in names for place, names in KNOWN.items()):
        raise UnknownName(f"{module}.{name} is not part of a model file")
    return Name(name)


def _bytes(x) -> bytes:
    return x.encode("latin1") if isinstance(x, str) else bytes(x)


def _called(what, args: tuple):
    """What a construction describes; nothing but the listed ones is understood."""
    if not isinstance(what, Name):
        raise UnknownName(f"{what!r} can't be called")
    if what.name == "_reconstruct":
        return _Array()
    if what.name == "dtype":
        return _Dtype(str(args[0]))
    if what.name == "scalar":
        return np.frombuffer(_bytes(args[1]), args[0].of())[0]
    if what.name == "encode":
        return args[0].encode("latin1")
    if what.name == "_reconstructor":
        return Record(args[0].name)
    if what.name[0].isupper() and not args:
        return Record(what.name)
    raise UnknownName(f"{what.name} can't be called with {len(args)} values")


def _built(thing, state) -> None:
    if isinstance(thing, _Array):
        _, shape, kind, by_columns, raw = state
        values = np.frombuffer(_bytes(raw), kind.of())
        thing.value = values.reshape(shape, order="F" if by_columns else "C").copy()
    elif isinstance(thing, _Dtype):
        thing.order = state[1]
    elif isinstance(thing, Record):
        for part in state if isinstance(state, tuple) else (state,):
            thing.fields.update(part or {})
    else:
        raise ValueError(f"a {type(thing).__name__} has no state")


_MARK = object()
_PLAIN = {
    "BININT", "BININT1", "BININT2", "INT", "LONG", "LONG1", "LONG4", "FLOAT", "BINFLOAT", "STRING", "BINSTRING", "SHORT_BINSTRING", "UNICODE", "BINUNICODE", "SHORT_BINUNICODE",
    "BINUNICODE8", "BINBYTES", "SHORT_BINBYTES", "BINBYTES8", "BYTEARRAY8",
}
_FIXED = {"NONE": lambda: None, "NEWTRUE": lambda: True, "NEWFALSE": lambda: False, "EMPTY_TUPLE": tuple, "EMPTY_LIST": list, "EMPTY_DICT": dict}


def interpret(data: bytes):
    """The value that a pickle describes, with records, names and arrays."""
    stack: list = []
    memo: dict[int, object] = {}

    def marked() -> list:
        at = max(i for i, x in enumerate(stack) if x is _MARK)
        items = stack[at + 1 :]
        del stack[at:]
        return items

    def pairs(items: list) -> dict:
        return dict(zip(items[::2], items[1::2]))

    def pop(n: int) -> list:
        items = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        return items

    for op, arg, _ in pickletools.genops(data):
        code = op.name
        if code in _PLAIN:
            stack.append(arg)
        elif code in _FIXED:
            stack.append(_FIXED[code]())
        elif code == "MARK":
            stack.append(_MARK)
        elif code in ("PROTO", "FRAME"):
            pass
        elif code == "STOP":
            return _resolved(stack.pop(), {})
        elif code == "GLOBAL":
            stack.append(_name(*arg.split(" ", 1)))
        elif code == "STACK_GLOBAL":
            stack.append(_name(*pop(2)))
        elif code in ("PUT", "BINPUT", "LONG_BINPUT"):
            memo[arg] = stack[-1]
        elif code == "MEMOIZE":
            memo[len(memo)] = stack[-1]
        elif code in ("GET", "BINGET", "LONG_BINGET"):
            stack.append(memo[arg])
        elif code in ("TUPLE1", "TUPLE2", "TUPLE3"):
            stack.append(tuple(pop(int(code[-1]))))
        elif code == "TUPLE":
            stack.append(tuple(marked()))
        elif code == "LIST":
            stack.append(marked())
        elif code == "DICT":
            stack.append(pairs(marked()))
        elif code == "APPEND":
            (item,) = pop(1)
            stack[-1].append(item)
        elif code == "APPENDS":
            items = marked()
            stack[-1].extend(items)
        elif code == "SETITEM":
            key, value = pop(2)
            stack[-1][key] = value
        elif code == "SETITEMS":
            items = marked()
            stack[-1].update(pairs(items))
        elif code in ("REDUCE", "NEWOBJ"):
            what, args = pop(2)
            stack.append(_called(what, args))
        elif code == "BUILD":
            (state,) = pop(1)
            _built(stack[-1], state)
        elif code == "POP":
            stack.pop()
        elif code == "POP_MARK":
            marked()
        elif code == "DUP":
            stack.append(stack[-1])
        else:
            raise UnknownName(f"opcode {code} is not part of a model file")
    raise ValueError("the file ends before its value")


def _resolved(x, done: dict[int, object]):
    """The same value with arrays in place; what is shared stays shared."""
    if id(x) in done:
        return done[id(x)]
    if isinstance(x, _Array):
        if x.value is None:
            raise ValueError("an array without contents")
        return done.setdefault(id(x), x.value)
    if isinstance(x, Record):
        done[id(x)] = made = Record(x.kind)
        made.fields.update({k: _resolved(v, done) for k, v in x.fields.items()})
        return made
    if isinstance(x, dict):
        return {k: _resolved(v, done) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return type(x)(_resolved(v, done) for v in x)
    return x


# --- records to layers ----------------------------------------------------------------------------------------------

_ACTIVATIONS = {"linear": None, "tanh": np.tanh, "sigmoid": nn.sigmoid, "relu": nn.relu, "elu": nn.elu, "softmax": nn.softmax}


@dataclass(frozen=True)
class Mean:
    axis: int | tuple[int, ...] | None = None
    keepdims: bool = False

    def __call__(self, x):
        return x.mean(self.axis, keepdims=self.keepdims)


@dataclass(frozen=True)
class Blocks:
    """Each run of ``length`` frames as one row."""

    length: int

    def __call__(self, x):
        return np.lib.stride_tricks.sliding_window_view(x, self.length, axis=0).swapaxes(1, -1).reshape(len(x) - self.length + 1, -1)


@dataclass(frozen=True)
class Turned:
    axes: tuple[int, ...] | None = None

    def __call__(self, x):
        return x.transpose(self.axes)


@dataclass(frozen=True)
class Shaped:
    shape: tuple[int, ...]
    order: str = "C"

    def __call__(self, x):
        return x.reshape(self.shape, order=self.order)


@dataclass(frozen=True)
class Fanned:
    """The results of several networks on the same input."""

    branches: tuple[nn.Layer, ...]

    def __call__(self, x):
        return [b(x) for b in self.branches]


def _activation(of: Record, name: str = "activation_fn"):
    given = of.fields.get(name)
    return None if given is None else _ACTIVATIONS[given.name]


def _only(of: Record, name: str) -> None:
    given = of.fields.get("activation_fn")
    if given is not None and given.name != name:
        raise ValueError(f"{of.kind} with {given.name} in place of {name}")


def _parts(of: Record) -> tuple:
    return of.fields["weights"], np.ravel(of.fields["bias"]), of.fields["recurrent_weights"]


def _gates(of: Record, names: tuple[str, ...]) -> list[Record]:
    gates = [of.fields[n] for n in names]
    for name, gate in zip(names, gates):
        _only(gate, "tanh" if name == "cell" else "sigmoid")
    return gates


def _lstm(of: Record) -> nn.Lstm:
    _only(of, "tanh")
    gates = _gates(of, ("input_gate", "forget_gate", "cell", "output_gate"))
    return nn.Lstm(tuple((*_parts(g), g.fields.get("peephole_weights")) for g in gates), of.fields.get("init"), of.fields.get("cell_init"))


def _gru(of: Record) -> nn.Gru:
    # an older name of the same field goes first
    return nn.Gru(*(_parts(g) for g in _gates(of, ("reset_gate", "update_gate", "cell"))), of.fields.get("hid_init", of.fields.get("init")))


def _stacked(x):
    return np.dstack(x)


def _mixture(of: Record) -> sequence.Mixture:
    weights, means, covars = (of.fields.get(f"{n}_", of.fields.get(n)) for n in ("weights", "means", "covars"))
    return sequence.Mixture(weights, means, covars, of.fields.get("covariance_type", "diag"))


_LAYERS: dict[str, Callable[[Record], object]] = {
    "NeuralNetwork": lambda r: nn.Network(tuple(layers_of(r.fields["layers"]))),
    "SequentialProcessor": lambda r: nn.Network(tuple(layers_of(r.fields["processors"]))),
    "ParallelProcessor": lambda r: Fanned(tuple(layers_of(r.fields["processors"]))),
    "FeedForwardLayer": lambda r: nn.Dense(r.fields["weights"], np.ravel(r.fields["bias"]), _activation(r)),
    "RecurrentLayer": lambda r: nn.Recurrent(*_parts(r), _activation(r) or (lambda x: x), r.fields.get("init")),
    "BidirectionalLayer": lambda r: nn.Bidirectional(layers_of(r.fields["fwd_layer"]), layers_of(r.fields["bwd_layer"])),
    "LSTMLayer": _lstm,
    "GRULayer": _gru,
    "ConvolutionalLayer": lambda r: nn.Conv(r.fields["weights"], np.ravel(r.fields["bias"]), _activation(r), r.fields.get("pad", "valid"), _pair(r.fields.get("stride")) or (1, 1)),
    "MaxPoolLayer": lambda r: nn.MaxPool(_pair(r.fields.get("size")) or (1, 1), _pair(r.fields.get("stride")), r.fields.get("axis")),
    "BatchNormLayer": lambda r: nn.BatchNorm(*(r.fields[n] for n in ("beta", "gamma", "mean", "inv_std")), _activation(r)),
    "PadLayer": lambda r: nn.Pad(r.fields["width"], tuple(r.fields["axes"]), r.fields.get("value", 0.0)),
    "AverageLayer": lambda r: Mean(_axes(r.fields.get("axis")), bool(r.fields.get("keepdims", False))),
    "StrideLayer": lambda r: Blocks(r.fields["block_size"]),
    "TransposeLayer": lambda r: Turned(_axes(r.fields.get("axes"))),
    "ReshapeLayer": lambda r: Shaped(_axes(r.fields["newshape"]), r.fields.get("order", "C")),
    "ConditionalRandomField": lambda r: sequence.ConditionalRandomField(*(r.fields[n] for n in ("pi", "tau", "c", "A", "W"))),
    "GMM": _mixture,
}


def _pair(x) -> tuple[int, int] | None:
    return None if x is None else (int(x), int(x)) if np.ndim(x) == 0 else tuple(int(v) for v in x)


def _axes(x):
    return tuple(x) if isinstance(x, (list, tuple)) else x


def layers_of(x):
    """Records as layers and models; lists and dictionaries of them keep their form."""
    if isinstance(x, Record):
        if x.kind not in _LAYERS:
            raise UnknownName(f"a {x.kind} is no layer by itself")
        return _LAYERS[x.kind](x)
    if isinstance(x, Name):
        return _stacked if x.name == "dstack" else _ACTIVATIONS.get(x.name)
    if isinstance(x, dict):
        return {k: layers_of(v) for k, v in x.items()}
    return [layers_of(v) for v in x] if isinstance(x, (list, tuple)) else x


def load_pickled(spark: SparkSession, path: str, sha256: str | None = None):
    """The model of one file, as layers; a wrong digest raises before anything is read from it. A model has a fixed size and is read on the driver."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest")).first()
    if sha256 and row["digest"] != sha256:
        raise ValueError(f"{path} has digest {row['digest']}")
    return layers_of(interpret(bytes(row["content"])))
