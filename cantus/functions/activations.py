"""Activation functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def linear(x: Column) -> Column:
    return x


def tanh(x: Column) -> Column:
    return F.tanh(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def elu(x: Column) -> Column:
    return F.when(x < 0, F.exp(x) - 1).otherwise(x)


def softmax(x: Column, rows: WindowSpec) -> Column:
    """Softmax over the rows of a window; exponents are shifted by the row's largest value."""
    shifted = F.exp(x - F.max(x).over(rows))
    return shifted / F.sum(shifted).over(rows)


def by_row(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


BY_NAME = {"linear": linear, "tanh": tanh, "sigmoid": sigmoid, "relu": relu, "elu": elu}
