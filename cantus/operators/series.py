"""Kernels over ordered series: what depends on the value before and has no expression of its own in Spark.

Spark deals series out by key and sorts them; a task then goes through its series one after the other, so it holds one
series at a time and a small one costs no group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import NumericType, StructField, StructType

Columns = dict[str, np.ndarray]
#: Values that a task gathers before it hands them over.
OUT_VALUES = 200_000


class Failures:
    """What went wrong in kernels that were planned while failures are kept: a table for each, made when asked for."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def table(self, spark: SparkSession) -> DataFrame:
        """(track, step, error): one row per step of a recording that failed; a recording's first error of a step stands for all."""
        none = spark.createDataFrame([], "track string, step string, error string")
        return reduce(DataFrame.unionByName, self.parts, none).groupBy("track", "step").agg(F.min("error").alias("error"))


_KEEPING: ContextVar[Failures | None] = ContextVar("keeping", default=None)


@contextmanager
def failures_kept() -> Iterator[Failures]:
    """Kernels planned in here leave out the series that they fail on, instead of ending the job, and list them."""
    token = _KEEPING.set(Failures())
    try:
        yield _KEEPING.get()
    finally:
        _KEEPING.reset(token)


def keeping() -> Failures | None:
    return _KEEPING.get()


def error_text(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def failure_batch(failed: list[tuple[str, str]], step: str) -> pa.RecordBatch:
    """Rows (track, step, error)."""
    columns = ([t for t, _ in failed], [step] * len(failed), [e for _, e in failed])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["track", "step", "error"])


def _starts(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """Rows whose key differs from that of the row before."""
    differs = np.zeros(batch.num_rows, bool)
    for key in keys:
        column = batch.column(key)
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            differs[1:] |= np.asarray([a != b for a, b in zip(values, values[1:])], bool)
        else:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            differs[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(differs)


def _series(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: list[str]) -> Iterator[tuple[tuple, Columns]]:
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        edges = [0, *_starts(batch, keys).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(batch.column(k)[lo].as_py() for k in keys)
            if held and key != current:
                yield current, {c: np.concatenate(v) for c, v in zip(columns, zip(*held))}
                held = []
            current = key
            held.append([v[lo:hi] for v in values])
    if held:
        yield current, {c: np.concatenate(v) for c, v in zip(columns, zip(*held))}


def tasks_for(df: DataFrame, per_task: int = 64 << 20) -> int:
    """Tasks for kernels over ``df``: as many as the session's shuffles have, more where the tables it reads are larger than that."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0  # a leaf of unknown size says the largest number there is
    return max(least, -(-total // per_task))


def map_series(df: DataFrame, columns: list[str], fn: Callable[[Columns], Columns], schema: str, keys: tuple[str, ...] = ("track",), order: str = "frame") -> DataFrame:
    """Apply ``fn`` to each series' columns in order; it returns the columns of ``schema``, of any common length."""
    added = StructType.fromDDL(schema)
    out = StructType([StructField(k, df.schema[k].dataType) for k in keys] + added.fields)
    arrow, width, failures = to_arrow_schema(out), len(keys), keeping()
    tolerant = failures is not None

    def run(batches):
        names, parts, held = [], [], 0

        def flush():
            lengths = [len(p[0]) for p in parts]
            at = pa.array(np.repeat(np.arange(len(names)), lengths))
            made = [pa.array([n[i] for n in names], arrow.types[i]).take(at) for i in range(width)]
            for i, kind in enumerate(arrow.types[width:]):
                values = np.concatenate([np.asarray(p[i]) for p in parts])
                if values.ndim == 2:  # a row of values becomes an array
                    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel())).cast(kind)
                made.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
            return pa.RecordBatch.from_arrays(made, schema=arrow)

        for key, values in _series(batches, keys, columns):
            try:
                result = fn(values)
            except Exception:
                if tolerant:
                    continue
                raise
            part = [result[f.name] for f in added.fields]
            if not len(part[0]):
                continue
            names.append(key)
            parts.append(part)
            held += sum(p.size if isinstance(p, np.ndarray) and p.ndim == 2 else len(p) for p in part)
            if held >= OUT_VALUES:
                yield flush()
                names, parts, held = [], [], 0
        if parts:
            yield flush()

    # a given number: tasks are sized for the kernel's work, so small partitions aren't merged
    dealt = df.select(*dict.fromkeys([*keys, order, *columns])).repartition(tasks_for(df), *keys).sortWithinPartitions(*keys, order)
    if tolerant:
        step = getattr(fn, "__qualname__", "kernel").replace(".<locals>", "")

        def fail(batches):
            failed = []
            for key, values in _series(batches, keys, columns):
                try:
                    fn(values)
                except Exception as error:
                    failed.append((str(key[0]), error_text(error)))
            yield failure_batch(failed, step)

        failures.parts.append(dealt.mapInArrow(fail, "track string, step string, error string"))
    return dealt.mapInArrow(run, out)


def scan_series(df: DataFrame, columns: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], schema: str, keys: tuple[str, ...] = ("track",), order: str = "block", descending: bool = False) -> DataFrame:
    """Carry a state along each series: ``step(state, row)`` gives the next state and the row's columns of ``schema``.

    For short tables of wide rows, such as one row per block of a series: a task holds a state and a row, not the series.
    """
    out = StructType([StructField(k, df.schema[k].dataType) for k in (*keys, order)] + StructType.fromDDL(schema).fields)
    arrow, names = to_arrow_schema(out), [f.name for f in out.fields]

    def run(batches):
        current, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() if not pa.types.is_list(batch.column(c).type) else batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in dict.fromkeys([*keys, order, *columns])}
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, start()
                state, made = step(state, row)
                made = {**{k: row[k] for k in (*keys, order)}, **made}
                yield pa.RecordBatch.from_arrays([pa.array([made[n]], t) for n, t in zip(names, arrow.types)], schema=arrow)

    ordered = df.select(*dict.fromkeys([*keys, order, *columns]))
    sort = [ordered[k] for k in keys] + [ordered[order].desc() if descending else ordered[order]]
    return ordered.repartition(tasks_for(df), *keys).sortWithinPartitions(*sort).mapInArrow(run, out)


def headed(rows: DataFrame, headers: DataFrame, columns: list[str], keys: tuple[str, ...], order: str = "frame", some: bool = False) -> DataFrame:
    """``rows`` with a row of ``headers`` (keys, ...) before each series' own; with ``some``, of the series that have one.

    Its columns are keys, order, columns and the headers' own; a kernel finds the header first and skips it for the rest.
    """
    own = [c for c in headers.columns if c not in keys]
    # a null would turn a column of whole numbers to fractions
    filler = lambda kind: F.lit(0 if isinstance(kind, NumericType) else None).cast(kind)
    kept = rows.join(headers.select(*keys), [*keys], "left_semi") if some else rows
    below = kept.select(*keys, order, *columns, *(filler(headers.schema[c].dataType).alias(c) for c in own))
    above = headers.select(*keys, F.lit(-(1 << 62)).cast("bigint").alias(order), *(filler(rows.schema[c].dataType).alias(c) for c in columns), *own)
    return below.unionByName(above)
