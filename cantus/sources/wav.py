"""WAV files as sample tables.

Spark lists the files without their contents. Tasks read the headers, cut each file's data into ranges of bytes between
``start`` and ``stop``, and deal the ranges out by their size, so a file of any length is many tasks and only what is
asked for is read. Stores that only Spark reaches are read through its binaryFile source, a file as a whole (up to 2 GB).
"""

from __future__ import annotations

import io
import struct
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import error_text, failure_batch, keeping, tasks_for

#: Frames of a chunk, bytes of a range, and bytes of ranges that a task reads.
CHUNK, RANGE_BYTES, TASK_BYTES = 1 << 16, 4 << 20, 64 << 20
#: Stores that workers open by themselves; others go through Spark.
DIRECT = ("", "file", "hdfs", "s3", "s3a", "gs")

_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


def read_header(file: BinaryIO, size: int) -> tuple[int, int, int, int, int, int]:
    """(rate, channels, format, bits, place of the data, bytes of data) of a WAV file of ``size`` bytes; large ones are RF64."""
    top = file.read(12)
    if top[:4] not in (b"RIFF", b"RF64") or top[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, large = 12, None, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(min(length, 40))
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            form = rate, channels, struct.unpack_from("<H", body, 24)[0] if code == _EXTENSIBLE else code, bits
        elif name == b"ds64":
            large = struct.unpack("<QQ", file.read(16))[1]
        elif name == b"data":
            if form is None:
                raise ValueError("a WAV file's format comes before its data")
            if (form[2], form[3]) not in _KINDS:
                raise ValueError(f"no reader for format {form[2]} with {form[3]} bits")
            if length == 0xFFFFFFFF:  # the length is elsewhere, or was unknown when the file was written
                length = size if large is None else large
            return (*form, at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without data")


_KINDS = {(_PCM, 8): "u1", (_PCM, 16): "<i2", (_PCM, 24): "<i4", (_PCM, 32): "<i4", (_FLOAT, 32): "<f4", (_FLOAT, 64): "<f8"}


def decode(raw: bytes, channels: int, code: int, bits: int) -> np.ndarray:
    """Whole frames (frames, channels) in the file's own type; 24-bit samples fill 32 bits from the top."""
    whole = memoryview(raw)[: len(raw) // (bits // 8 * channels) * (bits // 8 * channels)]
    if bits == 24:
        packed = np.frombuffer(whole, np.uint8).reshape(-1, 3)
        wide = np.zeros((len(packed), 4), np.uint8)
        wide[:, 1:] = packed
        return wide.view("<i4").reshape(-1, channels)
    return np.frombuffer(whole, _KINDS[code, bits]).reshape(-1, channels)


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (frames, channels) of a file's bytes."""
    rate, channels, code, bits, at, length = read_header(io.BytesIO(data), len(data))
    return rate, decode(data[at : at + length], channels, code, bits)


def build_wav(rate: int, samples: np.ndarray) -> bytes:
    samples = samples[:, None] if samples.ndim == 1 else samples
    code = _FLOAT if samples.dtype.kind == "f" else _PCM
    body = np.ascontiguousarray(samples).astype(samples.dtype.newbyteorder("<")).tobytes()
    width = samples.dtype.itemsize
    form = struct.pack("<HHIIHH", code, samples.shape[1], rate, rate * samples.shape[1] * width, samples.shape[1] * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


def read_wav(spark: SparkSession, path: str, start: float | None = None, stop: float | None = None, sample_rate: int | None = None, scale: bool = True) -> DataFrame:
    """(track = path, sample_rate, n, ch, x) of WAV files, between ``start`` and ``stop`` seconds.

    ``scale`` gives fractions of full scale for whole-number samples. A file of another rate than ``sample_rate`` is an
    error; resampling is an operator of its own.
    """
    chunks = read_chunks(spark, path, start, stop, sample_rate, scale)
    frames = chunks.select("track", "sample_rate", "channels", "first", F.posexplode("samples").alias("_i", "x"))
    place = F.col("first") + F.expr("_i div channels")
    return frames.select("track", "sample_rate", place.alias("n"), F.expr("_i % channels").cast("int").alias("ch"), F.col("x").cast("double").alias("x"))


def _open(path: str) -> BinaryIO:
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open("/" + (rest or path).lstrip("/"), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(name)


def _full_scale(samples: np.ndarray, scale: bool) -> int:
    return np.iinfo(samples.dtype).max if samples.dtype.kind in "iu" and scale else 1


def _chunks(name: str, rate: int, samples: np.ndarray, first: int, scale: bool):
    for at in range(0, len(samples), CHUNK):
        part = samples[at : at + CHUNK].astype(np.float64).ravel() / _full_scale(samples, scale)
        columns = [pa.array([name]), pa.array([rate], pa.int32()), pa.array([samples.shape[1]], pa.int32()), pa.array([first + at], pa.int64()), pa.array([part], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["track", "sample_rate", "channels", "first", "samples"])


_CHUNK_ROW = "track string, sample_rate int, channels int, first bigint, samples array<double>"
_RANGE_ROW = "path string, rate int, channels int, code int, bits int, place bigint, first bigint, frames bigint"


def read_chunks(spark: SparkSession, path: str, start: float | None = None, stop: float | None = None, sample_rate: int | None = None, scale: bool = True) -> DataFrame:
    """(track, sample_rate, channels, first, samples): interleaved samples from frame ``first`` after ``start`` on.

    A broken file ends the job, unless failures are kept (``series.failures_kept``): then it is left out and listed.
    """
    failures = keeping()
    tolerant = failures is not None
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)

    def span(rate: int, frames: int, name: str) -> tuple[int, int]:
        if sample_rate is not None and rate != sample_rate:
            raise NotImplementedError(f"{name} has a rate of {rate}, not {sample_rate}")
        return min(frames, int((start or 0) * rate)), frames if stop is None else min(frames, int(stop * rate))

    def whole(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rate, samples = parse_wav(content)
                    lo, hi = span(rate, len(samples), name)
                except Exception:
                    if tolerant:
                        continue
                    raise
                yield from _chunks(name, rate, samples[lo:hi], 0, scale)

    def opened(name: str, size: int) -> tuple[int, ...]:
        """The header, and the frames asked for."""
        with _open(name) as file:
            rate, channels, code, bits, place, length = read_header(file, size)
        width = channels * bits // 8
        return (rate, channels, code, bits, place, width, *span(rate, length // width, name))

    def broken(batches):
        for batch in batches:
            failed = []
            for name, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if direct:
                        opened(name, of)
                    else:
                        rate, samples = parse_wav(of)
                        span(rate, len(samples), name)
                except Exception as error:
                    failed.append((name, error_text(error)))
            yield failure_batch(failed, "read_wav")

    def ranges(batches):
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rate, channels, code, bits, place, width, lo, hi = opened(name, size)
                except Exception:
                    if tolerant:
                        continue
                    raise
                step = max(1, RANGE_BYTES // width)
                firsts = np.arange(lo, max(lo, hi), step)
                fixed = [pa.array([v] * len(firsts), t) for v, t in ((name, pa.string()), (rate, pa.int32()), (channels, pa.int32()), (code, pa.int32()), (bits, pa.int32()))]
                numbers = [pa.array(v, pa.int64()) for v in (place + firsts * width, firsts - lo, np.minimum(firsts + step, hi) - firsts)]
                yield pa.RecordBatch.from_arrays([*fixed, *numbers], names=["path", "rate", "channels", "code", "bits", "place", "first", "frames"])

    def read(batches):
        for batch in batches:
            for name, rate, channels, code, bits, place, first, frames in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(name) as file:
                    file.seek(place)
                    samples = decode(file.read(frames * channels * bits // 8), channels, code, bits)
                yield from _chunks(name, rate, samples, first, scale)

    direct = (path.partition(":")[0] if ":" in path else "") in DIRECT
    if tolerant:
        failures.parts.append(files.select("path", "length" if direct else "content").mapInArrow(broken, "track string, step string, error string"))
    if not direct:
        return files.select("path", "content").mapInArrow(whole, _CHUNK_ROW)
    listed = files.select("path", "length")
    total = listed.agg(F.sum("length")).first()[0] or 0  # from the listing alone
    dealt = listed.mapInArrow(ranges, _RANGE_ROW).repartition(max(tasks_for(listed), -(-total // TASK_BYTES)), "path", "first")
    return dealt.mapInArrow(read, _CHUNK_ROW)
