"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary answers pre-tokens that are vocabulary entries as a whole. Tier
two: other pre-tokens are merged by rank with a heap over a linked list of their bytes. Ranks are read on the driver
from a file of fixed size and broadcast with the hash's displacement table (about 1 MB each).
"""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, text_of

#: Distinct pre-tokens that a Python worker remembers before it starts over.
MEMO = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class PerfectHash:
    """Minimal perfect hash by displacement: key -> slot in [0, n), and the slot's key and rank for the final test."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys = list(ranks)
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * n
        self.ranks = [-1] * n
        grouped: dict[int, list[bytes]] = {}
        for key in keys:
            grouped.setdefault(xxhash.xxh64_intdigest(key) % self.buckets, []).append(key)
        taken = bytearray(n)
        free = 0
        for bucket, members in sorted(grouped.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:  # the last ones take the free slots directly
                while taken[free]:
                    free += 1
                self.shift[bucket], slots = -free - 1, [free]
            else:
                seed = 0
                while True:
                    slots = [xxhash.xxh64_intdigest(key, seed + 1) % n for key in members]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    seed += 1
                self.shift[bucket] = seed
            for key, slot in zip(members, slots):
                taken[slot], self.keys[slot], self.ranks[slot] = 1, key, ranks[key]

    def get(self, key: bytes) -> int:
        """The rank of a vocabulary entry, else -1."""
        shift = int(self.shift[xxhash.xxh64_intdigest(key) % self.buckets])
        slot = -shift - 1 if shift < 0 else xxhash.xxh64_intdigest(key, shift + 1) % self.n
        return self.ranks[slot] if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of least rank, leftmost first, until no pair has a rank."""
    n = len(piece)
    before, end = list(range(-1, n - 1)), list(range(1, n + 1))  # a part starts at its index; the next one starts at its end
    find, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := find(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = pop(heap)
        j = end[i]
        if j >= n or j < 0 or end[j] != stop:  # a part of the pair has been merged meanwhile
            continue
        end[i], end[j], k = stop, -1, before[i]
        if stop < n:
            before[stop] = i
            if (rank := find(piece[i : end[stop]])) is not None:
                push(heap, (rank, i, end[stop]))
        if k >= 0 and (rank := find(piece[k:stop])) is not None:
            push(heap, (rank, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Memo(dict):
    """Pre-tokens met lately and their ids, packed; starts over beyond a bound."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str) -> bytes:
        packed = self.compute(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, table: PerfectHash, pattern: str) -> None:
        self.table, self.findall, self.memo = table, regex.compile(pattern).findall, Memo(self.piece)
        self.vocabulary = [b""] * (max(table.ranks) + 1)
        self.pair_ranks = dict(zip(table.keys, table.ranks))  # for merges, which mostly ask for pairs that do not exist
        for key, rank in self.pair_ranks.items():
            self.vocabulary[rank] = key

    def piece(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        whole = self.table.get(raw)
        ids = [whole] if whole >= 0 else merge_bytes(raw, self.pair_ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODECS: dict[object, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    if (key := (shared.id, pattern)) not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", roundtrip: bool = True) -> DataFrame:
    """Encode whole texts; decode the ids again.

    Returns per row: ``id_col``, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded (binary; null without
    ``roundtrip``). A null text counts as empty and has no ids; ids may be null or repeated, other columns are ignored;
    an empty table gives no rows.
    """
    shared = Shared(docs.sparkSession, PerfectHash(load_ranks(ranks_path)))

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                packed = [codec.encode(t) for t in part.column("text").to_pylist()]
                back = [codec.decode(p) if roundtrip else None for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(back, pa.binary())], names=[id_col, "ids", "n_tokens", "decoded"]
                )

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"`{id_col}` bigint, ids binary, n_tokens bigint, decoded binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of each row's ids; null ids count as none."""
    shared = Shared(encoded.sparkSession, PerfectHash(load_ranks(ranks_path)))

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            back = [codec.decode(p or b"") for p in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(back, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` bigint, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what ``encode_documents`` returns."""
    out = encode_documents(docs, ranks_path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

