"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's pieces are cut before packing (whole sequences, then the rest), so ids are digested where they are made
and only piece sizes are shuffled. Groups are drawn by a hash of the piece, so that no long document and no repeated or
null id fills one, and are packed independently.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, text_of
from .word_ids import read_tokenizer, worker_encoder

#: Tokens of a sequence, and mean documents of a group.
LENGTH, GROUP_DOCS = 2048, 8192


class Tournament:
    """Leaves are bins, in order of opening; a node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """Take ``size`` from the first bin that has it; bin and its free capacity before."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        free = best[node]
        at, best[node] = node - self.leaves, free - size
        while node > 1:
            node //= 2
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left >= right else right
        return at, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, none above ``capacity``; equal sizes keep their order."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i], free = tree.first_fit(sizes[i])
        offsets[i] = capacity - free
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids per document: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    shared = Shared(docs.sparkSession, read_tokenizer(tokenizer_path))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encoder = worker_encoder(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for doc, ids in zip(part.column("id").to_pylist(), encoder.encode_all(part.column("text").to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, piece if keep_ids else None))
                kinds = [pa.int64()] * 5 + [pa.binary()]
                columns = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")


def pack_pieces(pieces: DataFrame, groups: int, length: int = LENGTH, seed: int = 0) -> DataFrame:
    """Add sequence_id and offset to rows of (doc_id, start, length, ...).

    Rows of a group are sorted before they are packed, so a lost task gives the same sequences again.
    """
    names = [c for c in pieces.columns if c != "ids"]
    chosen = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "doc_tokens", "start", "ids_crc32", F.lit(seed)), F.lit(groups)).alias("_group"))

    def pack(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), length)
        base = int(key[0].as_py()) << 36
        return table.select(names).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema) + ", sequence_id bigint, offset bigint"
    return chosen.groupBy("_group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, group_docs: int = GROUP_DOCS, end_id: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` ids.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text counts as empty
    and has the end id only. Rows with the same id are packed as documents of their own; null ids are spread like others. An
    empty table gives no rows.
    """
    count = docs.count()
    return pack_pieces(cut_documents(docs, tokenizer_path, length, end_id, id_col, text_col).drop("ids"), max(1, round(count / group_docs)), length, seed)
