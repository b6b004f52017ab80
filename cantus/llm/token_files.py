"""Token-id files in a Simple-8b word-aligned coding.

A file is a sequence of blocks. A block codes the ids of consecutive documents as 64-bit words: the top four bits
select how many ids share the word and their width; an id too wide for any shared word has one of its own (the
escape). A block carries its documents' ids and lengths, the file's ids before it and its ids before each word group, so
any part of it can be decoded with array operations. Blocks are rows of Parquet files that Spark writes and commits;
files are ranges of document ids, so a file's place in the whole follows from the files' totals alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, partitions_for, text_of, written
from .word_ids import read_tokenizer, worker_encoder

#: Ids per word by selector; the width is 60 // count. Selector 0 is the escape: one id of up to 60 bits.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
WIDTHS = tuple(60 // n for n in COUNTS)
#: Ids after which a block is closed (a longer document has a block of its own), words between two offsets, and ids
#: that are decoded at a time.
BLOCK_IDS, STRIDE, RUN_IDS = 1 << 16, 256, 1 << 16


def _bits(ids: np.ndarray) -> np.ndarray:
    return np.frexp(ids.astype(np.float64))[1].astype(np.int8)  # exact under 2**53


def _in_a_row(small: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` true values begin, by doubling the length that is known."""
    known = 1
    while 2 * known <= count:
        small, known = small[:-known] & small[known:], 2 * known
    rest = count - known
    return small[:-rest] & small[rest:] if rest else small


def encode_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids below 2**53: each takes the longest run that fits."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, "<u8")
    bits, best = _bits(ids), np.zeros(n, np.int8)
    for selector in sorted(range(1, len(COUNTS)), key=lambda s: COUNTS[s]):
        count, width = COUNTS[selector], WIDTHS[selector]
        if count > n:
            continue
        np.copyto(best[: n - count + 1], selector, where=_in_a_row(bits <= width, count))
    starts, at, counts = [], 0, [COUNTS[s] for s in range(len(COUNTS))]
    chosen = best.tolist()
    while at < n:
        starts.append(at)
        at += counts[chosen[at]]
    first = np.asarray(starts, np.int64)
    selectors = best[first]
    words = selectors.astype(np.uint64) << np.uint64(60)
    wide_ids = ids.astype(np.uint64)
    for selector in np.unique(selectors).tolist():
        of = np.flatnonzero(selectors == selector)
        for k in range(COUNTS[selector]):
            words[of] |= wide_ids[first[of] + k] << np.uint64(k * WIDTHS[selector])
    return words.astype("<u8")


def decode_words(words: np.ndarray) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.asarray(COUNTS)[selectors]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(selectors).tolist():
        of = np.flatnonzero(selectors == selector)
        mask = np.uint64((1 << WIDTHS[selector]) - 1)
        for k in range(COUNTS[selector]):
            out[first[of] + k] = (words[of] >> np.uint64(k * WIDTHS[selector])) & mask
    return out


def decode_slice(words: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Ids lo..hi of a block, reading only the word groups that hold them."""
    a = max(0, int(np.searchsorted(offsets, lo, "right")) - 1)
    b = int(np.searchsorted(offsets, hi, "left"))
    base = int(offsets[a]) if len(offsets) else 0
    return decode_words(words[a * STRIDE : b * STRIDE])[lo - base : hi - base]


def _block(file: int, number: int, before: int, docs: list, parts: list[bytes]) -> tuple:
    ids = np.frombuffer(b"".join(parts), "<u4")
    words = encode_words(ids)
    ends = np.cumsum(np.asarray(COUNTS)[(words >> np.uint64(60)).astype(np.int64)])
    offsets = np.concatenate(([0], ends[STRIDE - 1 :: STRIDE]))[: -(-len(words) // STRIDE)].astype("<u4")
    return file, number, before, docs, [len(p) // 4 for p in parts], len(ids), offsets.tobytes(), words.tobytes()


_BLOCK = "file bigint, block bigint, before bigint, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, offsets binary, words binary"
_BLOCK_ARROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("offsets", pa.binary()), ("words", pa.binary())])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 64 << 20, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write whole documents in ascending id order; returns the files' blocks as read back from the shared folder.

    A null text counts as empty and has the end id only; null ids come first; rows with the same id are in the order
    of their texts. Other columns are ignored; an empty table gives no blocks.
    """
    spark = docs.sparkSession
    shared = Shared(spark, read_tokenizer(tokenizer_path))
    end = np.asarray([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the texts' beginnings part rows that agree in the id, in the order of the whole texts
    ordered = rows.repartitionByRange(partitions_for(spark, total, file_bytes), "id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, file, number, before, names, parts, held = worker_encoder(shared), TaskContext.get().partitionId(), 0, 0, [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc, ids in zip(part.column("id").to_pylist(), encoder.encode_all(part.column("text").to_pylist())):
                    names.append(doc)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= block_ids:
                        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK_ARROW.names, _block(file, number, before, names, parts)))], _BLOCK_ARROW)
                        number, before, names, parts, held = number + 1, before + held, [], [], 0
        if names:
            yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK_ARROW.names, _block(file, number, before, names, parts)))], _BLOCK_ARROW)

    return written(ordered.mapInArrow(run, _BLOCK), "token-files")


def read_token_files(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files: id, start (ids before it in all files), n_tokens, ids (binary)."""
    # one row per file, which is some 64 MB of text: only their totals are summed in order; written, so that its size
    # is known and decides between a broadcast and a shuffle
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    bases = written(files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "file-bases")
    placed = blocks.join(bases, "file").select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "lengths", "offsets", "words")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                base, names, lengths, offsets, words = (c[i].as_py() for c in batch.columns)
                words, offsets = np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                # runs of documents, each decoded from the word group that its first id lies in
                heads = np.flatnonzero(np.concatenate(([True], np.diff(starts // RUN_IDS) > 0)))
                for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(names)]):
                    ids = decode_slice(words, offsets, int(starts[lo]), int(ends[hi - 1])).astype("<u4")
                    parts = pa.array([ids[a:b].tobytes() for a, b in zip(starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi], pa.int64()), pa.array(starts[lo:hi] + base, pa.int64()), pa.array(lengths[lo:hi], pa.int64()), parts], names=[id_col, "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids binary")


def token_file_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files read back."""
    return read_token_files(write_token_files(docs, tokenizer_path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

