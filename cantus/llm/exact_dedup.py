"""Exact deduplication by Grace hash partitioning.

Every map task first combines its own rows in an open-addressing table, so that a text with any number of copies
leaves a task once. The distinct records are dealt out by a hash of their content; the shuffle files are the spill
files of the level. A task builds a table over its bucket that compares complete content. What does not fit the
table's budget is written to the shared folder and partitioned again by the next level's hash, until nothing is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, text_of, written

#: Content bytes that one table may hold.
TABLE_BYTES = 64 << 20

_RECORD = "sha binary, content binary, max_id bigint, n bigint, open boolean"


class ContentTable:
    """Open addressing with linear probing over complete contents; keeps the largest id and the count of each."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self.clear(slots)

    def clear(self, slots: int = 1 << 10) -> None:
        self.slots, self.mask, self.bytes = [-1] * slots, slots - 1, 0
        self.hashes: list[int] = []
        self.shas: list[bytes] = []
        self.contents: list[bytes] = []
        self.max_ids: list[int | None] = []
        self.counts: list[int] = []

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """Entry (-1: none) and the slot where it is or belongs."""
        at = h & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, at
            at = (at + 1) & self.mask
        return -1, at

    def add(self, entry: int, at: int, h: int, sha: bytes, content: bytes, max_id: int | None, n: int) -> None:
        if entry >= 0:
            self.counts[entry] += n
            if max_id is not None and (self.max_ids[entry] is None or max_id > self.max_ids[entry]):
                self.max_ids[entry] = max_id
            return
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.shas.append(sha)
        self.contents.append(content)
        self.max_ids.append(max_id)
        self.counts.append(n)
        self.bytes += len(content) + 100
        if 2 * len(self.hashes) > self.mask:
            self.slots, self.mask = [-1] * (4 * len(self.slots)), 4 * len(self.slots) - 1
            for entry, value in enumerate(self.hashes):
                at = value & self.mask
                while self.slots[at] >= 0:
                    at = (at + 1) & self.mask
                self.slots[at] = entry


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sha", "content", "max_id", "n", "open"])


def _in_batches(rows: Iterator[tuple], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or b"") + 64
        if size > most_bytes:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("sha", "content", "max_id", "n")))


def _combine(budget: int):
    """Per map task: distinct contents; a full table is emptied and filled anew, which only lessens the combining."""

    def run(batches):
        def out():
            table = ContentTable()
            flush = lambda: list(zip(table.shas, table.contents, table.max_ids, table.counts, [True] * len(table.hashes)))
            for sha, content, max_id, n in _rows(batches):
                h = int.from_bytes(sha[:8], "little")
                table.add(*table.find(h, content), h, sha, content, max_id, n)
                if table.bytes > budget:
                    yield from flush()
                    table.clear()
            yield from flush()

        yield from _in_batches(out())

    return run


def _resolve(budget: int):
    """Per bucket: final groups without content, and what the table had no room for, to be partitioned again."""

    def run(batches):
        def out():
            table = ContentTable()
            for sha, content, max_id, n in _rows(batches):
                h = int.from_bytes(sha[8:16], "little")
                entry, at = table.find(h, content)
                if entry < 0 and table.bytes > budget:
                    yield sha, content, max_id, n, True
                else:
                    table.add(entry, at, h, sha, content, max_id, n)
            for i in range(len(table.hashes)):
                yield table.shas[i], None, table.max_ids[i], table.counts[i], False

        yield from _in_batches(out())

    return run


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct text: sha (binary), keep_id (largest id), group_size."""
    spark = docs.sparkSession
    content = text_of(text_col).cast("binary")
    total = docs.agg(F.sum(F.octet_length(content))).first()[0] or 0
    # a quarter of the budget on average: one level is enough unless a bucket is far off the mean
    parts = partitions_for(spark, total, max(1, table_bytes // 4))
    pending = docs.select(
        F.unhex(F.sha2(content, 256)).alias("sha"), content.alias("content"), F.col(id_col).cast("bigint").alias("max_id"), F.lit(1).cast("bigint").alias("n")
    ).mapInArrow(_combine(table_bytes // 2), _RECORD)
    groups, level = [], 0
    while True:
        dealt = pending.select("sha", "content", "max_id", "n").repartition(parts, F.xxhash64("sha", F.lit(level)))
        out = written(dealt.mapInArrow(_resolve(table_bytes), _RECORD), f"grace-{level}")
        groups.append(out.filter(~F.col("open")).select("sha", F.col("max_id").alias("keep_id"), F.col("n").alias("group_size")))
        pending = out.filter("open")
        if pending.isEmpty():
            break
        level += 1
    result = groups[0]
    for g in groups[1:]:
        result = result.unionByName(g)
    return result


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Mark exact copies.

    Returns one row per input row: ``id_col``, keep_id, group_size, kept, text_sha256. Texts are equal when their
    bytes are; null counts as the empty text. The row with the largest id stays; of rows that agree in id and text
    one stays. A null id is smaller than any other. Other columns are ignored; an empty table gives no rows.
    """
    content = text_of(text_col).cast("binary")
    groups = content_groups(docs, id_col, text_col, table_bytes)
    # rows that agree in id and text are counted here and told apart below
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.unhex(F.sha2(content, 256)).alias("sha")).groupBy("_id", "sha").agg(F.count("*").alias("_rows"))
    # a plain sort-merge join: Spark splits the partitions of hot texts at run time
    joined = rows.hint("merge").join(groups, "sha")
    return joined.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.posexplode(F.array_repeat(F.lit(1), F.col("_rows").cast("int"))).alias("_copy", "_one"), F.lower(F.hex("sha")).alias("text_sha256")
    ).select(id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 0)).alias("kept"), "text_sha256")
