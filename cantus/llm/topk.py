"""Exact top-k inner-product search by MaxScore over integer vectors.

A query's terms are the vector components where it isn't zero. Within a shard a term's contribution, counted from the
least one there, is never negative and has a bound; terms in order of their bounds split into essential ones and a
tail that together cannot lift a vector to the current k-th score. The essential terms' postings are traversed for
all vectors of the shard, the others are probed while vectors remain competitive, and the shards' results are merged.

Rows that repeat an item are one item with a number of copies, which are told apart in the ranking. Queries come in blocks of a checked size; a block is broadcast and meets
every shard where it lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, written

#: Queries of a broadcast block at most; vectors of a shard; terms probed between two looks at the bound.
BLOCK_QUERIES, SHARD_ROWS, PROBE = 4096, 4096, 8


class Shard:
    """Postings of a shard: per dimension, the vectors' components with their least and largest."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.copies, self.postings = ids[order], copies[order], np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.postings.min(1), self.postings.max(1)

    def search(self, query_id: int, query: np.ndarray, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Up to k best (ids, scores, copies), ties to the smaller id; vectors that cannot reach ``threshold`` may be left out."""
        ends = np.stack([query * self.low, query * self.high])
        base, bounds = int(ends.min(0).sum()), np.abs(ends[1] - ends[0])
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[bounds[terms] > 0]
        tail = np.concatenate((np.cumsum(bounds[terms][::-1])[::-1], [0])) + base  # what terms i.. can add at most
        essential = len(terms) if threshold is None else int(np.count_nonzero(tail[:-1] >= threshold))
        if threshold is not None and tail[0] < threshold:
            return self.ids[:0], self.low[:0], self.copies[:0]
        # the terms before the tail decide who may compete at all: traverse their postings for every vector
        first = max(essential, min(PROBE, len(terms)))
        scores = np.full(len(self.ids), int(sum(int(ends[:, t].min()) for t in range(len(query)) if bounds[t] == 0)), np.int64)
        for t in terms[:first]:
            scores += query[t] * self.postings[t]
        alive = np.arange(len(self.ids))
        rest = tail - base
        low_rest = np.concatenate((np.cumsum(ends[:, terms].min(0)[::-1])[::-1], [0]))
        at = first
        while at < len(terms):
            if threshold is not None:
                keep = scores + low_rest[at] + rest[at] >= threshold
                alive, scores = alive[keep], scores[keep]
                if not len(alive):
                    break
            for t in terms[at : at + PROBE]:
                scores += query[t] * (self.postings[t] if len(alive) == len(self.ids) else self.postings[t][alive])
            at = min(len(terms), at + PROBE)
        other = self.ids[alive] != query_id
        ids, scores, copies = self.ids[alive][other], scores[other], self.copies[alive][other]
        if len(ids) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= least
            ids, scores, copies = ids[near], scores[near], copies[near]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best], copies[best]


def _merge(best, found, k):
    ids, scores, copies = found if best is None else map(np.concatenate, zip(best, found))
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order], copies[order]


def maxscore_topk(items: DataFrame, queries: DataFrame, k: int, block_queries: int = BLOCK_QUERIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best items of each query by integer inner product, ties to the smaller id.

    Both frames hold id (bigint) and vector (array<bigint>). Rows without id or with a null vector or component take no
    part; only vectors of a query's length are its candidates; items with the query's id are its own. Every row of items
    is a candidate of its own, so rows that repeat an item have a rank each, and every row of queries has its own list, so
    a query_id that occurs in several rows has several.
    Returns query_id, rank (from 1), vec_id, score; fewer than k where there are fewer items, and none for empty tables.
    """
    spark = items.sparkSession
    whole = "id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"
    items = items.select("id", "vector").filter(whole).groupBy("id", "vector").agg(F.count("*").alias("copies"))
    wanted = queries.select("id", "vector").filter(whole).groupBy("id", "vector").agg(F.count("*").alias("copies"))
    blocks = -(-wanted.count() // (block_queries // 2))
    wanted = written(wanted.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(max(1, blocks)))), "queries") if blocks > 1 else wanted.withColumn("block", F.lit(0))
    items = written(items, "items") if blocks > 1 else items
    parts = []
    for b in range(max(1, blocks)):
        rows = wanted.filter(F.col("block") == b).limit(block_queries + 1).collect()  # one block
        if len(rows) > block_queries:
            raise ValueError(f"{len(rows)} queries in a block of {block_queries}: choose a larger block")
        if not rows and b:
            continue
        shared = Shared(spark, [(b * (block_queries + 1) + i, r["id"], np.asarray(r["vector"], np.int64), r["copies"]) for i, r in enumerate(sorted(rows))])
        parts.append(items.mapInArrow(_searcher(shared, k, shard_rows), "query bigint, query_id bigint, asked bigint, vec_id bigint, score bigint, copies bigint"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    best = ranked.filter(F.col("rank") <= k).withColumn("ask", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("asked"))))
    return best.select("query_id", "rank", "vec_id", "score")


def _searcher(shared: Shared, k: int, shard_rows: int):
    def shards(batches):
        """Shards of vectors of one length."""
        held: dict[int, list] = {}
        for batch in batches:
            ids, copies, vectors = batch.column("id").to_numpy(), batch.column("copies").to_numpy(), batch.column("vector")
            offsets = vectors.offsets.to_numpy()
            flat = vectors.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for n in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == n)
                take = flat[offsets[of][:, None] + np.arange(n)] if n else np.zeros((len(of), 0), np.int64)
                part = held.setdefault(n, [])
                part.append((ids[of], copies[of], take))
                if sum(len(x) for x, *_ in part) >= shard_rows:
                    yield Shard(*map(np.concatenate, zip(*part))), n
                    held[n] = []
        for n, part in held.items():
            if part:
                yield Shard(*map(np.concatenate, zip(*part))), n

    def run(batches):
        best: dict[int, tuple] = {}
        for shard, n in shards(batches):
            for number, query_id, query, _ in shared.value:
                if len(query) != n:
                    continue
                known = best.get(number)
                threshold = int(known[1][-1]) if known is not None and len(known[0]) == k else None
                found = shard.search(query_id, query, k, threshold)
                if len(found[0]):
                    best[number] = _merge(known, found, k)
        for number, query_id, _, asked in shared.value:
            if number in best:
                about = ([v] * len(best[number][0]) for v in (number, query_id, asked))
                columns = [pa.array(x, pa.int64()) for x in (*about, *best[number])]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "asked", "vec_id", "score", "copies"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """id and floor(scale * x) of each component; vectors with null or non-finite components are left out."""
    finite = f"`{vector_col}` IS NOT NULL AND NOT exists(`{vector_col}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return vectors.filter(finite).select(F.col(id_col).cast("bigint").alias("id"), scaled.alias("vector"))
