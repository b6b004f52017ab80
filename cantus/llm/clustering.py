"""Ball k-means: exact k-means in which balls decide which centroids a vector has to be compared with.

A cluster is a ball: its centroid and the largest distance of a member from it. Centroid j is a neighbour of ball i
only if half of their distance is within i's radius; no other can be nearer to any member. Half of the distance to the
nearest neighbour bounds the stable core, whose members stay without a comparison. The neighbours in order of distance
cut the rest into annuli, and a member of the m-th annulus is compared with the m nearest neighbours only.

All of it is integer arithmetic on squared distances, so ties and rounding are exact: a member whose distance to its
own centroid is d stays clear of j if 4 d² < |ci - cj|².
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Largest component by size; squared distances of vectors of up to 64 such components fit 62 bits.
LARGEST = 1 << 27
#: Vectors that a kernel handles at a time.
SLICE = 1 << 15


def ball_assign(vectors: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, its squared distance, number of distances computed) of integer vectors; ties go to the smaller number.

    ``own`` is the cluster that each is a member of. A ball reaches as far as the farthest of its members given here.
    """
    out = own.copy()
    distance = np.empty(len(vectors), np.int64)
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    computed = 0
    for i in np.unique(own):
        at = np.flatnonzero(own == i)
        members = vectors[at]
        best = ((members - centroids[i]) ** 2).sum(1)
        computed += len(at)
        nearest = np.full(len(at), i, own.dtype)
        # the ball: python integers, as four times a squared radius may pass 64 bits
        radius = int(best.max())
        relevant = [j for j in np.argsort(between[i], kind="stable").tolist() if j != i and int(between[i, j]) <= 4 * radius]
        clear = best.copy()  # distances to the own centroid decide the annulus
        rest = np.arange(len(at))
        for j in relevant:
            rest = rest[clear[rest] >= -(-between[i, j] // 4)]  # the others lie in the core or an inner annulus
            if not len(rest):
                break
            d = ((members[rest] - centroids[j]) ** 2).sum(1)
            computed += len(rest)
            wins = (d < best[rest]) | ((d == best[rest]) & (j < nearest[rest]))
            best[rest[wins]], nearest[rest[wins]] = d[wins], j
        out[at], distance[at] = nearest, best
    return out, distance, computed


def _assigned(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Members (id, v, cluster) with their new cluster and its squared distance, by the centroids."""
    shared = members.sparkSession.sparkContext.broadcast(centroids)  # k vectors

    def run(batches):
        c = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                v = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                cluster, distance, _ = ball_assign(v, part.column("cluster").to_numpy(), c)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "v", "cluster", "distance"])

    return members.select("id", "v", "cluster").mapInArrow(run, "id bigint, v array<bigint>, cluster int, distance bigint")


def integer_vectors(rows: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v) with v = floor(scale * x) of every vector of ``dims`` finite components none of which exceeds ``LARGEST`` after scaling."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))

    def usable(x: Column) -> Column:
        wide = x.cast("double")
        return x.isNotNull() & ~F.isnan(wide) & (F.abs(wide) <= LARGEST / scale)

    kept = rows.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & F.forall(vector_col, usable))
    return kept.select(F.col(id_col).cast("bigint").alias("id"), scaled.alias("v"))


def ball_kmeans(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Per vector that takes part: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with ``dims`` components take part, none of them null, non-finite or beyond 2^27 in size after scaling
    (their squared distances would not fit 64 bits). The ``k`` vectors whose ids have the least digests are the first
    centroids, or all of them if there are fewer; of equal ids, the lesser vector is first, and repeated rows count
    each. A null id has the digest of an empty one. Empty clusters keep their centroid. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, dims, id_col, vector_col, scale)
    state = written(vectors.withColumn("cluster", F.lit(0)), "vectors")
    digest = F.sha2(F.concat(F.lit("1:"), text_of("id_text")).cast("binary"), 256)
    first = state.withColumn("id_text", F.col("id").cast("string")).orderBy(digest, "v").limit(k).select("v").collect()  # k rows
    centroids = np.asarray([r.v for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        # a table per round: labels are never computed again, and balls are those of the members at hand
        state = written(_assigned(state, centroids), "balls")
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)))  # fits for 2^36 of the largest
        moved = centroids.copy()
        for r in sums.collect():  # k rows
            moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
        centroids = moved
    last = written(_assigned(state, centroids).select("id", "cluster", "distance"), "balls") if len(first) else state.select("id", "cluster", F.lit(0).cast("bigint").alias("distance"))
    inertias = {r.cluster: int(r.d) for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    about = [(i, inertias.get(i, 0), sum(inertias.values()), ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, components string")
    joined = last.join(F.broadcast(table), "cluster")
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"))
