"""Centroid clustering over distinct vectors: equal quantised vectors are grouped with their number and clustered once.

Lloyd's rounds read the distinct vectors only. A task gives one weighted integer sum a cluster, so a round's shuffle is
clusters times components times tasks, whatever the number of vectors; all arithmetic is on integers and thus exact and
the same for any partitioning. Assignments are joined back to the vectors at the end: vectors that make up a large share
of the table (fewer than HOT_SHARE by construction) by a broadcast, all others by their key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

SIZE, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: A vector that makes up more than one in so many rows is joined by a broadcast.
HOT_SHARE = 1000
#: Largest component by amount: with it, squared distances of 64 components fit in a bigint.
LARGEST = 1 << 27
#: Rows whose distances are held at once.
BLOCK = 1 << 14


def quantised(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """id and q of the vectors that are kept."""
    v = F.col("v")
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    keep = (F.size(v) == size) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    fits = F.forall(v, lambda x: F.abs(x * scale) < LARGEST)
    q = F.when(keep & fits, F.transform(v, lambda x: F.floor(x * scale).cast("int"))).when(keep, F.raise_error(F.lit(f"a component is beyond {LARGEST // scale} by amount")).cast("array<int>"))
    return slim.select("id", q.alias("q")).where(F.col("q").isNotNull())


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equally near ones) and the squared distance to it; exact."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)), 1)
    kind = np.float64 if q.shape[1] * 4 * most * most < 1 << 53 else np.int64  # integers that doubles hold exactly go through BLAS
    a, c = q.astype(kind), centroids.astype(kind)
    rest = (c * c).sum(1) - 2 * (a @ c.T)
    best = rest.argmin(1)
    return best, (rest[np.arange(len(q)), best] + (a * a).sum(1)).astype(np.int64)


def _sums(centroids: np.ndarray):
    """Of a task: for each cluster, the weighted sums of the components and, at the end, the weight."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        total = np.zeros((k, size + 1), object)  # of any size
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                q, n = _matrix(part.column("q"), size), part.column("n").to_numpy()
                cluster, _ = nearest(q, centroids)
                weighted = np.column_stack([q * n[:, None], n]) if int(np.abs(q).max()) * int(n.sum()) < 1 << 62 else np.column_stack([q.astype(object) * n[:, None], n])
                order = np.argsort(cluster, kind="stable")
                own, first = np.unique(cluster[order], return_index=True)
                total[own] += np.add.reduceat(weighted[order], first, axis=0).astype(object)
        own = [j for j in range(k) if total[j, size]]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([[str(x) for x in total[j]] for j in own], pa.list_(pa.string()))], ["cluster", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                cluster, distance = nearest(_matrix(part.column("q"), centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("n"), pa.array(cluster, pa.int32()), pa.array(distance)], ["q", "n", "cluster", "distance"])

    return run


def _rounds(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds; clusters times components sums come to the driver in each."""
    size = centroids.shape[1]
    for _ in range(rounds):
        parts = distinct.mapInArrow(_sums(centroids), "cluster int, sums array<string>").select("cluster", F.posexplode("sums").alias("at", "s"))
        sums = {(r[0], r[1]): int(r[2]) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect()}
        centroids = centroids.copy()
        for j in {c for c, _ in sums}:
            centroids[j] = [sums[j, at] // sums[j, size] for at in range(size)]
    return centroids


def salted(column: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit(""))), 256)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT, hot_share: int = HOT_SHARE
) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly size components, none of them null, NaN or infinite; component x becomes floor(scale * x). A component
    beyond LARGEST after that ends the job with a message, since distances would no longer fit in a bigint. The first centroids are
    the kept rows with the smallest SHA-256 of salt and id (a null id counts as empty text; where ids repeat, the smaller vector goes
    first): fewer than clusters rows give fewer centroids. Repeated rows count each, ties go to the smaller number, empty clusters
    stay as they are. Extra columns are ignored; an empty table, or one without a kept vector, gives no rows.
    """
    kept = quantised(vectors, id_col, vector_col, size, scale)
    first = kept.select("q", salted(F.col("id"), salt).alias("h")).orderBy("h", "q").limit(clusters).collect()
    kind = vectors.schema[id_col].dataType
    if not first:
        return kept.select(F.col("id").cast(kind).alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    distinct = materialize(kept.groupBy("q").agg(F.count("*").alias("n")))
    centroids = _rounds(distinct, np.array([r["q"] for r in first], np.int64), rounds)
    assigned = materialize(distinct.mapInArrow(_assign(centroids), "q array<int>, n bigint, cluster int, distance bigint"))
    per = {r[0]: (int(r[1]), int(r[2])) for r in assigned.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("distance")), F.sum("n")).collect()}
    inertia, rows = sum(x for x, _ in per.values()), sum(n for _, n in per.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = kept.sparkSession.createDataFrame([(j, x, inertia, hashes[j]) for j, (x, _) in per.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    limit = max(1, rows // hot_share)
    hot, rest = assigned.where(F.col("n") > limit).drop("n"), assigned.where(F.col("n") <= limit).drop("n")  # hot: fewer than hot_share vectors
    joined = kept.join(F.broadcast(hot), "q").unionByName(kept.join(F.broadcast(hot.select("q")), "q", "left_anti").join(rest, "q"))
    return joined.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
