"""Vector search by blocks: rows and queries become matrices of unit rows, and each pair of blocks is one matrix product.

Blocks are rows of tables that Spark pairs and deals out: neither side is collected or needs to fit into one task, and of each
pair of blocks only the best rows of each query go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Rows of a block of the table and of the queries.
ROWS, QUERIES = 8192, 1024


def _packed(rows: int, prefix: str, carried: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                matrix = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                matrix = matrix / np.sqrt((matrix * matrix).sum(1))[:, None]
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in carried]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([matrix.tobytes()], pa.binary())], [f"{prefix}{c}" for c in (*carried, "matrix")])

    return run


def blocks(vectors: DataFrame, id_col: str, vector_col: str, rows: int, prefix: str = "", carry: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One row per block: id, matrix and the carried columns (name, type). Vectors that are null, hold a null, or have no direction
    (only zeros) aren't found and find nothing."""
    slim = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *(F.col(c).cast(t).alias(c) for c, t in carry))
    slim = slim.where(F.forall("v", lambda x: x.isNotNull()) & F.exists("v", lambda x: x != 0))
    kinds = [("id", "bigint"), *carry]
    return slim.mapInArrow(_packed(rows, prefix, [c for c, _ in kinds]), ", ".join([*(f"{prefix}{c} array<{t}>" for c, t in kinds), f"{prefix}matrix binary"]))


def scores(pair: dict, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of the queries, ids of the rows and their rounded cosines, queries by rows."""
    q, ids = np.array(pair["q_id"], np.int64), np.array(pair["id"], np.int64)
    a, b = np.frombuffer(pair["q_matrix"]).reshape(len(q), -1), np.frombuffer(pair["matrix"]).reshape(len(ids), -1)
    return q, ids, np.round(a @ b.T, digits)


def best_first(ids: np.ndarray, row: np.ndarray, depth: int) -> np.ndarray:
    """Indices of the best entries: highest score, then greatest id."""
    if len(row) > depth:
        least = np.partition(row, len(row) - depth)[len(row) - depth]
        near = np.flatnonzero(row >= least)
    else:
        near = np.arange(len(row))
    return near[np.lexsort((-ids[near], -row[near]))][:depth]


def _each_pair(tell: Callable[[dict], Iterator[tuple]], names: list[str], types: list[pa.DataType]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(tell(batch.slice(k, 1).to_pylist()[0]))
                cols = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def paired(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, carry: tuple = (), q_carry: tuple = ()) -> DataFrame:
    """Every block of rows with every block of queries. The queries' blocks are written first, so that their size is known: small ones
    are broadcast, others are read for each part of the rows."""
    return blocks(vectors, id_col, vector_col, ROWS, "", carry).crossJoin(written(blocks(queries, id_col, vector_col, QUERIES, "q_", q_carry)))


def nearest_each(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, depth: int, digits: int = 6) -> DataFrame:
    """Each query's nearest rows by cosine, then greatest id: q, id, score, place."""

    def tell(pair: dict) -> Iterator[tuple]:
        q, ids, score = scores(pair, digits)
        for one, row in zip(q.tolist(), score, strict=True):
            at = best_first(ids, row, depth)
            yield from zip([one] * len(at), ids[at].tolist(), row[at].tolist(), strict=True)

    names, types = ["q", "id", "score"], [pa.int64(), pa.int64(), pa.float64()]
    near = paired(vectors, queries, id_col, vector_col).mapInArrow(_each_pair(tell, names, types), "q bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("id"))).cast("bigint")
    return near.withColumn("place", place).where(F.col("place") <= depth)


def recall(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, label_col: str, depth: int = 20, digits: int = 6) -> DataFrame:
    """q, n_relevant, recall, reciprocal_rank: relevant are other rows with the query's label; queries without any are left out.

    One pass gives each query's best rows, its best relevant row and their number. Where the best relevant row is not among
    the best rows, a second pass counts what stands before it, for those queries alone.
    """

    def tell(pair: dict) -> Iterator[tuple]:
        q, ids, score = scores(pair, digits)
        wanted, table = pair["q_label"], np.array([np.nan if x is None else x for x in pair["label"]], float)
        for one, want, row in zip(q.tolist(), wanted, score, strict=True):
            other = ids != one
            relevant = other & (table == want) if want is not None else np.zeros(len(ids), bool)
            at = np.flatnonzero(other)[best_first(ids[other], row[other], depth)]
            first = np.flatnonzero(relevant)[best_first(ids[relevant], row[relevant], 1)]
            yield one, [{"score": row[i], "item": ids[i], "relevant": bool(relevant[i])} for i in at], {"score": row[first[0]], "item": ids[first[0]]} if len(first) else None, int(relevant.sum())

    entry = [("score", pa.float64()), ("item", pa.int64())]
    types = [pa.int64(), pa.list_(pa.struct([*entry, ("relevant", pa.bool_())])), pa.struct(entry), pa.int64()]
    label = (("label", "bigint"),)
    vectors = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    queries = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    parts = paired(vectors, queries, "id", "v", label, label).mapInArrow(_each_pair(tell, ["q", "top", "best", "n"], types), "q bigint, top array<struct<score: double, item: bigint, relevant: boolean>>, best struct<score: double, item: bigint>, n bigint")
    parts = written(parts)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("x.score"), F.desc("x.item")))
    top = parts.select("q", F.explode("top").alias("x")).withColumn("place", rank).where(F.col("place") <= depth)
    hits = top.where("x.relevant").groupBy("q").agg(F.count("*").alias("hits"), F.min("place").cast("bigint").alias("first"))
    total = written(parts.groupBy("q").agg(F.sum("n").alias("n_relevant"), F.max("best").alias("best")).where("n_relevant > 0").join(hits, "q", "left"))

    def before(pair: dict) -> Iterator[tuple]:
        q, ids, score = scores(pair, digits)
        for one, best, item, row in zip(q.tolist(), pair["q_best"], pair["q_item"], score, strict=True):
            yield one, int((((row > best) | ((row == best) & (ids > item))) & (ids != one)).sum())

    late = queries.join(total.where("first is null").select(F.col("q").alias("id"), F.col("best.score").alias("best"), F.col("best.item").alias("item")), "id")
    counted = paired(vectors, late, "id", "v", (), (("best", "double"), ("item", "bigint"))).mapInArrow(_each_pair(before, ["q", "n"], [pa.int64(), pa.int64()]), "q bigint, n bigint")
    behind = counted.groupBy("q").agg((F.sum("n") + 1).alias("later"))
    return total.join(behind, "q", "left").select(
        "q", "n_relevant", (F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).alias("recall"), (1 / F.coalesce("first", "later")).alias("reciprocal_rank")
    )
