"""Exact duplicates by a cuckoo-filter index of live digests.

Rows are digested where they are read (SHA-256 of the text after lower-casing A-Z), equal digests of an Arrow
batch are merged before anything is shuffled (so a text that a third of all rows share reaches its bucket as a
row for each batch), and the partial rows are dealt to buckets by digest. A bucket feeds its rows through a
:class:`CuckooIndex`: a miss of the filter inserts, a hit is verified against the bucket's stored content
keys (whole digest and byte length), a row with a larger id deletes the live entry and takes its place, and
overflow resizes the filter from the stored keys. There are so many buckets that the index of one has about BUCKET_ROWS keys at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import free_name, materialize
from .textkit import LOWER, U64, mix, slices, text_bytes

#: Slots of a filter bucket, bits of a fingerprint, and moves before the filter counts as full.
SLOTS, FINGERPRINT_BITS, MAX_KICKS = 4, 16, 200
#: Rows of the table to a bucket of the index; distinct digests spread evenly, so its memory is bounded whatever the table's size.
BUCKET_ROWS = 250_000


class CuckooFilter:
    """Approximate set of 64-bit keys with deletion. add() returns False when the filter is full and must be resized."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint32)
        self.mask = self.buckets - 1

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and the two buckets of each key."""
        h = mix(np.asarray(keys, U64))
        prints = (h >> U64(64 - FINGERPRINT_BITS)).astype(np.uint32) + np.uint32(1)
        first = (h & U64(self.mask)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket, fingerprint):
        return bucket ^ (mix(np.asarray(fingerprint, U64)) & U64(self.mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(keys)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(1)

    def add(self, key: int) -> bool:
        prints, one, two = self.places(np.array([key], U64))
        return self._put(prints[0], int(one[0]), int(two[0]))

    def add_all(self, keys: np.ndarray) -> int:
        """Adds keys in order; the number added before the filter was full."""
        prints, one, two = self.places(keys)
        for i, (p, a, b) in enumerate(zip(prints, one.tolist(), two.tolist(), strict=True)):
            if not self._put(p, a, b):
                return i
        return len(keys)

    def _put(self, print_, one: int, two: int) -> bool:
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        moved, bucket = [], one
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            moved.append((bucket, slot, self.table[bucket, slot]))
            print_, self.table[bucket, slot] = self.table[bucket, slot].copy(), print_
            bucket = int(self.other(np.array([bucket]), np.array([print_]))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        for bucket, slot, was in reversed(moved):  # nothing is lost when the caller resizes
            self.table[bucket, slot] = was
        return False

    def remove(self, key: int) -> bool:
        prints, one, two = self.places(np.array([key], U64))
        for bucket in (int(one[0]), int(two[0])):
            at = np.flatnonzero(self.table[bucket] == prints[0])
            if len(at):
                self.table[bucket, at[0]] = 0
                return True
        return False


class CuckooIndex:
    """Live digests of one bucket: the filter in front, the verified content keys behind."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.live: dict[bytes, tuple] = {}
        self.resized = 0

    @staticmethod
    def key(content: bytes) -> int:
        return int.from_bytes(content[:8], "little")

    def _add(self, contents: list[bytes]) -> None:
        keys = np.array([self.key(x) for x in contents], U64)
        done = self.filter.add_all(keys)
        if done < len(keys):
            self.resize()

    def resize(self) -> None:
        """A larger filter, filled from the stored keys."""
        capacity = max(2 * len(self.live), 2 * self.filter.buckets * SLOTS)
        keys = np.array([self.key(x) for x in self.live], U64)
        while True:
            self.resized += 1
            self.filter = CuckooFilter(capacity)
            if self.filter.add_all(keys) == len(keys):
                return
            capacity *= 2

    def lookup(self, contents: list[bytes]) -> list[tuple | None]:
        """The live entry of each content key: filter first, then verification against the stored keys."""
        if not contents:
            return []
        hits = self.filter.contains(np.array([self.key(x) for x in contents], U64))
        return [self.live.get(x) if hit else None for x, hit in zip(contents, hits.tolist(), strict=True)]

    def insert(self, contents: list[bytes], values: list[tuple]) -> None:
        """Inserts distinct keys that are not live."""
        self.live.update(zip(contents, values, strict=True))
        self._add(contents)

    def delete(self, content: bytes) -> bool:
        """Removes a live key; False if it is not live."""
        if self.live.pop(content, None) is None:
            return False
        return self.filter.remove(self.key(content))


def _larger(a, b):
    """The larger id, null below every number."""
    return b if a is None or (b is not None and b > a) else a


def _digests(id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = text_bytes(part.column("text"))
                data = LOWER[buf].tobytes()
                bounds = off.tolist()
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), pa.array(np.diff(off), pa.int64())], ["id", "digest", "n_bytes"])

    return run


def _premerge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each content of a batch: largest id and number of rows."""
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch]).group_by(["digest", "n_bytes"]).aggregate([("id", "max"), ("id", "count", __import__("pyarrow").compute.CountOptions(mode="all"))])
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("digest", "n_bytes", "id_max", "id_count")], ["digest", "n_bytes", "id", "n"])


def _index_bucket(id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            merged: dict[bytes, tuple] = {}
            for digest, size, i, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_bytes", "id", "n")), strict=True):
                content = digest + size.to_bytes(8, "little")
                old = merged.get(content)
                merged[content] = (i, n) if old is None else (_larger(old[0], i), old[1] + n)
            new: dict[bytes, tuple] = {}
            for content, old in zip(merged, index.lookup(list(merged)), strict=True):
                i, n = merged[content]
                if old is None:
                    new[content] = (i, n)
                elif _larger(old[0], i) == old[0]:
                    index.live[content] = (old[0], old[1] + n)
                else:  # the live row gives way to one with a larger id
                    index.delete(content)
                    new[content] = (i, old[1] + n)
            index.insert(list(new), list(new.values()))
        items = list(index.live.items())
        for k in range(0, len(items), 10_000):
            part = items[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([c[:32] for c, _ in part], pa.binary()), pa.array([v[0] for _, v in part], id_type), pa.array([v[1] for _, v in part], pa.int64())], ["digest", "keep_id", "group_size"])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays. A
    null text counts as empty. A null id is below every other id; where all ids of a group are null, its
    rows are all kept. Repeated rows (same id, same text) each count in group_size and share the decision. Extra
    columns are ignored; an empty table gives no rows. Ids may be of any type that has an order.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, arrow = slim.schema["id"].dataType.simpleString(), to_arrow_type(slim.schema["id"].dataType)
    digests = materialize(slim.mapInArrow(_digests(arrow), f"id {kind}, digest binary, n_bytes bigint"))
    partial = digests.mapInArrow(_premerge, f"digest binary, n_bytes bigint, id {kind}, n bigint")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // BUCKET_ROWS))  # rows from the footers of the written table
    live = partial.repartition(buckets, "digest").mapInArrow(_index_bucket(arrow), f"digest binary, keep_id {kind}, group_size bigint")
    return digests.join(live, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns: those whose id is the largest of their text's rows.

    The decision is one of id and text together, so rows that share an id, or have none, are told apart by their texts. A null text counts as
    empty; rows without id go where their text has one with an id, and stay otherwise; of repeated rows with one id and text, all
    stay; an empty table gives an empty table.
    """
    groups = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept_id"), F.unhex("text_sha256").alias("__kept_digest")).distinct()
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = free_name(docs, "__digest")
    keyed = docs.withColumn(own, F.unhex(F.sha2(lower, 256)))
    return keyed.join(groups, (keyed[own] == groups["__kept_digest"]) & keyed[id_col].eqNullSafe(groups["__kept_id"]), "left_semi").drop(own)
