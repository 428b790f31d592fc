"""Token counts without tokens: a trie over the distinct pre-tokens and one forward step for each of its nodes.

The distinct pre-tokens of a batch are sorted; a node of their trie is a character beyond the common prefix with the
pre-token before, so shared prefixes exist once. Level by level, each node gets the best forward score of its prefix
and the number of tokens on that path; the number at a pre-token's last node is its terminal count, and a text's count is the sum over
its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import DEFAULT_MODEL, VERY_LONG, Pieces, Words, cut_long, load, long_path, point_hash, prefix_sums, pretokens, utf8_size
from .textkit import segment_sum, slices

#: Code points of sorted pre-tokens in a trie.
BLOCK = 1 << 21


def _trie_counts(points: np.ndarray, size: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Tokens of each row of a padded matrix of code points (0 beyond its size), rows sorted."""
    n, width = points.shape
    same = np.zeros((n, width), bool)
    same[1:] = np.logical_and.accumulate(points[1:] == points[:-1], axis=1)
    inside = np.arange(width) < size[:, None]
    new = inside & ~same  # the nodes
    node = np.where(new, np.cumsum(new).reshape(n, width), 0)
    node = np.maximum.accumulate(np.where(new, np.arange(n)[:, None], 0), axis=0)  # the row that owns the node of each prefix
    sums = prefix_sums(points)
    best = np.full((n, width + 1), -np.inf)
    count = np.zeros((n, width + 1), np.int64)
    best[:, 0] = 0
    for end in range(1, width + 1):
        rows = np.flatnonzero(new[:, end - 1])
        if not len(rows):
            continue
        own = sums[rows]
        top, number = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        for length in range(min(end, pieces.longest), 0, -1):
            start = end - length
            at = pieces.probe(point_hash(own, start, end))
            hit = np.arange(len(rows)) if length == 1 else np.flatnonzero(at >= 0)
            if not len(hit):
                continue
            parent = rows[hit] if start == 0 else node[rows[hit], start - 1]  # the shared prefix was scored where it is a node
            known = at[hit] >= 0
            gain = np.where(known, pieces.scores[at[hit]], pieces.unknown)
            total = best[parent, start] + gain
            better = total > top[hit]
            hit, known = hit[better], known[better]
            top[hit] = total[better]
            number[hit] = count[parent[better], start] + np.where(known, 1, utf8_size(points[rows[hit], end - 1]))
        best[rows, end], count[rows, end] = top, number
    last = size - 1
    return count[node[np.arange(n), last], size]


def count_words(words: Words, pieces: Pieces) -> np.ndarray:
    """Tokens of each distinct pre-token."""
    starts, ends, owner = cut_long(words, pieces)
    size = ends - starts
    out = np.zeros(len(size), np.int64)
    bands = np.digitize(size, [5, 9, 13, 17, 25, 33, LONGER := 65])
    for band in np.unique(bands[size > 0]).tolist():
        own = np.flatnonzero((bands == band) & (size > 0))
        width = int(size[own].max())
        if band == 7:  # rare and very long: one by one, so that a matrix stays small
            groups = [own[k : k + 1] for k in range(len(own))]
        else:
            groups = [own[k : k + max(1, BLOCK // width)] for k in range(0, len(own), max(1, BLOCK // width))]
        for g in groups:
            w = int(size[g].max())
            if w > VERY_LONG:  # a trie of one word is a line
                p = words.points[starts[g[0]] : starts[g[0]] + w]
                taken, lengths = long_path(p, pieces)
                out[g] = np.where(taken >= 0, 1, utf8_size(p))[lengths > 0].sum()
                continue
            where = starts[g, None] + np.arange(w)
            matrix = np.where(np.arange(w) < size[g, None], words.points[np.minimum(where, len(words.points) - 1)], 0).astype(np.uint32)
            order = np.argsort(np.ascontiguousarray(matrix.astype(">u4")).view(f"V{4 * w}").ravel(), kind="stable") if w <= LONGER else np.arange(len(g))
            out[g[order]] = _trie_counts(matrix[order], size[g][order], pieces)
    return np.bincount(owner, weights=out, minlength=len(words.off) - 1).astype(np.int64)


def count_tokens(docs: DataFrame, model_file: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens (as many ids as encoding gives), n_pretokens.

    A narrow pass; the vocabulary is broadcast (bounded by the model file). Null and empty texts count 0; whole texts
    of any length; ids may be null or repeated; extra columns are ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = pretokens(part.column("text"), pieces.value)
                counts = count_words(words, pieces.value) if len(words.which) else np.zeros(0, np.int64)
                total = segment_sum(counts[words.which], words.row_off).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total), pa.array(np.diff(words.row_off))], ["id", "n_tokens", "n_pretokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n_tokens bigint, n_pretokens bigint").withColumnRenamed("id", id_col)
