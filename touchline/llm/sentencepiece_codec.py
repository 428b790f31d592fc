"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Equal pre-tokens of a batch are encoded once. Distinct pre-tokens of equal length advance together: for every end
position, the hashes of all substrings that end there probe the sorted piece keys, and vectorised maxima store the
backpointers. Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import DEFAULT_MODEL, VERY_LONG, Pieces, Words, cut_long, load, long_path, normalize, point_hash, prefix_sums, pretokens
from .textkit import slices, text_bytes

#: Code points of pre-tokens of one length that advance together.
BLOCK = 1 << 20


def _viterbi(points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of code points (a pre-token each row): at each position, whether the best path has a piece that starts
    there, as its place in the sorted keys (-1: an unknown character), and the piece's length (0: none starts)."""
    n, length = points.shape
    sums = prefix_sums(points)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.ones((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
    for end in range(1, length + 1):
        for size in range(min(end, pieces.longest), 0, -1):
            at = pieces.probe(point_hash(sums, end - size, end))
            if size == 1:
                gain = np.where(at >= 0, pieces.scores[at], pieces.unknown)
                rows = slice(None)
            else:
                rows = np.flatnonzero(at >= 0)
                if not len(rows):
                    continue
                at = at[rows]
                gain = pieces.scores[at]
            total = best[rows, end - size] + gain
            better = total > best[rows, end]
            rows = np.flatnonzero(better) if size == 1 else rows[better]
            best[rows, end], back[rows, end], piece[rows, end] = total[better], size, at[better]
    taken, lengths = np.full((n, length), -1, np.int32), np.zeros((n, length), np.int32)
    end, live = np.full(n, length), np.arange(n)
    while len(live):
        e = end[live]
        start = e - back[live, e]
        taken[live, start], lengths[live, start] = piece[live, e], e - start
        end[live] = start
        live = live[start > 0]
    return taken, lengths


def encode_words(words: Words, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the distinct pre-tokens one after the other, and their offsets."""
    starts, ends, owner = cut_long(words, pieces)
    size = ends - starts
    taken, lengths = np.full(len(words.points), -1, np.int32), np.zeros(len(words.points), np.int32)
    for length in np.unique(size[size > 0]).tolist():
        own = starts[size == length]
        if length > VERY_LONG:
            for a in own.tolist():
                taken[a : a + length], lengths[a : a + length] = long_path(words.points[a : a + length], pieces)
            continue
        for k in range(0, len(own), step := max(1, BLOCK // length)):
            where = own[k : k + step, None] + np.arange(length)
            taken[where], lengths[where] = _viterbi(words.points[where], pieces)
    at = np.flatnonzero(lengths)
    known = taken[at] >= 0
    points = words.points[at]
    raw = np.frombuffer("".join(map(chr, points[~known].tolist())).encode(), np.uint8)
    width = np.ones(len(at), np.int64)
    width[~known] = 1 + (points[~known] > 0x7F).astype(np.int64) + (points[~known] > 0x7FF) + (points[~known] > 0xFFFF)
    spread = np.repeat(known, width)
    ids = np.empty(len(spread), np.int32)
    ids[spread] = pieces.ids[taken[at[known]]]
    ids[~spread] = pieces.byte_ids[raw]
    word = np.repeat(np.searchsorted(words.off, at, "right") - 1, width)
    return ids, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words.off) - 1))])


def ragged(values: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values (by off) in the order of which, and where each begins."""
    size = (off[1:] - off[:-1])[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(off[which] - ends[:-1], size) + np.arange(ends[-1])], ends


def encode(column: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and their offsets by row."""
    words = pretokens(column, pieces)
    if not len(words.which):
        return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
    ids, off = encode_words(words, pieces)
    flat, ends = ragged(ids, off, words.which)
    return flat, ends[words.row_off]


def decode(ids: np.ndarray, off: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of rows of ids, one blank in front removed, and their offsets. Invalid ids raise IndexError."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(pieces.text)):
        raise IndexError(f"ids are from 0 to {len(pieces.text) - 1}")
    table = np.frombuffer(b"".join(pieces.text), np.uint8)
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in pieces.text])])
    data, ends = ragged(table, sizes, ids.astype(np.int64))
    rows = ends[off]
    lead = rows[:-1][rows[:-1] < rows[1:]]
    lead = lead[data[lead] == 0x20]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], rows - np.searchsorted(lead, rows)


def encode_documents(docs: DataFrame, model_file: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (array of int), round_trip (decoding gives the text back).

    A narrow pass; the vocabulary is broadcast (its size is the model file's, not the corpus's). Null and empty texts give no ids and
    round_trip true; a text with the visible blank U+2581 comes back with plain blanks, which round_trip holds against
    the normalised text. Whole texts of any length; ids may be null or repeated; extra columns are ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, off = encode(part.column("text"), pieces.value)
                got, got_off = decode(ids, off, pieces.value)
                want, want_off = text_bytes(normalize(part.column("text")))
                sizes = want_off[1:] - want_off[:-1]
                same = got_off[1:] - got_off[:-1] == sizes - (sizes > 0)
                a, b, c = got.tobytes(), want.tobytes(), want_off.tolist()
                g = got_off.tolist()
                same &= np.array([a[g[i] : g[i + 1]] == b[c[i] + 1 : c[i + 1]] for i in range(len(sizes))], bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), pa.array(same)], ["id", "n_tokens", "ids", "round_trip"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n_tokens bigint, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_file: str = DEFAULT_MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and the decoded text; null ids give an empty text, a null among them is left out, bytes that aren't UTF-8 become U+FFFD.
    Ids that the vocabulary doesn't have, negative ones too, raise IndexError."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[i for i in x or () if i is not None] for x in batch.column("ids").to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            data, rows = decode(np.array([i for x in lists for i in x], np.int64), off, pieces.value)
            raw, r = data.tobytes(), rows.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(r, r[1:], strict=False)], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
