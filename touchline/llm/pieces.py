"""A SentencePiece vocabulary as arrays, and the pre-tokens (words) within which its pieces lie.

The model file is read on the driver; what tasks get is a broadcast of its pieces (bounded by the vocabulary). The
segmentation of a text is the one whose piece scores have the largest sum, as a unigram model decides, ties going to the
longer last piece. A unigram file's scores are taken as they are. A merge file (BPE) holds minus the rank of each merge
instead, which are no log-probabilities; by Zipf's law rank r becomes -log(r + ZIPF_SHIFT), so that frequent whole words win
over their parts. A character that no piece covers costs UNKNOWN_PENALTY below the lowest score and becomes its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import U64, Hasher, mix, powers, text_bytes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The visible blank of the format, and the cost of an unknown character.
BLANK, UNKNOWN_PENALTY = "▁", 10.0
#: Added to merge ranks before the logarithm. Runs of blanks have no rank in merge files; theirs is one beyond the last.
ZIPF_SHIFT = 100.0
#: A pre-token longer than this is cut further, at character pairs that no piece contains.
LONG = 48
#: Multiplier for hashes of code points.
STEP = U64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


@dataclass
class Pieces:
    """keys: sorted substring hashes; ids and scores in their order; text: bytes of each id as decoded; byte_ids: id of each byte."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    present: np.ndarray
    longest: int
    unknown: float
    byte_ids: np.ndarray
    text: list[bytes]
    pairs: np.ndarray
    cuts: str

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Place in keys of each hash, -1 where there is none; a bit table turns most misses away first."""
        out = np.full(h.shape, -1, np.int64)
        maybe = np.flatnonzero(self.present[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
        if len(maybe):
            own = h[maybe]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == own, at, -1)
        return out


def point_hash(sums: np.ndarray, start, end) -> np.ndarray:
    """Hash of code points start..end from prefix sums along the last axis (one column for each end)."""
    _, down = powers(max(64, sums.shape[-1]))
    return mix(np.atleast_1d((sums[..., end] - sums[..., start]) * down[start] + U64(end - start)))


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """Prefix sums of hashed code points along the last axis."""
    up, _ = powers(max(64, points.shape[-1]))
    out = np.zeros((*points.shape[:-1], points.shape[-1] + 1), U64)
    np.cumsum(mix(points.astype(U64) * STEP + U64(1)) * up[: points.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fields(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """Number, begin and end of the fields of a serialised message (protocol buffers' wire format)."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    while i < len(raw):
        tag, i = varint(i)
        if tag & 7 == 0:
            end = varint(i)[1]
        elif tag & 7 == 2:
            size, i = varint(i)
            end = i + size
        else:
            end = i + {5: 4, 1: 8}[tag & 7]
        yield tag >> 3, i, end
        i = end


def holds_ranks(proto: bytes) -> bool:
    """Whether a model says that it is of merges (trainer_spec 2, model_type 3, value 2)."""
    for number, a, b in fields(proto):
        if number == 2:
            return any(n == 3 and proto[a + x] == 2 for n, x, _ in fields(proto[a:b]))
    return False


def piece_scores(sp, ids: list[int]) -> np.ndarray:
    """Scores as log-probabilities, rounded to single precision."""
    own = np.array([sp.get_score(i) for i in ids], np.float64)
    if holds_ranks(sp.serialized_model_proto()):
        rank = np.where(own < -1e8, -own[own > -1e8].min() + 1, -own)
        own = -np.log(rank + ZIPF_SHIFT)
    return own.astype(np.float32).astype(np.float64)


@lru_cache(4)
def load(model_file: str = DEFAULT_MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    byte_ids = np.full(256, sp.unk_id(), np.int32)
    text: list[bytes] = []
    for i, name in enumerate(names):
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            text.append(bytes([int(name[3:5], 16)]))
        else:
            text.append(b"" if sp.is_control(i) or sp.is_unknown(i) else name.replace(BLANK, " ").encode())
    plain = [names[i].replace(BLANK, " ") for i in normal]
    hashes = np.array([int(point_hash(prefix_sums(p := code_points(s)), 0, len(p))[0]) for s in plain], U64)
    order = np.argsort(hashes)
    present = np.zeros(1 << FILTER_BITS, bool)
    present[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
    scores = piece_scores(sp, normal)
    pairs = np.unique(np.array([(ord(a) << 21) | ord(b) for s in plain for a, b in zip(s, s[1:], strict=False)], np.int64))
    if any(" " in s.lstrip(" ") for s in plain):
        raise ValueError("a piece has a blank after other characters: words can't be taken one by one")
    cuts = "".join(c for c in "\n" if not any(c in s and len(s) > 1 for s in plain))
    return Pieces(hashes[order], np.array(normal, np.int32)[order], scores[order], present, max(map(len, plain)), float(scores.min() - UNKNOWN_PENALTY), byte_ids, text, pairs, cuts)


@dataclass
class Words:
    """Distinct pre-tokens of a text column. which: distinct pre-token at each place; row_off: places by row; points and off: code points of the distinct ones."""

    which: np.ndarray
    row_off: np.ndarray
    points: np.ndarray
    off: np.ndarray


def normalize(column: pa.Array) -> pa.Array:
    """What is encoded: null is empty, the visible blank is a blank, and a non-empty text gets a blank in front."""
    plain = pc.replace_substring(pc.fill_null(column, ""), BLANK, " ")
    return pc.if_else(pc.equal(pc.binary_length(plain), 0), "", pc.binary_join_element_wise(" ", plain, ""))


def pretokens(column: pa.Array, pieces: Pieces) -> Words:
    """Cut at blanks (a run of blanks begins a pre-token) and around line ends, and count equal pre-tokens once."""
    buf, off = text_bytes(normalize(column))
    n = len(off) - 1
    if not len(buf):
        return Words(np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64))
    blank = buf == 0x20
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    if pieces.cuts:
        line = buf == 0x0A
        cut |= line
        cut[1:] |= line[:-1]
    cut[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(buf))
    _, at, which = np.unique(Hasher(buf)(starts, ends), return_index=True, return_inverse=True)
    size = ends[at] - starts[at]
    flat = buf[np.repeat(starts[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    chars = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return Words(which, np.searchsorted(starts, off), code_points(flat.tobytes().decode()), chars[np.concatenate([[0], np.cumsum(size)])])


def cut_long(words: Words, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of distinct pre-tokens, and the pre-token of each. Only long ones have several parts."""
    size = np.diff(words.off)
    if not (size > LONG).any():
        return words.off[:-1], words.off[1:], np.arange(len(size))
    p = words.points.astype(np.int64)
    key = (p[:-1] << 21) | p[1:]
    inside = np.repeat(size > LONG, size)
    inside[words.off[:-1][size > 0]] = False
    spots = np.flatnonzero(inside)
    at = np.minimum(np.searchsorted(pieces.pairs, key[spots - 1]), len(pieces.pairs) - 1)
    spots = spots[pieces.pairs[at] != key[spots - 1]]
    starts = np.sort(np.concatenate([words.off[:-1], spots]))
    return starts, np.append(starts[1:], words.off[-1]), np.searchsorted(words.off, starts, "right") - 1


def utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


#: A pre-token of more code points is gone through by itself, see long_path.
VERY_LONG = 512


def long_path(points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The best path through one very long pre-token: at each position the piece's place in the sorted keys (-1: an unknown character) and its length, 0 where none starts.

    All substrings of one length probe the keys in one vector operation; what is left for each end is a choice between the pieces found there.
    """
    n = len(points)
    sums, found = prefix_sums(points), []
    for size in range(1, min(pieces.longest, n) + 1):
        start = np.arange(n - size + 1)
        _, down = powers(max(64, n + 1))
        at = pieces.probe(mix((sums[size:] - sums[: n - size + 1]) * down[start] + U64(size)))
        hit = np.flatnonzero(at >= 0)
        found.append(np.stack([hit + size, np.full(len(hit), size), at[hit]]))
    ends, sizes, places = np.concatenate(found, axis=1)
    order = np.lexsort((-sizes, ends))  # of equal sums the longer last piece wins
    sizes, places = sizes[order].tolist(), places[order].tolist()
    bounds = np.searchsorted(ends[order], np.arange(1, n + 2)).tolist()
    gains = pieces.scores[np.array(places, np.int64)].tolist() if places else []
    best, back, piece = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
    for end in range(1, n + 1):
        top = -np.inf
        a, b = bounds[end - 1], bounds[end]
        for k in range(a, b):
            total = best[end - sizes[k]] + gains[k]
            if total > top:
                top, back[end], piece[end] = total, sizes[k], places[k]
        if (a == b or sizes[b - 1] > 1) and best[end - 1] + pieces.unknown > top:
            top, back[end], piece[end] = best[end - 1] + pieces.unknown, 1, -1
        best[end] = top
    taken, lengths, end = np.full(n, -1, np.int32), np.zeros(n, np.int32), n
    while end:
        start = end - back[end]
        taken[start], lengths[start] = piece[end], back[end]
        end = start
    return taken, lengths
