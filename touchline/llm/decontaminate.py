"""Benchmark decontamination by a random-walk embedding of edit distance and bit-sampling LSH.

Texts are normalised (A-Z lower-cased, a run of white space is one blank, none at the ends). The CGK embedding reads a window with a walk: each step
writes the symbol under the cursor and moves on or stays, as a random table says for that step and symbol; windows a few edits apart
fall into step again, so edit distance becomes Hamming distance. LSH keys are symbols sampled at random steps, several times and for
several walks. Item-sized windows of a document are those that begin where one of the item's anchors stands, shifted back by the anchor's
place in the item; a key shared with the item's window at that anchor makes a candidate. Anchors are the item's longest words, and
rare runs of GRAM bytes all over it, which are looked for at every byte of a document, so that no blanks are needed around them.
Candidates are verified exactly: Myers' bit-vector edit distance of the whole item against the best substring near the window.
A long item needs only one of its places of entry to survive edits, which gives the recall that the tests measure.

Items of up to EXACT_ITEM code points are too short for that and are found without loss. Of parts of up to 64 code points one has its
share of the allowed edits or fewer, and of that part's pieces, one more than those edits, one is unchanged. Where a piece stands, Myers'
algorithm runs in numpy over the part's window; what comes near enough is verified like the other candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .textkit import LOWER, SPACE, U64, Hasher, mix, slices, text_bytes, word_spans

#: An item is found where a substring is within this share of the item's length (in code points) by edit distance.
EDIT_SHARE = 0.15
#: Items of up to so many code points are searched by their unchanged pieces.
EXACT_ITEM = 128
#: Words that are places of entry of an item, walks, samples of each walk, and symbols of a sample.
ANCHORS, WALKS, SAMPLES, SYMBOLS = 16, 2, 6, 6
#: Runs of bytes that are places of entry beside the words, and their length.
GRAMS, GRAM = 16, 8
#: Steps of the walks that are sampled (a walk goes on a byte in two steps: the first ones read the anchor, which is known to be
#: equal and tells nothing).
STEPS = (24, 96)
#: Bytes of item texts that are broadcast at once. A larger benchmark is searched in so many blocks.
BLOCK_BYTES = 8 << 20

_rng = np.random.default_rng(424242)
MOVES = _rng.integers(0, 2, (WALKS, STEPS[1], 256)).astype(np.int32)
MOVES[:, :, 0] = 0  # a walk stays at the end of its text, a zero byte
PICKS = np.sort(np.stack([[_rng.choice(np.arange(*STEPS), SYMBOLS, replace=False) for _ in range(SAMPLES)] for _ in range(WALKS)]), -1)


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the normalised texts one after the other, and their offsets."""
    buf, off = text_bytes(column)
    buf = LOWER[buf]
    blank = SPACE[buf]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    keep[begins] = ~blank[begins]
    ends = off[1:][off[:-1] < off[1:]] - 1
    keep[ends] &= ~blank[ends]
    # a run of blanks at the end of a text leaves its first blank: cut it
    counts = np.concatenate([[0], np.cumsum(keep)])
    out, at = np.where(blank, np.uint8(0x20), buf)[keep], counts[off]
    tails = at[1:][at[:-1] < at[1:]] - 1
    tails = tails[out[tails] == 0x20]
    left = np.ones(len(out), bool)
    left[tails] = False
    return out[left], at - np.searchsorted(tails, at)


def closed(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The texts with a zero byte behind each: what begins at b in the n-th text begins at b + n here."""
    out = np.zeros(len(buf) + len(off) - 1, np.uint8)
    keep = np.ones(len(out), bool)
    keep[off[1:] + np.arange(len(off) - 1)] = False
    out[keep] = buf
    return out


def walk_keys(texts: np.ndarray, starts: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """LSH keys of the windows that begin at starts of closed texts, each with the hash of its anchor: a row of WALKS * SAMPLES."""
    keys, sample = np.empty((len(starts), WALKS * SAMPLES), U64), np.zeros((len(starts), 8), np.uint8)  # a sample's symbols fit a word
    for w in range(WALKS):
        trace, pos = np.empty((STEPS[1], len(starts)), np.uint8), starts.astype(np.int32)
        for t in range(STEPS[1]):
            c = np.take(texts, pos, out=trace[t])
            pos += MOVES[w, t][c]
        for s in range(SAMPLES):
            sample[:, :SYMBOLS] = trace[PICKS[w, s]].T
            salt = U64((w * SAMPLES + s + 1) * 0x9E3779B97F4A7C15 + STEPS[1] & 0xFFFFFFFFFFFFFFFF)
            keys[:, w * SAMPLES + s] = mix((anchors ^ salt) + sample.view(U64)[:, 0])
    return keys


def best_substring_distance(item: str, text: str, most: int) -> int:
    """Least edit distance of item to any substring of text, or most + 1 if it is larger (Myers 1999, one big integer a column)."""
    if item in text:
        return 0
    m = len(item)
    places: dict[str, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = places.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus, minus = (down | ~(d0 | up)) & full, up & d0
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(d0 | plus)) & full, plus & d0
        best = min(best, score)
    return best if best <= most else most + 1


def runs(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros stand behind the end."""
    return np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,)).copy()


def slots_of(values: np.ndarray, bits: int = 20) -> np.ndarray:
    return ((values * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def known(values: np.ndarray, wanted: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where values are among the sorted wanted ones; table marks the slots of those."""
    maybe = np.flatnonzero(table[slots_of(values)])
    at = np.searchsorted(wanted, values[maybe])
    return maybe[wanted[np.minimum(at, len(wanted) - 1)] == values[maybe]] if len(wanted) else maybe[:0]


def table_of(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[slots_of(values)] = True
    return table


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges low to high one after the other, and the range of each."""
    many = high - low
    which = np.repeat(np.arange(len(many)), many)
    return low[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many), which


def folded(points: np.ndarray) -> np.ndarray:
    """One of 64 groups for each code point."""
    return ((points + (points >> 5) * 11) & 63).astype(np.int64)


class Pieces:
    """Of items up to EXACT_ITEM code points: parts of up to 64, and by their bytes (eight at most) the pieces of which one stays unchanged."""

    def __init__(self, items: list[int], texts: list[str], edit_share: float):
        item, points, most, masks, whole, rows = [], [], [], [], [], {}
        for k, text in zip(items, texts, strict=True):
            m = len(text)
            edits, n = int(edit_share * m), -(-m // 64)
            cuts = [i * m // n for i in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = edits // n
                mask = np.zeros(64, U64)
                np.bitwise_or.at(mask, folded(np.array([ord(c) for c in text[a:b]], np.uint32)), U64(1) << np.arange(b - a).astype(U64))
                n_pieces = min(own + 1, b - a)
                for i in range(n_pieces):
                    c, d = a + i * (b - a) // n_pieces, a + (i + 1) * (b - a) // n_pieces
                    seed = text[c:d].encode()[:8]
                    rows.setdefault(len(seed), []).append((int.from_bytes(seed, "little"), len(item), c - a, len(text[:c].encode())))
                item.append(k), points.append(b - a), most.append(own), whole.append(edits), masks.append(mask)
        self.item, self.points, self.most, self.whole = (np.array(x, np.int64) for x in (item, points, most, whole))
        self.masks = np.concatenate(masks) if masks else np.zeros(0, U64)
        self.pad = int((self.points + 2 * self.most).max(initial=0)) + 64
        self.seeds = {}
        for size, found in rows.items():
            found.sort()
            value = np.array([x[0] for x in found], U64)
            self.seeds[size] = (value, table_of(value), *(np.array([x[k] for x in found], np.int64) for k in (1, 2, 3)))

    def near(self, part: np.ndarray, start: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Whether the windows from start on may hold the parts within their edits (code points count by their groups, so never too few)."""
        score = self.points[part]
        top, base, limit = U64(1) << (score - 1).astype(U64), part * 64, self.most[part]
        up, down, best = np.full(len(part), 0xFFFFFFFFFFFFFFFF, U64), np.zeros(len(part), U64), score.copy()
        for t in range(int((score + 2 * limit).max(initial=0))):
            eq = self.masks[base + groups[start + t]]
            x = eq | down
            d0 = (((x & up) + up) ^ up) | x
            plus, minus = down | ~(d0 | up), up & d0
            score = score + ((plus & top) != 0) - ((minus & top) != 0)
            plus, minus = plus << U64(1), minus << U64(1)
            up, down = minus | ~(d0 | plus), plus & d0
            np.minimum(best, score, out=best)
        return best <= limit

    def candidates(self, buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        if not self.seeds or not len(buf):
            return
        # a byte outside UTF-8 is a code point of its own
        points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        size[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
        begins = np.cumsum(size) - size
        groups = np.concatenate([np.zeros(self.pad, np.int64), folded(points), np.zeros(self.pad, np.int64)])
        eight = runs(buf)
        for n_bytes, (value, table, part, before, ahead) in self.seeds.items():
            v = eight & U64((1 << 8 * n_bytes) - 1)
            at = known(v, value, table)
            low, high = np.searchsorted(value, v[at], "left"), np.searchsorted(value, v[at], "right")
            ends = np.cumsum(high - low)
            cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, 1 << 14)), [len(at)]]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                entry, which = expanded(low[a:b], high[a:b])
                own, p = at[a:b][which], part[entry]
                good = self.near(p, np.searchsorted(begins, own) - before[entry] - self.most[p] + self.pad, groups)
                own, p, entry = own[good], p[good], entry[good]
                found = np.stack([np.searchsorted(off, own, "right") - 1, self.item[p], own - ahead[entry]], 1)
                same = self.whole[p] == 0  # a verbatim item: one place of a row will do
                yield found[~same]
                yield found[same][np.unique(found[same][:, :2], axis=0, return_index=True)[1]]


@dataclass
class Index:
    """Of a block of items: sorted LSH keys with item and place of each, sorted hashes of the anchor words, sorted anchor runs of bytes, the pieces of short items, and the normalised texts."""

    ids: list
    texts: list[bytes]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    words: np.ndarray
    grams: np.ndarray
    pieces: Pieces

    def __post_init__(self):
        """Slots by the keys' first bits, sixteen a key or more: most keys of a document meet an empty one and aren't searched for."""
        self.shift = U64(64 - max(16, (16 * len(self.keys)).bit_length()))
        self.slots = np.zeros(1 << int(U64(64) - self.shift), bool)
        self.slots[(self.keys >> self.shift).astype(np.int64)] = True
        self.word_table, self.gram_table = table_of(self.words), table_of(self.grams)

    def __len__(self) -> int:
        return len(self.keys) + len(self.pieces.item)


def build_index(ids: list, texts: list[str | None], edit_share: float = EDIT_SHARE) -> Index:
    buf, off = normalized(pa.array(texts, pa.string()))
    keys, items, places, words, grams, short = [], [], [], [], [], []
    starts, ends, word_off = word_spans(buf, off)
    hashed = Hasher(buf)(starts, ends)
    ended, eight, raw = closed(buf, off), runs(buf), buf.tobytes()
    value, which, often = np.unique(eight, return_inverse=True, return_counts=True)
    often = often[which] if len(value) else often
    for k in range(len(ids)):
        a, b = int(off[k]), int(off[k + 1])
        if len(raw[a:b].decode()) <= EXACT_ITEM:
            short += [k] * (b > a)
            continue
        last = b - int(0.6 * STEPS[1])  # a walk of so many steps reaches half as far
        own = np.arange(word_off[k], word_off[k + 1])
        room = own[starts[own] <= last]
        chosen = room[np.lexsort((starts[room], starts[room] - ends[room]))][:ANCHORS]
        cuts = np.linspace(a, last + 1, GRAMS + 1).astype(int)  # the rarest run of each stretch
        rare = np.array([c + np.lexsort((mix(eight[c:d]), often[c:d]))[0] for c, d in zip(cuts, cuts[1:], strict=False)])
        at, anchors = np.concatenate([starts[chosen], rare]), np.concatenate([hashed[chosen], mix(eight[rare])])
        found = walk_keys(ended, at + k, anchors)
        keys.append(found.ravel())
        items.append(np.full(found.size, k))
        places.append(np.repeat(at - a, found.shape[1]))
        words.append(hashed[chosen])
        grams.append(eight[rare])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    keys = join(keys, U64)
    order = np.argsort(keys, kind="stable")
    texts = [raw[off[k] : off[k + 1]] for k in range(len(ids))]
    pieces = Pieces(short, [texts[k].decode() for k in short], edit_share)
    return Index(list(ids), texts, keys[order], join(items, np.int64)[order], join(places, np.int64)[order], np.unique(join(words, U64)), np.unique(join(grams, U64)), pieces)


def candidates(buf: np.ndarray, off: np.ndarray, index: Index) -> np.ndarray:
    """Distinct (row, item, supposed begin of the item in the buffer), sorted."""
    found = list(index.pieces.candidates(buf, off))
    if len(index.keys):
        starts, ends, _ = word_spans(buf, off)
        h, eight = Hasher(buf)(starts, ends), runs(buf)
        texts = closed(buf, off)
        own, rare = known(h, index.words, index.word_table), known(eight, index.grams, index.gram_table)
        place, anchors = np.concatenate([starts[own], rare]), np.concatenate([h[own], mix(eight[rare])])
        row = np.searchsorted(off, place, "right") - 1
        for k in range(0, len(place), 20_000):
            own, r = place[k : k + 20_000], row[k : k + 20_000]
            keys = walk_keys(texts, own + r, anchors[k : k + 20_000])
            met = np.flatnonzero(index.slots[(keys >> index.shift).astype(np.int64)])
            wanted = keys.ravel()[met]
            entry, which = expanded(np.searchsorted(index.keys, wanted, "left"), np.searchsorted(index.keys, wanted, "right"))
            window = met[which] // keys.shape[1]
            found.append(np.stack([r[window], index.item[entry], own[window] - index.place[entry]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _search(index, edit_share: float, id_name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = normalized(part.column("text"))
                raw, best = buf.tobytes(), {}
                reached: dict[tuple[int, int], int] = {}
                for row, item, begin in candidates(buf, off, ix).tolist():
                    text = ix.texts[item]
                    slack, points = int(edit_share * len(text)) + 4, text.decode()
                    around = (5 if len(points) <= EXACT_ITEM else 2) * slack  # an edit of a short item may shift by four bytes
                    if best.get((row, item)) == 0 or begin < reached.get((row, item), -1):
                        continue  # this region has been looked at
                    a, b = max(int(off[row]), begin - around), min(int(off[row + 1]), begin + len(text) + around)
                    reached[row, item] = begin + slack
                    most = int(edit_share * len(points))
                    d = best_substring_distance(points, raw[a:b].decode("utf-8", "ignore"), most)
                    if d <= most:
                        best[row, item] = min(d, best.get((row, item), d))
                if best:
                    rows, items = zip(*best, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array([ix.ids[k] for k in items], pa.int64()), pa.array(list(best.values()), pa.int64())], ["id", "item_id", "distance"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item_id, distance (least edit distance found).

    Documents without an item give no row. The items' size is summed first; up to block_bytes of them are indexed and broadcast,
    a larger benchmark is cut into blocks by a hash of the item id and each block searches all documents. Null and empty texts, null ids and empty items
    match nothing; repeated rows give one row; extra columns are ignored. Texts are searched whole. Item ids must be integers.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id is not null and item is not null").distinct()
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for k in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        index = build_index([r["item_id"] for r in rows], [r["item"] for r in rows], edit_share)
        if not len(index) and (found is not None or k < blocks - 1):
            continue
        part = slim.mapInArrow(_search(spark.sparkContext.broadcast(index), edit_share, id_col), f"id {kind}, item_id bigint, distance bigint")
        part = part if len(index) else part.where("false")
        found = part if found is None else found.union(part)
    return found.groupBy("id", "item_id").agg(F.min("distance").alias("distance")).withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with their own columns.

    Each text is judged by itself, whatever its id: a row without id that holds an item goes, and of rows that share an id those
    that hold one go. Null and empty texts stay; without items, everything stays; an empty table gives an empty table.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    gone = leaks(docs.select(digest.alias("__leaked"), F.col(text_col).alias("text")), benchmark, "__leaked", "text").select("__leaked").distinct()
    own = free_name(docs, "__digest")
    keyed = docs.withColumn(own, digest)
    return keyed.join(gone, keyed[own] == gone["__leaked"], "left_anti").drop(own)
