"""Toxicity by subword-bag embeddings.

Words are bags of hashed character n-grams (and of themselves); the embeddings of a window of words are averaged
and a linear softmax decides. Embeddings and softmax are trained jointly in numpy, so a spelling that was never
seen shares the vectors of its n-grams. A text is as toxic as its most toxic window: training repeats with the
windows of toxic documents that the last round held for toxic (multiple-instance learning), so a few words in a long text
are not averaged away.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded
from .textkit import U64, Hasher, crc_held_out, segment_ids, segment_sum, slices, text_bytes

#: Subword buckets, width of the embeddings, n-gram lengths in bytes, words in a window.
BUCKETS, WIDTH, NGRAMS, WINDOW = 1 << 17, 8, (3, 4, 5, 6), 12
#: A subword counts only if it is in so many documents of the sample: what is in fewer tells nothing of others.
MIN_DOCUMENTS = 3
#: Bounds of the fitting sample: documents of each label, and the longest text in bytes among them.
FIT_DOCS, FIT_BYTES = 1500, 1 << 13
#: Times the sample that is held at most where ids repeat.
MOST = 1.5

#: Bytes of words: letters, digits and all of non-ASCII text.
WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text column: subword ids of the distinct words, their offsets, the distinct word at each place, and the words' offsets by row."""
    buf, off = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(off) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    inside = WORDY[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    first[off[:-1][full]] = inside[off[:-1][full]]
    last[off[1:][full] - 1] = inside[off[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashed = Hasher(buf)
    _, at, word = np.unique(hashed(starts, ends), return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    counts = np.stack([np.ones_like(s), *(np.maximum(e - s - k + 1, 0) for k in NGRAMS)])
    bag_off = np.concatenate([[0], np.cumsum(counts.sum(0))])
    place = bag_off[:-1] + np.cumsum(counts, 0) - counts  # where the n-grams of a length begin in a word's bag
    ids = np.empty(bag_off[-1], np.int32)
    ids[place[0]] = hashed(s, e) & U64(BUCKETS - 1)
    for k, count, at_ in zip(NGRAMS, counts[1:], place[1:], strict=True):
        who = np.repeat(np.arange(len(s), dtype=np.int32), count)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        begin = s[who] + nth
        edge = (begin == s[who]).astype(U64) + U64(2) * (begin + k == e[who]).astype(U64)  # n-grams at an edge are others
        h = (hashed(begin, begin + k) + edge * U64(0x9E3779B97F4A7C15)) >> U64(20)
        ids[at_[who] + nth] = h & U64(BUCKETS - 1)
    return ids, bag_off, word, np.searchsorted(starts, off)


def windows(word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of windows over the words, and of the rows over the windows. A short rest joins the window before it."""
    n = np.diff(word_off)
    count = np.where(n > 0, np.maximum(1, (n + WINDOW // 2) // WINDOW), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = word_off[:-1][row] + k * WINDOW
    return np.append(begin, word_off[-1]), np.concatenate([[0], np.cumsum(count)])


def first_in_window(word: np.ndarray, win_off: np.ndarray) -> np.ndarray:
    """Whether a word is the first of its kind in its window. Repeats add nothing to a window's sum but do to its size, so
    that a single word said twelve times weighs as much as among eleven others."""
    key = np.repeat(np.arange(len(win_off) - 1), np.diff(win_off)) * (int(word.max(initial=0)) + 1) + word
    fresh = np.zeros(len(word), bool)
    fresh[np.unique(key, return_index=True)[1]] = True
    return fresh


@dataclass
class Model:
    """What scoring needs: the logit that each subword adds to the average, the bias, and the calibration."""

    subword: np.ndarray
    bias: float
    slope: float
    shift: float
    clean: float

    def highest(self, column: pa.Array) -> np.ndarray:
        """The logit of each row's most toxic window; that of a typical clean text where there is no word."""
        ids, bag_off, word, word_off = bags(column)
        per_word, size = segment_sum(self.subword[ids], bag_off), np.diff(bag_off)
        win_off, row_off = windows(word_off)
        top = np.full(len(column), self.clean)
        if len(win_off) > 1:
            fresh = first_in_window(word, win_off)
            logit = np.add.reduceat(per_word[word] * fresh, win_off[:-1]) / np.add.reduceat(size[word], win_off[:-1]) + self.bias
            full = row_off[:-1] < row_off[1:]
            top[full] = np.maximum.reduceat(logit, row_off[:-1][full])
        return top

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(column) + self.shift, -50, 50)))


def fit(texts: list[str], labels: np.ndarray, population: dict[int, int] | None = None, epochs: int = 3, rounds: int = 3, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax (adaptive gradient steps) on four fifths of the rows, then a logistic
    calibration of the highest window on the rest. Every fifth row of each label is of the rest, where each label has 10 rows."""
    labels = np.asarray(labels, int)
    order = np.concatenate([np.flatnonzero(labels == c) for c in (0, 1)])
    place = np.concatenate([np.arange((labels == c).sum()) for c in (0, 1)])
    rest = np.zeros(len(labels), bool)
    if min((labels == 0).sum(), (labels == 1).sum()) >= 10:
        rest[order[place % 5 == 4]] = True
    model = _fit([t for t, r in zip(texts, rest, strict=True) if not r], labels[~rest], epochs, rounds, seed)
    use = rest if rest.any() else ~rest
    if model.slope:
        _calibrate(model, pa.array([t for t, u in zip(texts, use, strict=True) if u], pa.string()), labels[use], population or {})
    return model


def _calibrate(model: Model, column: pa.Array, labels: np.ndarray, population: dict[int, int]) -> None:
    """Slope and shift of the logistic curve that fits labels best; each label weighs as the square root of its rows in the
    population, half-way between equal weights and the labels' own shares."""
    x = model.highest(column)
    t = labels.astype(float)
    own = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
    each = {c: np.sqrt(max(population.get(c, 0), own[c])) / own[c] for c in (0, 1)}
    weight = np.where(labels == 1, each[1], each[0])
    weight /= weight.mean()
    centre, scale = x.mean(), x.std() + 1e-9
    a, b = 1.0, 0.0
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(a * (x - centre) / scale + b, -50, 50)))
        a -= 0.5 * (weight * (p - t) * (x - centre) / scale).mean() + 1e-4 * a
        b -= 0.5 * (weight * (p - t)).mean()
    model.slope, model.shift = a / scale, b - a * centre / scale


def _fit(texts: list[str], labels: np.ndarray, epochs: int, rounds: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    ids, bag_off, word, word_off = bags(pa.array(texts, pa.string()))
    win_off, row_off = windows(word_off)
    n = len(win_off) - 1
    if n <= 0 or len(set(labels.tolist())) < 2:
        rate = float(np.clip(labels.mean() if len(labels) else 0, 1e-3, 1 - 1e-3))
        return Model(np.zeros(BUCKETS, np.float64), 0.0, 0.0, float(np.log(rate / (1 - rate))), 0.0)
    doc = segment_ids(row_off)
    y = labels[doc]
    sizes = np.diff(bag_off)
    seen = np.zeros(BUCKETS, np.int32)
    for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
        w = np.unique(word[a:b])
        count = sizes[w]
        seen[np.unique(ids[np.repeat(bag_off[w], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])] += 1
    shared = (seen >= MIN_DOCUMENTS).astype(np.float32)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32) * shared[:, None]
    out = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((WIDTH, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    fresh = first_in_window(word, win_off)

    def flat(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of the windows, and the window (by place in which) of each."""
        count = (win_off[which + 1] - win_off[which]).astype(int)
        owner = np.repeat(np.arange(len(which)), count)
        place = np.repeat(win_off[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        w, owner = word[place][fresh[place]], owner[fresh[place]]
        c = sizes[w]
        return ids[np.repeat(bag_off[w], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)], np.repeat(owner, c)

    win_size = np.add.reduceat(sizes[word], win_off[:-1])
    use = np.arange(n)
    for _ in range(rounds):
        balance = np.array([0.5 / max(1, (y[use] == c).sum()) for c in (0, 1)]) * len(use)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(use), max(1, len(use) // 256)):
                sub, owner = flat(batch)
                size = win_size[batch].astype(np.float32)[:, None]
                hidden = np.add.reduceat(emb[sub], np.searchsorted(owner, np.arange(len(batch)))) / size
                z = hidden @ out + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), y[batch]] -= 1
                p = (p * balance[y[batch]][:, None] / len(batch)).astype(np.float32)
                back = (p @ out.T) / size
                uniq, place = np.unique(sub, return_inverse=True)
                grad = np.stack([np.bincount(place, weights=back[owner, k], minlength=len(uniq)) for k in range(WIDTH)], 1).astype(np.float32)
                g_emb[uniq] += (grad**2).mean(1)
                emb[uniq] -= 0.3 * grad / np.sqrt(g_emb[uniq])[:, None] * shared[uniq][:, None]
                d_out, d_bias = hidden.T @ p, p.sum(0)
                g_out += d_out**2
                g_bias += d_bias**2
                out -= 0.1 * d_out / np.sqrt(g_out)
                bias -= 0.1 * d_bias / np.sqrt(g_bias)
        subword = (emb @ (out[:, 1] - out[:, 0])).astype(np.float64)
        per_word = segment_sum(subword[ids], bag_off)
        logit = np.add.reduceat(per_word[word] * fresh, win_off[:-1]) / win_size + float(bias[1] - bias[0])
        full = row_off[:-1] < row_off[1:]
        top = np.full(len(labels), np.nan)
        top[full] = np.maximum.reduceat(logit, row_off[:-1][full])
        hard = logit >= np.quantile(logit[y == 0], 0.8)  # the clean windows nearest to toxic ones, and a fifth of the others
        use = np.flatnonzero(np.where(y == 0, hard | (rng.random(n) < 0.2), (logit == top[doc]) | (logit > 0)))
    return Model(subword, float(bias[1] - bias[0]), 1.0, 0.0, float(np.median(top[full & (labels == 0)])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, holdout: tuple[int, int] | None = (5, 0)) -> Model:
    """Fit on a bounded sample of labelled rows: about fit_docs of each label, by a hash of the id, of texts up to FIT_BYTES.

    holdout (modulus, remainder) names rows that are never learned from. Rows without id, text or label don't take part. Where labels
    or documents repeat an id, equal rows count once, and of more than MOST times the sample those with the smallest hashes stay.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").distinct()
    if holdout:
        known = known.where(F.crc32(F.col("id").cast("string")) % holdout[0] != holdout[1])
    have = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    take = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(min(1.0, fit_docs / max(1, have.get(k, 0)))))])
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < take[F.col("toxic")] * (1 << 30))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= FIT_BYTES)
    rows = bounded(texts.join(F.broadcast(picked), "id"), ["id", "text", "toxic"], int(MOST * 2 * fit_docs))  # picked: about 2 * fit_docs small rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("id", "text", "toxic")), strict=True)]
        found.sort()
        model = fit([x[1] for x in found], np.array([x[2] for x in found], int), have)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the bounded sample is fitted in one task, so that neither its texts nor the training weigh on the driver
    fitted = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit([], np.zeros(0, int))


def _scores(model, holdout: tuple[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = model.value.score(part.column("text"))
                held = crc_held_out(part.column("id"), *holdout)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(held), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", holdout: tuple[int, int] = (5, 0)) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from 0.5).

    Fitting takes a bounded sample; scoring is one narrow pass with the model (1 MB, whatever the input) broadcast.
    Null and empty texts, and texts without a word, get the score of a typical clean text. Ids may be null or repeated;
    extra columns are ignored; without labelled rows the score is the same for all.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, holdout=holdout))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_scores(model, holdout), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't predicted toxic, with their own columns, in one narrow pass."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col))
    names = docs.columns

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.value.score(part.column(text_col)) < 0.5))

    return docs.mapInArrow(keep, docs.schema).select(*names)
