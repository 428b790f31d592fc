"""Language identification in two steps: the family, then one-versus-one linear machines inside it.

Features are hashed byte n-grams of the lower-cased text (square roots of their shares, unit length). A linear support
vector machine for each family against the others picks the family; the languages of the family then meet
pairwise, and the one with most wins (ties: larger sum of margins) is predicted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded
from .textkit import U64, crc_held_out, segment_ids, slices, text_bytes

#: Hash buckets, n-gram lengths in bytes, and the bound of the fitting sample: texts of all languages together.
DIMENSIONS, NGRAMS, FIT_DOCS = 4096, (1, 2, 3), 2400
#: Times the sample that is held at most where ids repeat.
MOST = 1.5
#: Rows whose features are made at once (16 KB a row).
BLOCK_ROWS = 256
#: Languages of a family by ISO 639-1 code. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of BLOCK_ROWS rows at most and about 1 MB of text, so that their dense features stay small."""
    for part in slices(batch, "text", 1 << 20):
        for k in range(0, part.num_rows, BLOCK_ROWS):
            yield part.slice(k, BLOCK_ROWS)


def features(column: pa.Array) -> np.ndarray:
    """A row of DIMENSIONS values for each text; zeros for a null or empty one."""
    buf, off = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(off) - 1
    row = segment_ids(off)
    total = np.zeros(n * DIMENSIONS)
    h = np.zeros(len(buf), U64)
    for k in range(1, max(NGRAMS) + 1):
        h = h[: len(buf) - k + 1] * U64(0x100000001B3) + buf[k - 1 :].astype(U64) + U64(1)
        if k in NGRAMS and len(h):
            whole = row[: len(h)] == row[k - 1 :]
            slot = ((h * U64(0x9E3779B97F4A7C15)) >> U64(52)).astype(np.int64)
            total += np.bincount((row[: len(h)] * DIMENSIONS + slot)[whole], minlength=n * DIMENSIONS)
    x = np.sqrt(total.reshape(n, DIMENSIONS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(pc.fill_null(column, ""), r"\p{L}").to_numpy(zero_copy_only=False)


def linear_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with hinge loss, by averaged stochastic subgradients; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, step, size = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), 0, 32
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(x1)), max(1, len(x1) // size)):
            step += 1
            miss = y[batch] * (x1[batch] @ w) < 1
            grad = -((y[batch] * weight[batch])[miss, None] * x1[batch][miss]).sum(0) / len(batch)
            w = w * (1 - 1 / (step + 10)) - grad / (reg * 100 * (step + 10))
            if epoch >= epochs // 2:
                mean += w
    return mean / max(np.abs(x1 @ mean).mean(), 1e-9)


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        x = features(column)
        x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x1 @ self.family_weights.T
        best = margins.argmax(1) if len(self.families) else np.zeros(len(x), int)
        score = 1 / (1 + np.exp(-3 * np.clip(margins.max(1), -10, 10))) if len(self.families) > 1 else np.ones(len(x))
        lang = np.full(len(x), "und", object)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            langs = self.members[family]
            votes, sums, low = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for i, j in combinations(range(len(langs)), 2):
                m = x1[rows] @ self.pairs[langs[i], langs[j]]
                for a, v in ((i, m), (j, -m)):
                    votes[:, a] += v > 0
                    sums[:, a] += np.tanh(v)
                    low[:, a] = np.minimum(low[:, a], v)
            pick = (votes + 1e-3 * sums).argmax(1)
            lang[rows] = np.array(langs, object)[pick]
            if len(langs) > 1:
                score[rows] *= 1 / (1 + np.exp(-3 * np.clip(low[np.arange(len(rows)), pick], -10, 10)))
        none = ~has_letter(column)
        lang[none], score[none] = "und", 0.0
        return lang.tolist(), score


def fit(x: np.ndarray, langs: list[str]) -> Model:
    members: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        members.setdefault(FAMILY_OF.get(code, code), []).append(code)
    families = sorted(members)
    fam = np.array([FAMILY_OF.get(c, c) for c in langs], object)
    lang = np.array(langs, object)
    weights = np.array([linear_svm(x, np.where(fam == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.zeros((len(families), DIMENSIONS + 1))
    pairs = {}
    for codes in members.values():
        for a, b in combinations(codes, 2):
            own = (lang == a) | (lang == b)
            pairs[a, b] = linear_svm(x[own], np.where(lang[own] == a, 1.0, -1.0))
    return Model(families, members, weights, pairs)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, holdout: tuple[int, int], fit_docs: int = FIT_DOCS) -> Model:
    """Fit on a bounded sample of labelled rows: about fit_docs in all, shared equally by the languages, by a hash of the id.

    Rows that share an id are chosen together, so what is chosen is bounded once more: equal rows count once, and of more than
    MOST times fit_docs rows those with the smallest hashes of id and text stay.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and id is not null")
    known = known.where(F.crc32(F.col("id").cast("string")) % holdout[0] != holdout[1])
    have = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not have:
        return Model([], {}, np.zeros((0, DIMENSIONS + 1)), {})
    each = max(1, fit_docs // len(have))
    take = F.create_map(*[x for k, n in sorted(have.items()) for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < take[F.col("lang")] * (1 << 30))
    picked = bounded(picked, ["id", "text", "lang"], int(MOST * fit_docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                keep = part.filter(pa.array(has_letter(part.column("text"))))
                x = features(keep.column("text"))
                yield pa.RecordBatch.from_arrays([keep.column("id").cast(pa.string()), keep.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "lang", "x"])

    rows = sorted(picked.mapInArrow(run, "id string, lang string, x binary").collect(), key=lambda r: (r["id"], r["lang"], bytes(r["x"])))
    if not rows:
        return Model([], {}, np.zeros((0, DIMENSIONS + 1)), {})
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", holdout: tuple[int, int] = (3, 1)) -> DataFrame:
    """One row per input row: id, held_out, lang_pred (a learned value, or und), score (0 to 1).

    und with score 0 where the text is null or has no letter, or where nothing could be learned. Whole texts of any length;
    ids may be null or repeated; extra columns are ignored. Fitting takes a bounded sample, scoring is one narrow pass.
    The language column is one of codes: the model has a machine for each of its families and each pair inside a family (16 to 33 KB each).
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, holdout))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                if model.value.families:
                    lang, score = model.value.predict(part.column("text"))
                else:
                    lang, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(crc_held_out(part.column("id"), *holdout)), pa.array(lang, pa.string()), pa.array(np.asarray(score, np.float64))], ["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
