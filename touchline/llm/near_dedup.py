"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's shingle set becomes a signature of b-bit symbols, of which CHUNKS * CHUNK_SYMBOLS are indexed. Two signatures that differ in at most
(ERRORS + 1) * CHUNKS - 1 symbols agree, by the pigeonhole principle, in all but ERRORS symbols of some chunk; so each chunk is
listed under every way to leave out ERRORS of its symbols, and all pairs under that distance share a key. (At similarity
0.75 a pair differs in 12.5 of the 50 indexed symbols on average; the bound guaranteed is 19, and pairs beyond it are still met with
the probability of agreeing in one chunk: in all, a pair at exactly 0.75 is missed once in about 20,000.)

No bucket is expanded into all its pairs. Documents with equal sets are one representative. In a bucket, members are first held
against the smallest one, the best of these pairs first; what is linked so is one component. Only pairs of a bucket that are still in
different components are then compared, in cells of bounded size, by their signatures; whatever passes is confirmed in the cell on full
shingle sets, so no link between components is lost. Components come from hooking and pointer jumping over tables; nothing of this reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, relabel, roots
from .shared import materialize, small
from .textkit import LOWER, U64, Hasher, mix, slices, text_bytes, word_spans

SHINGLE = 5
#: Similarity as a ratio of whole numbers: linked if DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Symbols of a signature and their bits; chunks that are indexed, their symbols, and the errors that are enumerated.
SYMBOLS, BITS, CHUNKS, CHUNK_SYMBOLS, ERRORS = 128, 16, 10, 5, 1
#: Pairs that agree in fewer of the 128 symbols are not verified; at similarity exactly 0.75 that happens once in 30,000, at 0.77 once in a million.
LEAST_AGREE = 76
#: Bytes of a row with a signature, to judge whether a table may be broadcast.
ROW_BYTES = 2 * SYMBOLS + 64
#: Rows of a bucket on either side of a cell of pairs: a task holds twice as many texts at once. Smaller cells copy each row more often.
CELL = 1024

_rng = np.random.default_rng(97531)
WORD_FACTORS = _rng.integers(1, 1 << 63, SHINGLE).astype(U64) * U64(2) + U64(1)
HASH_FACTORS = _rng.integers(1, 1 << 63, SYMBOLS).astype(U64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the rows one after the other, and their offsets. A-Z lower-cased; with fewer words than a
    shingle has, the whole sequence is one; no words give an empty set."""
    buf, off = text_bytes(column)
    buf = LOWER[buf]
    starts, ends, word_off = word_spans(buf, off)
    h = Hasher(buf)(starts, ends)
    n = len(h) - shingle + 1
    grams = sum((h[k : k + n] * WORD_FACTORS[k] for k in range(shingle)), np.zeros(max(0, n), U64)) if n > 0 else np.zeros(0, U64)
    grams = mix(grams + U64(shingle))
    out = []
    for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(mix((h[a:b] * WORD_FACTORS[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def fingerprints(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, equal for equal sets."""
    one = np.concatenate([[U64(0)], np.cumsum(mix(sets ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
    two = np.concatenate([[U64(0)], np.cumsum(mix(sets + U64(0x14057B7EF767814F)), dtype=U64)])
    return (one[off[1:]] - one[off[:-1]]).view(np.int64), (two[off[1:]] - two[off[:-1]]).view(np.int64)


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS b-bit symbols for each non-empty set (zeros for an empty one)."""
    out = np.zeros((len(off) - 1, SYMBOLS), np.uint16)
    full = off[:-1] < off[1:]
    begins = off[:-1][full]
    if len(begins):
        for k in range(SYMBOLS):
            out[full, k] = mix(np.minimum.reduceat(sets * HASH_FACTORS[k], begins)).astype(np.uint16)
    return out


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets, off = shingle_sets(part.column("text"))
            fp1, fp2 = fingerprints(sets, off)
            sig = signatures(sets, off)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(np.diff(off)),
                    pa.array(fp1),
                    pa.array(fp2),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ],
                ["id", "n", "fp1", "fp2", "sig"],
            )


def _as_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SYMBOLS)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """All index keys of each signature: a chunk without ERRORS of its symbols."""
    keys, wide = [], sig.astype(U64)
    for chunk in range(CHUNKS):
        for kept in combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - ERRORS):
            h = np.full(len(sig), U64((chunk * 64 + sum(1 << k for k in kept)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), U64)
            for k in kept:
                h = mix(h + wide[:, chunk * CHUNK_SYMBOLS + k] + U64(1))
            keys.append((h & ~U64(63)) | U64(len(keys)))  # the low bits name the chunk and what it leaves out
    return np.stack(keys, 1)


def first_slot(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of a signature and others: the first key slot (see chunk_keys) that they share, 64 if none. So a pair is taken in one bucket only."""
    same = (others[:, : CHUNKS * CHUNK_SYMBOLS] == one[: CHUNKS * CHUNK_SYMBOLS]).reshape(-1, CHUNKS, CHUNK_SYMBOLS)
    kept = list(combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - ERRORS))
    shared = np.stack([same[:, :, list(x)].all(2) for x in kept], 2).reshape(len(others), -1)
    return np.where(shared.any(1), shared.argmax(1), 64)


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            keys = chunk_keys(_as_matrix(part.column("sig")))
            rep = np.repeat(part.column("rep").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rep)], ["key", "rep"])


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes allow the similarity and whose signatures agree in enough symbols."""
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        sim = (_as_matrix(batch.column("siga")) == _as_matrix(batch.column("sigb"))).sum(1)
        keep = (sim >= LEAST_AGREE) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb))
        part = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim[keep].astype(np.int32))], ["a", "b", "sim"])


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are linked by their full shingle sets."""
    for batch in batches:
        for part in slices(batch, "texta", 2 << 20):
            sa, oa = shingle_sets(part.column("texta"))
            keep = []
            for k, sub in enumerate(slices(part, "textb", 4 << 20)):
                base = len(keep)
                sb, ob = shingle_sets(sub.column("textb"))
                for i in range(sub.num_rows):
                    x, y = sa[oa[base + i] : oa[base + i + 1]], sb[ob[i] : ob[i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(len(x) + len(y) > 0 and DEN * common >= NUM * (len(x) + len(y) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingle_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of the texts, with the text's id and fingerprint."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets, off = shingle_sets(part.column("text"))
            row = np.repeat(np.arange(part.num_rows), np.diff(off))
            yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), part.column("id").take(pa.array(row)), pa.array(fingerprints(sets, off)[0][row])], ["shingle", "rep", "fp1"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, i, j) of a partition that is sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        edges = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(edges, edges[1:], strict=False):
            now = tuple(cell[:, x].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell, its members that may be linked to a member in another component, one of the two with its partners.

    own is the number of a member's shingles that no other member of such buckets has: two members share at most the lesser of n - own,
    which bounds their similarity from above before signatures are compared.
    """
    for rows in _runs(batches):
        if rows.num_rows < 2:
            continue
        rep, label, n, own, leader = (rows.column(c).to_numpy() for c in ("rep", "label", "n", "own", "leader"))
        part, one, two = (rows.column(c).to_numpy() for c in ("part", "i", "j"))
        slot = int(rows.column("key")[0].as_py()) & 63
        sig = _as_matrix(rows.column("sig").combine_chunks())
        left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
        partners: dict[int, np.ndarray] = {}
        for a in left.tolist():
            if rep[a] == leader[a]:
                continue  # pairs with the smallest member have been verified
            w = right[right > a] if one[0] == two[0] else right
            most = np.minimum(n[w] - own[w], n[a] - own[a])
            w = w[(label[w] != label[a]) & (rep[w] != leader[a]) & (DEN * most >= NUM * (n[w] + n[a] - most))]
            if len(w):
                w = w[(sig[w] == sig[a]).sum(1) >= LEAST_AGREE]
            if len(w):
                w = w[first_slot(sig[a], sig[w]) == slot]
            if len(w):
                partners[a] = w
        if partners:
            use = np.unique(np.concatenate([*partners.values(), np.array(list(partners))]))
            lists = [rep[partners[k]].tobytes() if k in partners else b"" for k in use.tolist()]
            yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(pa.array(use)) for c in ("key", "i", "j", "rep", "label")] + [pa.array(lists, pa.binary())], ["key", "i", "j", "rep", "label", "partners"])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell, confirmed on the whole texts of its members. A pair whose components are tied by then isn't needed."""
    for rows in _runs(batches):
        sets, off = shingle_sets(rows.column("text").combine_chunks())
        rep, label = rows.column("rep").to_pylist(), rows.column("label").to_pylist()
        at: dict[int, list[int]] = {}
        for k, r in enumerate(rep):
            at.setdefault(r, []).append(k)
        tied = {x: x for x in label}

        def root(x: int, tied: dict[int, int] = tied) -> int:
            while tied[x] != x:
                tied[x] = x = tied[tied[x]]
            return x

        links = set()
        for k, mine in enumerate(rows.column("partners").to_pylist()):
            x = sets[off[k] : off[k + 1]]
            for other in np.frombuffer(mine, np.int64).tolist():
                for m in at.get(other, ()):
                    a, b = root(label[k]), root(label[m])
                    y = sets[off[m] : off[m + 1]]
                    if a == b or DEN * min(len(x), len(y)) < NUM * max(len(x), len(y)):
                        continue
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if DEN * common >= NUM * (len(x) + len(y) - common):
                        tied[max(a, b)] = min(a, b)
                        links.add((min(rep[k], other), max(rep[k], other)))
        if links:
            one, two = zip(*sorted(links), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])


def _agree(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of symbols that agree, where it is enough."""
    one = small(reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga")), ROW_BYTES)
    two = small(reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb")), ROW_BYTES)
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "siga", "sigb").mapInArrow(_agreeing, "a bigint, b bigint, sim int")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs that are linked by their whole texts."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("texta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("textb"))
    return materialize(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "texta", "textb").mapInArrow(_confirmed, "a bigint, b bigint"))


def _compose(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels after links between their components; edges (la, lb) name components."""
    higher = connected_components(edges.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    if higher is None:
        return labels
    up = small(higher.select(F.col("node").alias("label"), F.col("label").alias("higher")))
    moved = labels.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
    return materialize(moved.union(higher))  # what higher names has been a root or no node at all


def _crossing(met: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between members of a bucket that are in different components; None if no bucket holds several components."""
    member = met.join(small(labels.withColumnRenamed("node", "rep")), "rep", "left").select("key", "leader", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = member.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low != high and size > 2").select("key", "size")
    member = materialize(member.join(mixed, "key"))
    if not member.take(1):
        return None
    ids = materialize(member.select("rep").distinct())
    shingles = texts.join(small(ids.withColumnRenamed("rep", "id"), 16), "id", "left_semi").mapInArrow(_shingle_rows, "shingle bigint, rep bigint, fp1 bigint")
    lone = shingles.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("rep").alias("rep"), F.min("fp1").alias("fp1")).where("texts = 1")
    own = lone.groupBy("rep", "fp1").agg(F.count("*").alias("own"))
    info = materialize(reps.join(small(ids, 16), "rep", "left_semi").join(own, ["rep", "fp1"], "left").select("rep", "n", F.coalesce("own", F.lit(0)).cast("bigint").alias("own"), "sig"))
    cells = (
        member.withColumn("parts", F.ceil(F.col("size") / CELL).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "leader", "rep", "label", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
        .join(small(info, ROW_BYTES), "rep")
    )
    cell = ["key", "i", "j"]
    maybe = cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_cells, "key bigint, i int, j int, rep bigint, label bigint, partners binary")
    whole = maybe.join(texts.select(F.col("id").alias("rep"), "text"), "rep")
    return materialize(whole.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_verified, "a bigint, b bigint"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest linked id, itself included), kept.

    Null and empty texts, and texts without words, have an empty set, are linked with nothing and are kept. Rows with one id are one
    document, linked if any of its texts is. A null id is linked with nothing, has a null component_id and is kept. Extra
    columns are ignored; an empty table gives no rows. Ids must be integers. Texts are taken whole.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(slim.mapInArrow(_summaries, "id bigint, n bigint, fp1 bigint, fp2 bigint, sig binary"))
    classes = materialize(rows.where("id is not null and n > 0").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    reps = classes.select("rep", "fp1", "n", "sig")
    keys = reps.select("rep", "sig").mapInArrow(_keys, "key bigint, rep bigint")
    shared = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader != last").select("key", "leader")
    met = materialize(keys.join(shared, "key"))
    # whole texts are needed of documents that share a key only
    ids = materialize(met.select(F.col("rep").alias("id")).distinct())
    texts = materialize(slim.where("id is not null").join(small(ids, 16), "id", "left_semi"))
    # 1. members of a bucket against its smallest one; of a document's pairs, the most similar first
    stars = _agree(met.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), reps)
    stars = materialize(stars.withColumn("order", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a"))))
    first = _confirm(stars.where("order = 1"), texts)
    labels = roots(first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
    # 2. the other pairs, where they would tie two components
    second = _confirm(relabel(stars.where("order > 1"), labels), texts)
    labels = _compose(labels, relabel(second, labels))
    # 3. all other pairs of buckets that still hold several components
    crossing = _crossing(met, labels, reps, texts)
    if crossing is not None:
        labels = _compose(labels, relabel(crossing, labels))
    # several texts of one id tie their classes together
    member = rows.where("id is not null and n > 0").join(classes.drop("sig"), ["fp1", "fp2", "n"])
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a != top").select("id", "a")
    if several.take(1):
        labels = _compose(labels, relabel(member.join(several, "id").select("a", F.col("rep").alias("b")).where("a != b"), labels))
    known = classes.join(small(labels.withColumnRenamed("node", "rep")), "rep", "left").select("fp1", "fp2", "n", F.coalesce("label", "rep").alias("label"))
    found = rows.drop("sig").join(known, ["fp1", "fp2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("label")).otherwise(F.col("id")).alias("label"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), F.col("id").eqNullSafe(F.col("label")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document stays (one of each group, that with the smallest id), with their own columns.

    Null and empty texts, and rows without id, are linked with nothing and stay; rows that share an id are one document and stay or go together;
    an empty table gives an empty table.
    """
    kept = near_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")
