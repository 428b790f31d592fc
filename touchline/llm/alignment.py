"""Cross-tokenizer alignment: two tokenizers' tokens of the same bytes, their minimal common groups and corpus counts of linked ids.

A text is cut into stretches before blanks that follow a solid character. No token of either vocabulary crosses such a cut,
so a stretch is encoded alike wherever it stands, and each distinct stretch of a batch is encoded and aligned once. Tokens
whose bytes overlap are linked; union-find over this bipartite graph gives its components, which are exactly the minimal
groups of tokens between offsets where both vocabularies end one. Members of the components expand to links, and pairs of
ids are counted by document over the whole corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textkit import slices, text_bytes

TOKENIZERS = "/opt/tokenizers"
MODEL_A, MODEL_B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Bytes of text aligned at once; distinct stretches joined to a string for encoding.
UNIT_BYTES, JOINED = 4 << 20, 256
#: Pairs counted that are broadcast at most; beyond, only those that make up more than one in so many links are.
MOST_PAIRS, HOT_SHARE = 1 << 20, 1000
#: Last letters' first bytes with which white space beyond ASCII may be written in UTF-8.
BLANK_LEADS = (0xC2, 0xE1, 0xE2, 0xE3, 0xEF)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """The bytes of each id, for gathering."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(size.sum()))]


class Vocabularies:
    """Both tokenizers, opened once in each Python process; the files are the bound of what is held."""

    def __init__(self, model_a: str, model_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(model_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_b)
        with open(model_a, encoding="utf-8") as f:
            known = json.load(f)["model"]["vocab"]
        letters, tokens = byte_letters(), [b""] * self.a.get_vocab_size()
        for token, i in known.items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.table_a = Table(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.table_b = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.blank = self.b.piece_to_id("▁")

    def encode_a(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)]

    def encode_b(self, stretches: list[str]) -> list[list[int]]:
        """The model adds the first blank itself."""
        return [x or [self.blank] for x in self.b.encode([s[1:] for s in stretches], num_threads=1)]


_opened: dict[tuple[str, str], Vocabularies] = {}


def opened(model_a: str, model_b: str) -> Vocabularies:
    if (model_a, model_b) not in _opened:
        _opened[model_a, model_b] = Vocabularies(model_a, model_b)
    return _opened[model_a, model_b]


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the stretches: of the rows, and blanks after a character that surely is no white space."""
    if not len(buf):
        return offsets[:-1]
    before = np.concatenate([np.zeros(4, np.uint8), buf])
    at = np.flatnonzero(buf == 0x20)
    last, two, three, four = (before[at + 4 - k] for k in (1, 2, 3, 4))
    lead = np.where(two >= 0xC0, two, np.where(three >= 0xC0, three, four))
    solid = np.where(last < 0x80, (last > 0x20) & (last < 0x7F), ~np.isin(lead, BLANK_LEADS))
    return _merged(offsets[:-1], at[solid])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct values of two ascending arrays."""
    both = np.sort(np.concatenate([a, b]), kind="stable")  # two runs: merged
    return both[np.diff(both, prepend=-1) > 0]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.array(ids, pa.list_(pa.int32()))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())


def encoded(encode, stretches: pa.Array, joins: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all stretches in order and the number of ids of each. Those in joins are encoded in one string with others and told apart by
    their bytes; where a token doesn't end with its stretch, each is encoded alone."""
    sub = stretches.take(pa.array(joins))
    buf, off = text_bytes(sub)
    data, ends = buf.tobytes(), off[np.append(np.arange(0, len(joins), JOINED), len(joins))].tolist()
    flat, _ = _flat(encode([data[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]))
    upto, last = np.searchsorted(np.cumsum(table.size[flat]), off[1:], "right"), np.append(0, np.cumsum(table.size[flat]))
    if not np.array_equal(last[upto], off[1:]):
        return _flat(encode(stretches.to_pylist()))
    counts = np.zeros(len(stretches), np.int64)
    counts[joins] = np.diff(upto, prepend=0)
    alone = np.ones(len(stretches), bool)
    alone[joins] = False
    alone = np.flatnonzero(alone)
    more, counts[alone] = _flat(encode(stretches.take(pa.array(alone)).to_pylist()))
    owner = np.concatenate([np.repeat(joins, counts[joins]), np.repeat(alone, counts[alone])])
    return np.concatenate([flat, more])[np.argsort(owner, kind="stable")], counts


def _same_bytes(ids: np.ndarray, counts: np.ndarray, table: Table, buf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of a stretch's ids, joined, are its bytes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    good = np.bincount(owner, weights=table.size[ids], minlength=len(counts)).astype(np.int64) == size
    keep = good[owner]
    own = np.repeat(good, size)
    differ = table.bytes_of(ids[keep]) != buf[own]
    bad = np.repeat(np.arange(len(counts)), size)[own][differ]
    good[bad] = False
    return good


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over edges: the smallest node that each node is connected with. Roots are hooked to smaller ones, then paths halved."""
    parent = np.arange(n)
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


class Aligned:
    """Distinct stretches with their tokens, groups and links."""

    def __init__(self, stretches: pa.Array, vocab: Vocabularies):
        buf, off = text_bytes(stretches)
        size = np.diff(off)
        k, last = len(stretches), buf[off[1:] - 1]
        joins = np.flatnonzero((last > 0x20) & (last < 0x7F))  # one after the other these are cut as alone
        self.a, self.n_a = encoded(vocab.encode_a, stretches, joins, vocab.table_a)
        self.b, self.n_b = encoded(vocab.encode_b, stretches, joins, vocab.table_b)
        self.good = _same_bytes(self.a, self.n_a, vocab.table_a, buf, size) & _same_bytes(self.b, self.n_b, vocab.table_b, buf, size)
        if not self.good.all():  # tokens of other bytes are left out: texts that hold such a stretch have none
            self.a, self.b = self.a[np.repeat(self.good, self.n_a)], self.b[np.repeat(self.good, self.n_b)]
            self.n_a, self.n_b = self.n_a * self.good, self.n_b * self.good
        ends_a, ends_b = np.cumsum(vocab.table_a.size[self.a]), np.cumsum(vocab.table_b.size[self.b])
        ends = _merged(ends_a, ends_b)  # up to each, one token of either vocabulary runs: an overlap
        link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        root = components(len(self.a) + len(self.b), link_a, len(self.a) + link_b)
        in_a, in_b = root[: len(self.a)], root[len(self.a) :]  # a group's first token of A is its root: roots rise along the bytes
        new_a, new_b = np.diff(in_a, prepend=-1) > 0, np.diff(in_b, prepend=-1) > 0
        of_a = np.repeat(np.arange(k), self.n_a)
        self.links = np.bincount(of_a[link_a], minlength=k)
        self.pairs = self.a[link_a] << 32 | self.b[link_b]  # in order of the stretches
        self.groups = np.bincount(of_a[new_a], minlength=k)
        text = lambda ids, new: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(ids)), pa.int32()), pa.array(ids).cast(pa.string())), ",")
        of_groups = pc.binary_join_element_wise(text(self.a, new_a), text(self.b, new_b), "|")
        self.text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.groups)), pa.int32()), of_groups), ";").cast(pa.large_string())


def _spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _align(model_a: str, model_b: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = opened(model_a, model_b)
        for batch in batches:
            for part in slices(batch, "text", UNIT_BYTES):
                column = part.column("text")
                empty = pc.fill_null(pc.equal(pc.binary_length(column), 0), True)
                column = pc.if_else(empty, "", pc.binary_join_element_wise("", pc.fill_null(column, ""), " "))
                buf, off = text_bytes(column)
                first = cuts(buf, off)
                first = first[first < len(buf)]
                whole = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(buf)).astype(np.int32)), pa.py_buffer(buf.tobytes()))
                coded = whole.dictionary_encode()
                kinds, which = Aligned(coded.dictionary, vocab), coded.indices.to_numpy()
                row = np.searchsorted(off, first, "right") - 1
                good = np.ones(part.num_rows, bool)
                good[row[~kinds.good[which]]] = False
                which, row = which[good[row]], row[good[row]]
                total = lambda per: pa.array(np.bincount(row, weights=per[which], minlength=part.num_rows).astype(np.int64))  # noqa: E731, B023
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))), kinds.text.take(pa.array(which))), pa.scalar(";", pa.large_string()))
                ends, data = np.frombuffer(joined.buffers()[1], np.int64)[: part.num_rows + 1].tolist(), memoryview(joined.buffers()[2] or b"")
                hashes = ["" if a == b else hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                at = _spread((np.cumsum(kinds.links) - kinds.links)[which], kinds.links[which])
                ids, number = np.unique(kinds.pairs, return_inverse=True)
                own, often = np.unique(np.repeat(row, kinds.links[which]) * max(1, len(ids)) + number[at], return_counts=True)
                upto = pa.array(np.searchsorted(own, np.arange(part.num_rows + 1) * max(1, len(ids))), pa.int32())
                linked = ids[own % max(1, len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), total(kinds.n_a), total(kinds.n_b), total(kinds.groups), total(kinds.links), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(upto, pa.array(linked)), pa.ListArray.from_arrays(upto, pa.array(often, pa.int32()))],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often"],
                )

    return run


def aligned(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a << 32 | b, distinct), often (links of each pair): a narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_align(model_a, model_b), f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, often array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of its first id has more): counted before the shuffle."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = materialize(counts)
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(
    docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS, hot_share: int = HOT_SHARE
) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text is encoded with one blank before it. Texts that are null or empty, or whose tokens' bytes of either vocabulary differ from
    blank and text (a literal U+2581, say), have no tokens: zeros and an empty groups_sha256. Whole texts of any length; a stretch
    without blanks is one unit however long. Ids may be null or repeated (each row counts as a document); extra columns are ignored;
    an empty table gives no rows. n_best: links whose pair is the most frequent of its first id, ties included; count_sum: documents
    that hold the pair, summed over links.

    Pairs' counts are looked up by a broadcast where up to most_pairs are counted, else by a join on the pair, with the pairs that
    make up more than one in hot_share links (fewer than hot_share of them) broadcast. Both give the same rows.
    """
    rows = materialize(aligned(docs, model_a, model_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(pair_counts(rows))
    plain = ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "often")).alias("x")).select("row", "x.pairs", "x.often").withColumnRenamed("pairs", "pair")
    if counts.count() <= most_pairs:
        joined = links.join(F.broadcast(counts), "pair")
    else:
        limit = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // hot_share)
        hot, rest = counts.where(F.col("n") > limit), counts.where(F.col("n") <= limit)
        joined = links.join(F.broadcast(hot), "pair").unionByName(links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rest, "pair"))
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum"))
    return rows.select("row", *plain).join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("bigint")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("bigint")).alias("count_sum"), "groups_sha256"
    )
