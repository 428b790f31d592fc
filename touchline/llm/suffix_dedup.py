"""Removal of repeated passages with suffix arrays.

Every byte that a LENGTH-byte string covers which also starts earlier (smaller id, or same text and earlier start) is removed.

1. Each window of LENGTH bytes has an anchor: the least hash among the GRAM-byte strings in it (the leftmost of equal ones). Equal windows
   have equal anchors at equal places, so windows that share an anchor with no other text need no comparison. Neighbouring windows
   with one anchor make a context: some 40 windows in some 140 bytes. Contexts, as two hashes and a position, are
   dealt by anchor. Of equal contexts of an Arrow batch only the first is; the others are repeats already and are dealt by their own place.
2. In the order of (anchor, context, id, start), all but the first of equal contexts are repeats as a whole. Of an anchor with
   several contexts, the first of each goes to the suffix stage; an anchor with a single context is settled. Contexts of an anchor that a
   sample of texts shows to be very frequent are dealt by (anchor, context): it has several in any case. The sample decides where
   rows go, not what is found.
3. Contexts of such anchors, with their bytes, are dealt by anchor and sorted in blocks by :mod:`suffix_sort`; suffixes whose adjacent
   common prefix reaches LENGTH are equal windows, of which all but the first are repeats. An anchor with more than HOT contexts is split into its single windows instead, which are grouped by their
   bytes' hashes with map-side minima: no task holds such an anchor.
4. Repeated ranges meet their text by id; what remains of it is hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small
from .suffix_sort import common_prefix, eight_bytes, suffix_array
from .textkit import U64, Hasher, mix, slices, text_bytes

LENGTH, GRAM = 100, 32
#: Contexts of an anchor beyond which it is split into windows, and bytes of contexts that are sorted together.
HOT, BLOCK = 20_000, 2 << 20
#: One text in SAMPLE tells which anchors are very frequent; each has a SHARE-th of the sampled contexts or more, so there are at most SHARE.
SAMPLE, SHARE = 64, 4096
#: Bits of a position in the packed value whose minimum is the anchor.
PLACE_BITS = 28


def contexts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last window start (from the row's begin), anchor hash and context hash of every context."""
    span = LENGTH - GRAM + 1
    n = len(buf) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(U64), none.astype(U64)
    if len(buf) >= 1 << PLACE_BITS:
        raise ValueError("a text of 256 MB or more")
    hasher = Hasher(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = hasher(at, at + GRAM)
    low = (gram & ~U64((1 << PLACE_BITS) - 1)) | at.astype(U64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    place = (low & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    size = np.diff(off)
    valid = np.maximum(size - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(size)), valid)
    start = np.arange(len(row)) - np.repeat(np.cumsum(valid) - valid, valid) + off[row]
    anchor = place[start]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(row) else none
    last = np.append(first[1:], len(row)) - 1 if len(row) else none
    a, b = start[first], start[last]
    # where in the context the anchor stands is part of what makes contexts equal
    return row[first], a - off[row[first]], b - off[row[first]], gram[anchor[first]], mix(hasher(a, b + LENGTH) + (anchor[first] - a).astype(U64))


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each text; of equal ones in a batch, the later ones are given as repeats at once (first is false)."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            buf, off = text_bytes(part.column("text"))
            row, a, b, anchor, ctx = contexts(buf, off)
            ids = part.column("id").to_numpy()[row]
            order = np.lexsort((a, ids, ctx, anchor))
            same, twin = np.zeros(len(order), bool), np.zeros(len(order), bool)
            if len(order):
                k, p = order[1:], order[:-1]
                same[k] = (anchor[k] == anchor[p]) & (ctx[k] == ctx[p])
                twin[k] = same[k] & (ids[k] == ids[p]) & (a[k] == a[p])  # the same place, from a repeated row
            order = order[~twin[order]]
            packed = (a << 16) | (b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[order].view(np.int64)), pa.array(ctx[order].view(np.int64)), pa.array(ids[order]), pa.array(packed[order]), pa.array(~same[order])], ["anchor", "ctx", "id", "at", "lead"]
            )


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, ctx, id, at): repeats of a context (kind 0), and first contexts of anchors that have several (kind 1,
    numbered; kind 2 where the anchor is known to be frequent, so that other tasks have contexts of it too).

    Constant state: the last row, and the first row of the anchor as long as it has one context.
    """
    last_anchor = last_ctx = last_id = last_at = None
    held: tuple | None = None
    rank = 0
    for batch in batches:
        later = batch.filter(pc.invert(batch.column("lead")))
        if later.num_rows:
            zero = pa.array(np.zeros(later.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([later.column("anchor"), later.column("id"), later.column("at"), zero, zero], ["anchor", "id", "at", "rank", "kind"])
        batch = batch.filter(batch.column("lead"))
        n = batch.num_rows
        if not n:
            continue
        anchor, ctx, ids, at = (batch.column(c).to_numpy() for c in ("anchor", "ctx", "id", "at"))
        frequent = batch.column("frequent").to_numpy(zero_copy_only=False)
        new_anchor, new_ctx, twin = np.ones(n, bool), np.ones(n, bool), np.zeros(n, bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_ctx[1:] = new_anchor[1:] | (ctx[1:] != ctx[:-1])
        twin[1:] = ~new_ctx[1:] & (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])  # the same place, from a repeated row
        if last_anchor is not None:
            new_anchor[0] = anchor[0] != last_anchor
            new_ctx[0] = new_anchor[0] or ctx[0] != last_ctx
            twin[0] = not new_ctx[0] and ids[0] == last_id and at[0] == last_at
        leads = np.flatnonzero(new_ctx)
        repeat = ~new_ctx & ~twin
        out_rank = np.zeros(n, np.int64)
        starts_anchor = new_anchor[leads]
        position = np.arange(len(leads))
        begin = np.maximum.accumulate(np.where(starts_anchor, position, -1)) if len(leads) else position
        out_rank[leads] = np.where(begin >= 0, position - begin, position + rank + 1 if last_anchor is not None else position)
        sizes_more = np.zeros(len(leads), bool)  # whether the anchor of a lead has another lead in this batch
        if len(leads):
            group = np.cumsum(starts_anchor)
            sizes_more = np.bincount(group)[group] > 1
        multi = np.zeros(n, bool)
        multi[leads] = (sizes_more | (out_rank[leads] > 0)) & ~frequent[leads]
        known = np.zeros(n, bool)
        known[leads] = frequent[leads]
        if held is not None:
            if len(leads) and not starts_anchor[0]:  # the anchor before goes on with a second context
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], ["anchor", "id", "at", "rank", "kind"])
                held = None
            elif len(leads):
                held = None
        # the last anchor of the batch may get its second context later
        if len(leads) and out_rank[leads[-1]] == 0 and not frequent[leads[-1]]:
            k = leads[-1]
            held = (int(anchor[k]), int(ids[k]), int(at[k]), 0, 1)
        if len(leads):
            rank = int(out_rank[leads[-1]])
        for flag, kind in ((repeat, 0), (multi, 1), (known, 2)):
            own = np.flatnonzero(flag)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(ids[own]), pa.array(at[own]), pa.array(out_rank[own]), pa.array(np.full(len(own), kind))], ["anchor", "id", "at", "rank", "kind"])
        last_anchor, last_ctx, last_id, last_at = anchor[-1], ctx[-1], ids[-1], at[-1]


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts, from rows with a text and its context list."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [x.encode() for x in part.column("text").to_pylist()]
            size = np.diff(part.column("places").offsets.to_numpy())
            flat = part.column("places").flatten()
            anchor, at = flat.field("anchor").to_numpy(), flat.field("at").to_numpy()
            owner = np.repeat(np.arange(part.num_rows), size)
            a, b = at >> 16, (at >> 16) + (at & 0xFFFF) + LENGTH
            data = [texts[k][x:y] for k, x, y in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True)]
            whole = pa.array([len(d) == y - x for d, x, y in zip(data, a.tolist(), b.tolist(), strict=True)], pa.bool_())  # not so where rows share an id
            out = pa.RecordBatch.from_arrays([pa.array(anchor), part.column("id").take(pa.array(owner)), pa.array(a), pa.array(data, pa.binary())], ["anchor", "id", "start", "data"])
            yield out.filter(whole)


def repeated_windows(pieces: list[bytes], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each window of the pieces (in order, len - LENGTH + 1 of each) is equal to one that starts earlier."""
    size = np.array([len(x) for x in pieces])
    data = np.concatenate([np.frombuffer(b"".join(pieces), np.uint8), np.zeros(2 * LENGTH + 16, np.uint8)])
    begin = np.concatenate([[0], np.cumsum(size)])
    windows = size - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    number = np.full(len(data), -1, np.int64)
    number[begin[owner] + within] = np.arange(len(owner))
    sa = suffix_array(data, LENGTH)
    sa = sa[number[sa] >= 0]
    words = eight_bytes(data)
    same = np.concatenate([[False], common_prefix(words, sa[1:], sa[:-1], LENGTH) >= LENGTH])
    group = np.cumsum(~same) - 1
    win = number[sa]
    order = np.lexsort((starts[owner[win]] + within[win], ids[owner[win]], group))
    win, group = win[order], group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    lead = win[np.maximum.accumulate(np.where(first, np.arange(len(win)), 0))]
    place = starts[owner] + within
    out = np.zeros(len(owner), bool)
    out[win] = (ids[owner[win]] != ids[owner[lead]]) | (place[win] != place[lead])
    return out


def _spans_of(repeated: np.ndarray, size: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Runs of repeated windows as (id, a, b) ranges of bytes."""
    windows = size - LENGTH + 1
    owner = np.repeat(np.arange(len(size)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = np.flatnonzero(repeated)
    fresh = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]) if len(hit) else np.zeros(0, bool)
    first, last = hit[fresh], hit[np.append(np.flatnonzero(fresh)[1:], len(hit)) - 1] if len(hit) else hit
    return pa.RecordBatch.from_arrays([pa.array(ids[owner[first]]), pa.array(starts[owner[first]] + within[first]), pa.array(starts[owner[last]] + within[last] + LENGTH)], ["id", "a", "b"])


def _sorted_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by anchor: repeated ranges, in blocks of whole anchors."""
    held: list[pa.RecordBatch] = []
    size = 0

    def run() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        pieces, ids, starts = t.column("data").to_pylist(), t.column("id").to_numpy(), t.column("start").to_numpy()
        return _spans_of(repeated_windows(pieces, ids, starts), np.array([len(x) for x in pieces]), ids, starts)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        lengths = np.cumsum(np.diff(np.frombuffer(batch.column("data").buffers()[1], np.int32)[batch.column("data").offset : batch.column("data").offset + batch.num_rows + 1]))
        edges = np.flatnonzero(np.concatenate([[last is not None and anchor[0] != last], anchor[1:] != anchor[:-1]]))
        begin, done = 0, 0
        for e in edges.tolist():
            so_far = int(lengths[e - 1]) if e else 0
            if size + so_far - done >= BLOCK:
                held.append(batch.slice(begin, e - begin))
                yield run()
                held, size, begin, done = [], 0, e, so_far
        held.append(batch.slice(begin))
        size += int(lengths[-1]) - done
        last = anchor[-1]
    if held:
        yield run()


def _single_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of contexts as two hashes and its place."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            pieces = part.column("data").to_pylist()
            size = np.array([len(x) for x in pieces])
            buf = np.frombuffer(b"".join(pieces), np.uint8)
            windows = size - LENGTH + 1
            owner = np.repeat(np.arange(len(size)), windows)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = np.repeat(np.cumsum(size) - size, windows) + within
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(Hasher(buf)(at, at + LENGTH).view(np.int64)),
                    pa.array(Hasher(buf ^ np.uint8(0xA5))(at, at + LENGTH).view(np.int64)),
                    pa.array(part.column("id").to_numpy()[owner]),
                    pa.array(part.column("start").to_numpy()[owner] + within),
                ],
                ["h1", "h2", "id", "start"],
            )


def _remaining(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            buf, off = text_bytes(part.column("text"))
            gone = np.zeros(len(buf) + 1, np.int32)
            spans = part.column("spans")
            size = np.diff(spans.offsets.to_numpy())
            size = np.where(spans.is_valid().to_numpy(zero_copy_only=False), size, 0)
            if size.sum():
                flat = spans.flatten()
                row = np.repeat(np.arange(part.num_rows), size)
                n = np.diff(off)[row]
                a, b = np.minimum(flat.field("a").to_numpy(), n) + off[row], np.minimum(flat.field("b").to_numpy(), n) + off[row]
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
            gone = np.cumsum(gone[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            begins = off[:-1][off[:-1] < off[1:]]
            first[begins] = gone[begins]
            removed, runs = np.concatenate([[0], np.cumsum(gone)])[off], np.concatenate([[0], np.cumsum(first)])[off]
            kept, bounds = buf[~gone].tobytes(), (off - removed).tolist()
            digest = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(off)), pa.array(np.diff(removed)), pa.array(np.diff(runs)), pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


OCCURRENCE = "anchor bigint, ctx bigint, id bigint, at bigint, lead boolean"


def frequent_anchors(slim: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> list[int]:
    """At most SHARE anchors that have hot contexts or more, and a SHARE-th of all, as far as one text in sample shows."""
    some = slim.where(F.pmod(F.xxhash64("id", F.lit("frequent")), F.lit(sample)) == 0).mapInArrow(_occurrences, OCCURRENCE)
    sizes = materialize(some.where("lead").select("anchor", "ctx").distinct().groupBy("anchor").count().where("count > 1"))
    total = sizes.agg(F.sum("count")).first()[0] or 0
    return [r[0] for r in sizes.where(F.col("count") >= max(2, hot / sample, total / SHARE)).select("anchor").collect()]


def repeated_spans(slim: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(id, a, b) ranges of repeated bytes of a table (id, text), overlapping or not; ids are not null."""
    slim = slim.where("id is not null")
    found = slim.mapInArrow(_occurrences, OCCURRENCE).withColumn("frequent", F.col("anchor").isin(frequent_anchors(slim, hot, sample)))
    schema = "anchor bigint, id bigint, at bigint, rank bigint, kind bigint"
    place = F.when(~F.col("lead"), F.xxhash64("id", "at")).when(F.col("frequent"), F.xxhash64("anchor", "ctx")).otherwise(F.col("anchor"))
    settled = materialize(found.repartition(place).sortWithinPartitions("anchor", "ctx", "id", "at").mapInArrow(_settle, schema))
    start, width = F.shiftright("at", 16), F.col("at").bitwiseAND(0xFFFF)
    whole = settled.where("kind = 0").select("id", start.alias("a"), (start + width + LENGTH).alias("b"))
    several = settled.where("kind > 0")
    hottest = several.groupBy("anchor").agg(F.max("rank").alias("top"), F.max("kind").alias("kind")).where((F.col("top") >= hot) | (F.col("kind") == 2)).select("anchor")
    hottest = small(materialize(hottest), 8)
    places = several.groupBy("id").agg(F.collect_list(F.struct("anchor", "at")).alias("places"))
    cut = materialize(slim.join(places, "id").select("id", "text", "places").mapInArrow(_cut, "anchor bigint, id bigint, start bigint, data binary"))
    some_hot = bool(hottest.take(1))
    normal = cut.join(hottest, "anchor", "left_anti") if some_hot else cut
    spans = normal.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_blocks, "id bigint, a bigint, b bigint")
    if some_hot:
        single = cut.join(hottest, "anchor", "left_semi").mapInArrow(_single_windows, "h1 bigint, h2 bigint, id bigint, start bigint")
        least = single.groupBy("h1", "h2").agg(F.min(F.struct("id", "start")).alias("least"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "least")
        later = single.join(least, ["h1", "h2"]).where(F.struct("id", "start") > F.col("least"))
        spans = spans.union(later.select("id", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")))
    return whole.union(spans)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes (null: empty), taken whole; matches never cross texts. Repeated rows with one id and text are one text. Rows that share an id with
    different texts share their repeated ranges. A row without id is left whole and makes no other text a repeat. Extra
    columns are ignored; an empty table gives no rows. Ids must be integers.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(slim, hot, sample).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    out = slim.join(spans, "id", "left").mapInArrow(_remaining, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
