"""A stored inverted index: stems of the words of each document with their places, in buckets of a stem's first letters.

Two tables lie under one path: ``postings`` by bucket, in packs (all postings that some documents have in a bucket are one row),
and ``docs`` (doc, batch, deleted, at). Each change appends a batch; a document's newest batch holds, and rows of docs are written
last, so what a lost job left behind is never read. A prefix of PREFIX letters or more lies in one bucket, as do all terms
that it can meet: a search reads the buckets of its terms and no others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import plain_letters, tokens
from ..sources.store import written

BUCKETS, PREFIX, DEPTH = 64, 3, 50
#: Documents and queries of a block of a search, and postings that are matched at once.
DOCS, QUERIES, POSTINGS = 4096, 8192, 1 << 17
#: A pack: its terms, its documents (doc is the first one) and their hashes; of each posting, as bytes, the numbers of its term and document, how many places it has, and these.
PACK = "bucket int, batch int, doc bigint, terms array<string>, docs array<bigint>, hashes array<bigint>, term_no binary, doc_no binary, n binary, places binary"
#: English words that aren't indexed.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Endings of words of four letters or more, replaced one after the other: pattern, what stays.
ENDINGS = (("sses$", "ss"), ("ies$", "i"), ("([^s])s$", r"\1"), ("^(.*[aeiouy].*)(ing|ed)$", r"\1"), ("([^aeiou])y$", r"\1i"))


def stem(word: Column) -> Column:
    out = word
    for pattern, stays in ENDINGS:
        out = F.regexp_replace(out, pattern, stays.replace("\\", "$"))
    return F.when((F.length(word) > 3) & word.rlike("(s|y|ing|ed)$"), out).otherwise(word)


def stems(text: Column) -> Column:
    """Stems in order, without stop words; each element holds its place among all words."""
    words = F.transform(tokens(text), lambda w, at: F.struct(w.alias("word"), at.alias("at")))
    return F.transform(F.filter(words, lambda x: ~x["word"].isin(*STOP_WORDS)), lambda x: F.struct(stem(x["word"]).alias("term"), x["at"].alias("at")))


def bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(F.left(term, F.lit(PREFIX))) % buckets).cast("int")


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def _docs(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "docs", "doc bigint, batch int, deleted boolean, at timestamp_ntz")


def live(spark: SparkSession, path: str) -> DataFrame:
    """doc, batch, at of the documents that are in the index now."""
    newest = _docs(spark, path).groupBy("doc").agg(F.max_by(F.struct("batch", "deleted", "at"), "batch").alias("r"))
    return newest.select("doc", "r.*").where("not deleted").drop("deleted")


def _stem_words(words: list[str]) -> list[str | None]:
    """The same stems of distinct words, without Spark; None for stop words and for what is no word."""
    out = []
    for w in words:
        if len(w) > 3 and w.endswith(("s", "y", "ing", "ed")):
            stemmed = w
            for pattern, stays in _ENDINGS:
                stemmed = pattern.sub(stays, stemmed)
        else:
            stemmed = w
        out.append(None if not w or w in _STOP else stemmed)
    return out


_STOP = frozenset(STOP_WORDS)
_ENDINGS = [(re.compile(pattern), stays) for pattern, stays in ENDINGS]


def _lists(values: pa.Array | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _pack(bucket: int, batch: int, terms: pa.Array, docs: np.ndarray, hashes: np.ndarray, *numbers: np.ndarray) -> pa.RecordBatch:
    """A pack of postings: numbers of terms and of documents, of places, and the places. Terms and documents that no posting has are left out."""
    raw = []
    for held, own in zip(((terms,), (docs, hashes)), numbers[:2], strict=True):
        used, place = np.unique(own, return_inverse=True)
        raw.append(place)
        if held[0] is terms:
            terms = terms.take(pa.array(used))
        else:
            docs, hashes = docs[used], hashes[used]
    raw = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (*raw, *numbers[2:])]
    names = [x.split()[0] for x in PACK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([batch], pa.int32()), pa.array(docs[:1]), _lists(terms), _lists(docs), _lists(hashes), *raw], names)


def _packs(buckets: int, batch: int):
    """Packs from (doc, hash, text): each distinct word of a few texts is stemmed once, and a document's places are together already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(start, 512) for whole in batches for start in range(0, whole.num_rows, 512)):
            found = pc.split_pattern_regex(part.column("text").cast(pa.large_string()), "[^a-z0-9]+")
            row = pc.list_parent_indices(found).to_numpy()
            coded = found.flatten().dictionary_encode()
            words, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            real = np.array([w != "" for w in words], bool)[word]
            row, word = row[real], word[real]
            at = np.arange(len(row)) - np.searchsorted(row, row)
            names = _stem_words(words)
            terms = list(dict.fromkeys(x for x in names if x is not None))
            own = {x: zlib.crc32(x.encode()) % buckets for x in {x[:PREFIX] for x in terms}}
            own = np.array([own[x[:PREFIX]] for x in terms], np.int64)
            number = {x: k for k, x in enumerate(terms)} | {None: -1}
            code = np.array([number[x] for x in names], np.int64)[word]
            row, at, code = row[code >= 0], at[code >= 0], code[code >= 0]
            if not len(row):
                continue
            key = row * len(terms) + code
            order = np.lexsort((key, own[code]))  # stable: the places of a posting stay in order
            key, at, code, row = key[order], at[order], code[order], row[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            n, code, row = np.diff(np.append(first, len(key))), code[first], row[first]
            terms, docs, hashes = pa.array(terms, pa.string()), part.column("doc").to_numpy(), part.column("hash").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(own[code], append=-1)) + 1, 0)
            for start, end in zip([0, *ends[:-2]], ends[:-1], strict=True):
                stop = first[end] if end < len(first) else len(at)
                yield _pack(own[code[start]], batch, terms, docs, hashes, code[start:end], row[start:end], n[start:end], at[first[start] : stop])

    return run


def _repacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs from rows (bucket, batch, term, doc, hash, places)."""
    for rows in batches:
        table = pa.Table.from_batches([rows])
        for one in table.group_by(["bucket", "batch"]).aggregate([]).to_pylist():
            part = table.filter((pc.field("bucket") == one["bucket"]) & (pc.field("batch") == one["batch"])).combine_chunks().to_batches()[0]
            term, places = part.column("term").dictionary_encode(), part.column("places")
            docs, row = np.unique(part.column("doc").to_numpy(), return_inverse=True)
            hashes = np.empty(len(docs), np.int64)
            hashes[row] = part.column("hash").to_numpy()
            yield _pack(one["bucket"], one["batch"], term.dictionary, docs, hashes, term.indices.to_numpy(), row, pc.list_value_length(places).to_numpy(), places.flatten().to_numpy())


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for packs in _of_one_bucket(batches):
        term = pc.dictionary_encode(pa.concat_arrays([x.column("terms").flatten().take(pa.array(_numbers(x, "term_no", np.int32))) for x in packs]))
        number, n = term.indices.to_numpy(), np.concatenate([_numbers(x, "n", np.int32) for x in packs])
        counts = np.bincount(number), np.bincount(number, weights=n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([term.dictionary, *(pa.array(x) for x in counts)], ["term", "n_docs", "n_places"])


def term_counts(spark: SparkSession, path: str) -> DataFrame:
    """term, n_docs, n_places over all that is stored; compact() first where documents were replaced or have left."""
    packs = _table(spark, path, "postings", PACK).select("bucket", "terms", "term_no", "n")
    return packs.mapInArrow(_counts, "term string, n_docs bigint, n_places bigint").groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_places").alias("n_places"))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, batch, term, doc, places) of packs."""
    for pack in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
        term, doc, n, places = (_numbers(pack, c, np.int32) for c in ("term_no", "doc_no", "n", "places"))
        same = [pa.array(np.full(len(n), pack.column(c)[0].as_py(), np.int32)) for c in ("bucket", "batch")]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(places))
        yield pa.RecordBatch.from_arrays([*same, pack.column("terms").flatten().take(pa.array(term)), pack.column("docs").flatten().take(pa.array(doc)), lists], ["bucket", "batch", "term", "doc", "places"])


def _store(packs: DataFrame, path: str) -> None:
    """Packs enter the index; a bucket is dealt to tasks by documents, so that none holds a frequent term alone."""
    packs.repartition("bucket", F.pmod(F.element_at("hashes", 1), F.lit(8))).write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def add(docs: DataFrame, path: str, id_col: str, text_col: str, at_col: str | None = None, buckets: int = BUCKETS, times: DataFrame | None = None) -> int:
    """A batch of documents enters the index, or replaces those with the same id; gives the batch's number.

    Rows with a null id are left out; of rows that share an id, one is taken (the newest, then the greatest text). A null text has no terms.
    times: (doc, at), where the times stand in a table of their own; they never meet the texts then. Texts are shuffled only where ids repeat.
    """
    spark = docs.sparkSession
    number = (_docs(spark, path).agg(F.max("batch")).first()[0] or 0) + 1
    at = F.col(at_col).cast("timestamp_ntz") if at_col else F.lit(None).cast("timestamp_ntz")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"), at.alias("at")).where("doc is not null")
    again = written(slim.groupBy("doc").count().where("count > 1").select("doc"))
    if not again.isEmpty():
        both = slim.join(again, "doc", "left_semi").groupBy("doc").agg(F.max(F.struct("at", "text")).alias("r")).select("doc", "r.text", "r.at")
        slim = slim.join(again, "doc", "left_anti").unionByName(both)
    plain = slim.select("doc", F.xxhash64("doc").alias("hash"), F.coalesce(plain_letters(F.col("text")), F.lit("")).alias("text"))
    _store(plain.mapInArrow(_packs(buckets, number), PACK), path)
    own = slim.select("doc", "at") if times is None else slim.select("doc").join(times.select("doc", F.col("at").cast("timestamp_ntz").alias("at")).groupBy("doc").agg(F.max("at").alias("at")), "doc", "left")
    own.select("doc", F.lit(number).alias("batch"), F.lit(False).alias("deleted"), "at").write.mode("append").parquet(f"{path}/docs")
    return number


def remove(ids: DataFrame, path: str, id_col: str) -> int:
    """Documents leave the index; their postings stay unread until the index is compacted."""
    spark = ids.sparkSession
    number = (_docs(spark, path).agg(F.max("batch")).first()[0] or 0) + 1
    gone = ids.select(F.col(id_col).cast("bigint").alias("doc")).distinct()
    gone.select("doc", F.lit(number).alias("batch"), F.lit(True).alias("deleted"), F.lit(None).cast("timestamp_ntz").alias("at")).write.mode("append").parquet(f"{path}/docs")
    return number


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The index without replaced and deleted documents, at another path."""
    now = live(spark, path)
    packs = _table(spark, path, "postings", PACK).select(*(x.split()[0] for x in PACK.split(", ")))
    rows = packs.mapInArrow(_rows, "bucket int, batch int, term string, doc bigint, places array<int>").join(now.select("doc", "batch"), ["doc", "batch"], "left_semi")
    dealt = rows.repartition("bucket", F.pmod("doc", F.lit(8))).sortWithinPartitions("bucket")
    _store(dealt.select("bucket", "batch", "term", "doc", F.xxhash64("doc").alias("hash"), "places").mapInArrow(_repacked, PACK), to)
    now.select("doc", "batch", F.lit(False).alias("deleted"), "at").write.parquet(f"{to}/docs")


def wanted(queries: DataFrame, q_col: str, text_col: str) -> DataFrame:
    """(q, want): the distinct stems of each query; a query of stop words alone has none."""
    return queries.select(F.col(q_col).alias("q"), F.explode(F.array_distinct(F.transform(stems(F.col(text_col)), lambda x: x["term"]))).alias("want"))


def _meetings(terms: pa.Array, wants: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each term with the number of each want that it meets, in the terms' order."""
    sizes = pc.binary_length(wants).to_numpy()
    term, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        heads = pc.utf8_slice_codeunits(terms, 0, size) if size >= PREFIX else terms
        at = pc.fill_null(pc.index_in(heads, value_set=wants.take(pa.array(own))), -1).to_numpy()
        term.append(np.flatnonzero(at >= 0))
        met.append(own[at[at >= 0]])
    term, met = np.concatenate(term), np.concatenate(met)
    order = np.argsort(term, kind="stable")
    return term[order], met[order]


def _numbers(row: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row.column(name)[0].as_buffer(), kind)


def _of_one_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Packs that follow each other and are of one bucket, as long as they hold few postings."""
    held, size = [], 0
    for pack in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
        if held and (size >= POSTINGS or held[0].column("bucket")[0] != pack.column("bucket")[0]):
            yield held
            held, size = [], 0
        held.append(pack)
        size += pack.column("term_no")[0].as_buffer().size // 4
    if held:
        yield held


def _matched(n_blocks: int):
    """Packs' postings by the wants that they meet, one row for each block of documents: tid, doc, batch, n as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packs in _of_one_bucket(batches):
            table = pa.Table.from_batches(packs).combine_chunks()
            terms, docs, hashes = (table.column(c).combine_chunks().flatten() for c in ("terms", "docs", "hashes"))
            term, met = _meetings(terms, pa.array(packs[0].column("words")[0].as_py().split(" "), pa.string()))
            code, own, n = ([_numbers(x, c, np.int32) for x in packs] for c in ("term_no", "doc_no", "n"))
            number = np.repeat(table.column("batch").to_numpy(), [len(x) for x in code])
            for part, held in ((code, "terms"), (own, "docs")):  # numbers within a pack become numbers within all of them
                for k, ahead in enumerate(np.cumsum([0, *(len(x.column(held)[0]) for x in packs[:-1])]).tolist()):
                    part[k] = part[k] + ahead
            code, own, n = (np.concatenate(x) for x in (code, own, n))
            first = np.searchsorted(term, np.arange(len(terms) + 1))
            size = np.diff(first)[code]
            at = np.repeat(np.arange(len(code)), size)
            if not len(at):
                continue
            tid = (packs[0].column("bucket")[0].as_py() << 32) + met[np.repeat(first[code] - (np.cumsum(size) - size), size) + np.arange(len(at))]
            block = (hashes.to_numpy() % n_blocks).astype(np.int32)[own[at]]
            order = np.argsort(block, kind="stable")
            at, tid = at[order], tid[order]
            blocks, start = np.unique(block[order], return_index=True)
            parts = [slice(i, j) for i, j in zip(start, [*start[1:], len(at)], strict=True)]
            raw = (tid, docs.to_numpy()[own[at]], number[at], n[at])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in raw)], ["block", "tid", "doc", "batch", "n"])

    return run


def _doc_block(postings: pa.Table, docs: pa.Table) -> pa.Table:
    """One row of a block: its live documents from the worst to the best of equal ones, and by want (tid, off) the places of those that meet it, with their counts, as bytes."""
    doc, batch = docs.column("doc").to_numpy(), docs.column("batch").to_numpy()
    at = docs.column("at").cast(pa.int64())
    known, at = at.is_valid().to_numpy(), at.fill_null(0).to_numpy()
    order = np.lexsort((doc, at, known))
    place = np.empty(len(doc), np.int64)
    place[order] = np.arange(len(doc))
    by_id = np.argsort(doc)
    mine, bits = doc[by_id], len(doc).bit_length()
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for part in postings.to_batches() if len(doc) else []:
        for row in (part.slice(k, 1) for k in range(part.num_rows)):
            tid, own = (_numbers(row, c, np.int64) for c in ("tid", "doc"))
            number, n = (_numbers(row, c, np.int32) for c in ("batch", "n"))
            where = by_id[np.minimum(np.searchsorted(mine, own), len(doc) - 1)]
            live = (doc[where] == own) & (batch[where] == number)
            keys.append((tid[live] << bits) + place[where[live]])
            counts.append(n[live])
    key, n = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    up = np.argsort(key)
    key = key[up]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # a document counts once for a want, with all its terms
    key, n = key[first], np.add.reduceat(n[up], first) if len(first) else n
    off = np.flatnonzero(np.diff(key >> bits, prepend=-1, append=-1))
    raw = [doc[order].astype(np.int64), at[order].astype(np.int64), known[order], key[off[:-1]] >> bits, off.astype(np.int64), (key & ((1 << bits) - 1)).astype(np.int32), n.astype(np.int32)]
    return pa.table({name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("docs", "at", "known", "tid", "off", "place", "n"), raw, strict=True)})


def _query_block(_key: tuple, rows: pa.Table) -> pa.Table:
    """Queries and the wants of each, without those that begin with another one: what meets them meets that one."""
    rows = rows.sort_by([("q", "ascending"), ("want", "ascending")])
    kept, above = [], None
    for k, (one, want) in enumerate(zip(rows.column("q").to_pylist(), rows.column("want").to_pylist(), strict=True)):
        if above is None or one != above[0] or not want.startswith(above[1]):
            kept.append(k)
            above = (one, want) if len(want) >= PREFIX else None
    q, tid = (rows.column(c).to_numpy()[kept].astype(np.int64) for c in ("q", "tid"))
    one, off = np.unique(q, return_index=True)
    raw = [one, np.append(off, len(q)).astype(np.int64), tid]
    return pa.table({name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("q", "q_off", "q_tid"), raw, strict=True)})


def _score(depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            docs, made, tid, off, q, q_off, q_tid = (_numbers(row, c, np.int64) for c in ("docs", "at", "tid", "off", "q", "q_off", "q_tid"))
            known, place, n = _numbers(row, "known", np.bool_), _numbers(row, "place", np.int32), _numbers(row, "n", np.int32).astype(float)
            if not len(tid):
                continue
            at = np.minimum(np.searchsorted(tid, q_tid), len(tid) - 1)
            hit = tid[at] == q_tid
            start, end, out = off[at].tolist(), off[at + 1].tolist(), []
            for j, one in enumerate(q.tolist()):
                mine = [slice(start[k], end[k]) for k in (np.flatnonzero(hit[q_off[j] : q_off[j + 1]]) + q_off[j]).tolist()]
                if not mine:
                    continue
                covers = np.bincount(np.concatenate([place[x] for x in mine]), weights=np.concatenate([n[x] for x in mine]), minlength=len(docs))
                best = np.flatnonzero(covers)
                if len(best) > depth:
                    key = covers[best] * len(docs) + best  # of equal covers, the later place is the better one
                    best = best[np.argpartition(key, len(best) - depth)[len(best) - depth :]]
                out.append((np.full(len(best), one), best, covers[best].astype(np.int64)))
            if out:
                q, best, covers = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(docs[best]), pa.array(covers), pa.array(made[best], pa.timestamp("us"), mask=~known[best])], ["q", "id", "covers", "at"])

    return run


def search(path: str, queries: DataFrame, q_col: str = "q", text_col: str = "text", depth: int = DEPTH, buckets: int = BUCKETS) -> DataFrame:
    """Each query's documents with any of its stems (as prefixes from PREFIX letters on): q, place, id, covers, at.

    covers is the number of places that match, each of them a cover of an OR query. Most covers first, then the newest, then the
    greatest id. The buckets' numbers (at most buckets of them) come to the driver, so that only their files are read.

    Packs meet the distinct words of all queries where they are read (each bucket's own words are broadcast to it), and what meets one
    is dealt into blocks of documents. Queries are dealt into blocks too, which are broadcast (eight bytes for each query and each of
    its words). A task counts each query's covers over its block of documents and gives its best ones alone: neither pairs of queries
    and documents nor pairs of queries and terms are ever rows.
    """
    spark = queries.sparkSession
    terms = written(wanted(queries, q_col, text_col))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("want")) - 1
    numbers = written(terms.select("want").distinct().withColumn("bucket", bucket(F.col("want"), buckets)).withColumn("tid", F.col("bucket") * F.lit(1 << 32) + nth))
    read = [r[0] for r in numbers.select("bucket").distinct().collect()]
    inside = F.col("bucket").isin(read) if read else F.lit(False)
    now = live(spark, path)
    n_blocks = max(spark.sparkContext.defaultParallelism, -(-now.count() // DOCS))
    block = F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).cast("int").alias("block")
    packs = _table(spark, path, "postings", PACK).where(inside).select("bucket", "batch", "terms", "docs", "hashes", "term_no", "doc_no", "n")
    words = numbers.groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list("want")), " ").alias("words"))
    hits = packs.join(F.broadcast(words), "bucket").mapInArrow(_matched(n_blocks), "block int, tid binary, doc binary, batch binary, n binary")
    blocks = hits.repartition(n_blocks, "block").groupBy("block").cogroup(now.select(block, "doc", "batch", "at").repartition(n_blocks, "block").groupBy("block"))
    blocks = blocks.applyInArrow(_doc_block, "docs binary, at binary, known binary, tid binary, off binary, place binary, n binary")
    dealt = terms.join(numbers, "want").select("q", "want", "tid", F.pmod(F.xxhash64("q"), F.lit(terms.select("q").distinct().count() // QUERIES + 1)).alias("part"))
    asked = written(dealt.groupBy("part").applyInArrow(_query_block, "q binary, q_off binary, q_tid binary"))
    found = blocks.crossJoin(F.broadcast(asked)).mapInArrow(_score(depth), "q bigint, id bigint, covers bigint, at timestamp_ntz")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("covers"), F.desc_nulls_last("at"), F.desc("id")))
    return found.select("q", place.cast("bigint").alias("place"), "id", "covers", "at").where(F.col("place") <= depth)
