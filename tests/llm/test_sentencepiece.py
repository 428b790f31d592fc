import struct
import time

import sentencepiece
import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import sentencepiece_codec as codec
from touchline.llm import token_counts
from touchline.llm.pieces import DEFAULT_MODEL, code_points, fields, load, long_path, piece_scores, pretokens

TEXTS = [
    "",
    None,
    " ",
    "   three blanks  and\ttab\nline\n\nend ",
    "Is and retitioning ouen the of, nterti thorreou ndernt.",
    "Éréier enqueeau de, les la vioi menteux 中文字 \U0001f600\U0001f600x",
    "a▁b",
    "no_blank_" * 400,
    "กข" * 90,
    "xyz" * 100,
    "\r\n\x00 \x7f",
]


def unigram_library():
    """The same vocabulary in the library, declared a unigram model with our scores: its own search is the measure."""
    sp = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    raw = bytearray(sp.serialized_model_proto())
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    scores = dict(zip(normal, piece_scores(sp, normal), strict=True))
    i = 0
    for number, a, b in fields(bytes(raw)):
        inner = {n: a + x for n, x, _ in fields(bytes(raw[a:b]))}
        if number == 1:
            if i in scores:
                raw[inner[2] : inner[2] + 4] = struct.pack("<f", scores[i])
            i += 1
        elif number == 2:
            raw[inner[3]] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


@pytest.fixture(scope="module")
def pieces():
    return load()


def test_ids_as_the_librarys_unigram_viterbi(pieces):
    lib = unigram_library()
    ids, off = codec.encode(pa.array(TEXTS, pa.string()), pieces)
    for k, t in enumerate(TEXTS):
        assert ids[off[k] : off[k + 1]].tolist() == lib.nbest_encode_as_ids(t or "", 2)[0] if t else not len(ids[off[k] : off[k + 1]]), t


def test_round_trip(pieces):
    texts = [t for t in TEXTS if t is None or "▁" not in t]
    ids, off = codec.encode(pa.array(texts, pa.string()), pieces)
    data, rows = codec.decode(ids, off, pieces)
    assert [data[a:b].tobytes().decode() for a, b in zip(rows, rows[1:], strict=False)] == [t or "" for t in texts]


def test_counts_equal_encoding(pieces):
    column = pa.array(TEXTS, pa.string())
    words = pretokens(column, pieces)
    counts = token_counts.count_words(words, pieces)
    total = [int(counts[words.which[a:b]].sum()) for a, b in zip(words.row_off, words.row_off[1:], strict=False)]
    ids, off = codec.encode(column, pieces)
    assert total == np.diff(off).tolist()


def test_ties_have_the_best_total(pieces):
    lib = unigram_library()
    ids, _ = codec.encode(pa.array(["x" * 300]), pieces)
    total = lambda x: sum(lib.get_score(i) for i in x)
    assert total(ids.tolist()) == pytest.approx(total(lib.nbest_encode_as_ids("x" * 300, 2)[0]))


def test_runs_of_one_letter(pieces):
    """A pre-token of a megabyte takes seconds, and very long ones are cut as shorter ones are."""
    p = pieces
    for text in ("x" * 700, "ab" * 400, "na" * 300 + "\u4e00" * 300, "é" * 600):
        points = code_points(" " + text)
        for a, b in zip(long_path(points, p), codec._viterbi(points[None], p), strict=True):
            assert np.array_equal(a, b[0])
    column, began = pa.array(["x" * (1 << 20), "a b"]), time.time()
    ids, off = codec.encode(column, p)
    words = pretokens(column, p)
    assert token_counts.count_words(words, p)[words.which].sum() == off[-1]
    raw, ends = codec.decode(ids, off, p)
    assert raw[: ends[1]].tobytes() == b"x" * (1 << 20) and time.time() - began < 40


def test_ids_that_are_not_there(pieces):
    p = pieces
    for wrong in (-1, len(p.text)):
        with pytest.raises(IndexError):
            codec.decode(np.array([wrong]), np.array([0, 1]), p)


def test_null_ids_in_arrays(spark, pieces):
    p = pieces
    own = codec.encode(pa.array(["one two"]), p)[0].tolist()
    got = codec.decode_documents(spark.createDataFrame([(1, [own[0], None, *own[1:]]), (2, None), (None, [])], "doc_id bigint, ids array<int>"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "one two", 2: "", None: ""}
