"""The stored text index and the vector blocks against plain versions."""

import datetime
import random
import re

import numpy as np

from touchline.operators import search, textindex, vectors

T = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, text string, at timestamp_ntz"
TEXTS = {
    1: "The bridges over the river are old, and bridging rivers took years.",
    2: "A bridge; a BRIDGE! the bridge... of a river",
    3: "it is what it is and that was the",
    4: None,
    5: "Rivière of stone: the stones and a stony river bank.",
    6: "of an ox and ox carts",
    7: "a bridge over the bridge to one more bridge",
}


def plain_stem(w):
    if len(w) > 3 and re.search("(s|y|ing|ed)$", w):
        for pattern, stays in textindex.ENDINGS:
            w = re.sub(pattern, stays, w)
    return w


def plain_stems(text):
    words = [w for w in re.split("[^a-z0-9]+", (text or "").lower().replace("è", "e")) if w]
    return [(plain_stem(w), k) for k, w in enumerate(words) if w not in textindex.STOP_WORDS]


def plain_search(texts, days, query, depth=50):
    want = {w for w, _ in plain_stems(query)}
    covers = {i: len({k for w, k in plain_stems(t) if any(w.startswith(q) if len(q) >= 3 else w == q for q in want)}) for i, t in texts.items()}
    return [(i, covers[i]) for i in sorted(covers, key=lambda i: (-covers[i], -days[i], -i)) if covers[i]][:depth]


def rows(spark, texts, days):
    return spark.createDataFrame([(i, t, T + datetime.timedelta(days=days[i])) for i, t in texts.items()], SCHEMA)


def found(spark, path, queries):
    asked = spark.createDataFrame(list(queries.items()), "q long, text string")
    out = {q: [] for q in queries}
    for r in sorted(textindex.search(path, asked).collect(), key=lambda r: (r["q"], r["place"])):
        out[r["q"]].append((r["id"], r["covers"]))
    return out


QUESTIONS = {10: "bridges of rivers", 11: "the of and", 12: "ox", 13: "o", 14: "", 15: "stones", 16: "nothing here matches zzz"}


def test_index_search_changes_and_compaction(spark, tmp_path):
    path, to = str(tmp_path / "index"), str(tmp_path / "compact")
    texts, days = dict(TEXTS), {i: i % 3 for i in range(20)}
    days[7] = 9
    assert textindex.add(rows(spark, texts, days).withColumn("bucket", textindex.F.lit("clash")), path, "id", "text", "at") == 1
    want = lambda: {q: plain_search(texts, days, t) for q, t in QUESTIONS.items()}
    assert found(spark, path, QUESTIONS) == want()
    assert found(spark, path, QUESTIONS)[11] == [] and len(want()[10]) >= 4 and want()[12] == [(6, 2)]
    more = {2: "now about stones only", 8: "one more river", 9: "bridge"}
    files = {f for f in (tmp_path / "index").rglob("*.parquet")}
    assert textindex.add(rows(spark, more, days), path, "id", "text", "at") == 2
    assert files < {f for f in (tmp_path / "index").rglob("*.parquet")}  # what was there stays as it was
    texts |= more
    assert found(spark, path, QUESTIONS) == want()
    textindex.remove(spark.createDataFrame([(5,), (1,), (1,)], "id long"), path, "id")
    del texts[5], texts[1]
    assert found(spark, path, QUESTIONS) == want()
    textindex.compact(spark, path, to)
    assert found(spark, to, QUESTIONS) == want()
    held = {r[0] for r in spark.read.parquet(f"{to}/postings").select("doc").distinct().collect()}
    assert held <= set(texts)


def test_index_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "index")
    textindex.add(rows(spark, TEXTS, dict.fromkeys(TEXTS, 0)), path, "id", "text", "at")
    asked = spark.createDataFrame([(1, "bridges")], "q long, text string")
    plan = textindex.search(path, asked)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_index_of_nothing_and_null_ids(spark, tmp_path):
    path = str(tmp_path / "index")
    textindex.add(spark.createDataFrame([(None, "bridge", T), (3, "bridge", T), (3, "river", T), (3, None, None)], SCHEMA), path, "id", "text", "at")
    assert found(spark, path, {1: "bridge", 2: "river"}) == {1: [], 2: [(3, 1)]}  # of rows that share an id, the newest, then the greatest text


def test_nearest_and_recall_against_plain(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 16)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in np.float32(rng.normal(size=6))], int(rng.integers(0, 9)) if i % 11 else None) for i in range(150)]
    data += [(200, [0.0] * 6, 1), (201, None, 1), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (203, data[3][1], 99), (204, data[3][1], 99)]
    data += [(300 + i, [float(x) for x in -np.array(data[7][1])], 77 if i else 5) for i in range(3)] + [(400, data[7][1], 77)]
    table = spark.createDataFrame([(i, v, x, "x") for i, v, x in data], "vec_id long, embedding array<float>, label int, matrix string").repartition(5)
    live = [(i, np.array(v), x) for i, v, x in data if v is not None and None not in v and any(v)]
    queries = [r for r in live if r[0] % 10 == 0]
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
    got = {(r["q"], r["place"]): (r["id"], r["score"]) for r in vectors.nearest_each(table, table.where("vec_id % 10 = 0"), "vec_id", "embedding", 7).collect()}
    plain = {q: sorted(((cos(v, w), i) for i, w, _ in live), reverse=True) for q, v, _ in queries}
    assert {k: v[0] for k, v in got.items()} == {(q, n + 1): i for q, x in plain.items() for n, (_, i) in enumerate(x[:7])}
    assert all(abs(s - plain[q][p - 1][0]) < 2e-6 for (q, p), (_, s) in got.items())
    want = {}
    for q, _, label in queries:
        order = [i for _, i in plain[q] if i != q]
        relevant = {i for i, _, x in live if x == label and x is not None and i != q}
        if relevant:
            want[q] = (len(relevant), len(relevant & set(order[:5])) / len(relevant), 1 / (1 + min(order.index(i) for i in relevant)))
    rows_ = vectors.recall(table, table.where("vec_id % 10 = 0"), "vec_id", "embedding", "label", 5).collect()
    assert {r["q"]: tuple(r)[1:] for r in rows_} == want
    assert any(r < 1 / 5 for *_, r in want.values())  # the second pass is taken


def test_a_word_counts_for_its_first_term(spark):
    rng = random.Random(8)
    words = ["than", "thanks", "thank", "the", "th", "of", "offer", "öf", "x-than", "o", "than2", "ofx", "THAN."]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(12))) for i in range(60)} | {90: None, 91: ""}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    for terms in (["than", "of"], ["thank", "than", "thanks"], ["than", "thank", "of", "of"], ["of", "o", "offer"], ["the", "th"]):
        want = []
        for i, t in texts.items():
            hits = [next((q for q in terms if (w.startswith(q) if len(q) >= 3 else w == q)), None) for w in re.split("[^a-z0-9]+", (t or "").lower().replace("ö", "o")) if w]
            hits = [h for h in hits if h]
            if hits:
                want.append((len(set(hits)), len(hits), i))
        got = [(r["matched"], r["tf"], r["id"]) for r in sorted(search.full_text(docs, "id", "text", terms, 50).collect(), key=lambda r: r["place"])]
        assert got == sorted(want, reverse=True)[:50], terms
    assert search.full_text(docs, "id", "text", [], 5).collect() == []
