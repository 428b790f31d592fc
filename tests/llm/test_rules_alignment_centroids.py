"""Quality rules, alignment of tokens and centroid clustering against plain versions."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from touchline.llm import alignment, centroids, quality_rules, queries

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "   ", "\n", "a", "a  b", " lead", "tail ", "tail  ", "x \n y", "▁x y", "<s> </s> <unk> <0x41> <|endoftext|> z", "x　y ｱ ﬁ é é", "🙂\x00\x01 a", "tab\t x  ", "a  b", "a　 b c",
    "don't we'll  it's", "你好 世界 これは" * 3, "\x7f b", "\x1c b\x1c  c", "a​ b", "﻿ a", "q\u0085 r", "x" * 3000 + " y", "one two three one two three\none two three\none two three\n\n \nfour " * 40,
]


# ---- quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_posteriors(votes, rounds=quality_rules.ROUNDS):
    """Expectation-maximisation document by document."""
    k, (share, g, b) = len(quality_rules.RULES), quality_rules.START
    good, bad = [g] * k, [b] * k

    def of(v):
        odds = math.log(share / (1 - share)) + sum(math.log(good[j] / (1 - bad[j])) if x == 1 else math.log((1 - good[j]) / bad[j]) if x == -1 else 0 for j, x in enumerate(v))
        return 1 / (1 + math.exp(-odds))

    ratio = lambda a, b: round((a + 1) / (a + b + 2), 9)
    for _ in range(rounds):
        p = [of(v) for v in votes]
        total = lambda j, x, q: sum(y for v, y in zip(votes, q, strict=True) if v[j] == x)  # noqa: B023, E731
        q = [1 - x for x in p]
        share = ratio(sum(p), sum(q))
        good, bad = [max(quality_rules.LEAST_RIGHT, ratio(total(j, 1, p), total(j, -1, p))) for j in range(k)], [ratio(total(j, -1, q), total(j, 1, q)) for j in range(k)]
    return [of(v) for v in votes]


def test_quality_counts_and_posteriors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r[0]: r[1] for r in docs.collect()}
    rows = quality_rules.judge_quality(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    for r, p in zip(rows, plain_posteriors([r["votes"] for r in rows]), strict=True):
        assert abs(r["quality"] - p) < 2e-6


def test_quality_tells_junk_from_prose(spark):
    """Labels are never read; held against them at sf0.01 over rows that the base rules let pass."""
    sf = "/root/testdata/sf0.01"
    rows = queries.op11_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").where("not base_failed")
    found = Counter((r["label"], r["kept"]) for r in rows.collect())
    assert found[1, True] >= 0.99 * (found[1, True] + found[1, False])
    assert found[0, False] >= 0.95 * (found[0, True] + found[0, False])


def test_quality_rows_nulls_columns_and_empty_tables(spark):
    prose = "The river was wide and the bridge of stone over it was old, but people in the town liked to walk there. " * 1 + " ".join(f"word{i} of the day." for i in range(40))
    docs = spark.createDataFrame([(1, prose, 0, "x"), (1, prose, 1, "y"), (None, prose, 2, None), (None, None, None, None)], "doc_id long, text string, n_words int, votes string")
    rows = quality_rules.judge_quality(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in rows) == [(0, 0), *[(x, r) for x, r in ((0, plain_counts(prose)[0]), (1, plain_counts(prose)[0]), (1, plain_counts(prose)[0]))]]
    assert len({r["quality"] for r in rows if r["n_words"]}) == 1
    assert quality_rules.judge_quality(docs.where("false")).collect() == []


def test_quality_uses_no_python_workers(spark):
    plan = quality_rules.measured(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


# ---- alignment


def plain_alignment(texts):
    """(n_a, n_b, groups, link counts) of each text, encoded whole, and the corpus counts of pairs."""
    v = alignment.opened(alignment.MODEL_A, alignment.MODEL_B)
    piece = lambda table, i: bytes(table.data[table.start[i] : table.start[i] + table.size[i]])
    out = []
    for text in texts:
        a = v.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = v.b.encode(text) if text else []
        size_a, size_b = [len(piece(v.table_a, i)) for i in a], [len(piece(v.table_b, i)) for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(piece(v.table_a, i) for i in a) != whole or b"".join(piece(v.table_b, i) for i in b) != whole:
            out.append((0, 0, [], Counter()))
            continue
        ends_a, ends_b = np.cumsum(size_a).tolist(), np.cumsum(size_b).tolist()
        groups, links, i, j, last = [([], [])], Counter(), 0, 0, 0
        while i < len(a):
            links[a[i], b[j]] += 1
            if groups[-1][0][-1:] != [i]:
                groups[-1][0].append(i)
            if groups[-1][1][-1:] != [j]:
                groups[-1][1].append(j)
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(([], []))
        out.append((len(a), len(b), [",".join(str(a[x]) for x in g) + "|" + ",".join(str(b[x]) for x in h) for g, h in groups[:-1]], links))
        assert last == 0
    return out, Counter(pair for *_, links in out for pair in links)


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_alignment_against_whole_texts(spark, most_pairs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r[0]: r[1] for r in docs.collect()}
    plain, counts = plain_alignment(texts.values())
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = {}
    for doc, (n_a, n_b, groups, links) in zip(texts, plain, strict=True):
        hashed = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        want[doc] = (n_a, n_b, len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashed)
    rows = alignment.align_tokens(docs, most_pairs=most_pairs).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want
    assert any(links and not groups[0].count("|") > 1 for _, _, groups, links in plain)


def test_alignment_rows_nulls_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "seven bridges", 5, "a"), (1, "seven bridges", 6, "b"), (None, "seven", None, None), (None, None, 1, "c")], "doc_id long, text string, row int, pair string")
    rows = sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in alignment.align_tokens(docs).collect())
    assert [r[0] for r in rows] == [0, 0, 1, 1] and rows[0] == (0, 0, 0) and rows[2] == rows[3]
    assert alignment.align_tokens(docs.where("false")).collect() == []


def test_components_are_the_connected_ones():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    want = list(range(400))
    for _ in range(400):
        for a, b in zip(u, v, strict=True):
            want[a] = want[b] = min(want[a], want[b])
    assert alignment.components(400, u, v).tolist() == want
    assert alignment.components(5, np.arange(4), np.arange(1, 5)).tolist() == [0] * 5


# ---- centroids


def test_centroids_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE["op13_centroids"]).fetchall()
    got = queries.op13_centroids(spark, SF)
    assert got.columns == [c[0] for c in con.description] and sorted(map(tuple, got.collect())) == sorted(want)


def plain_clusters(rows, size, clusters, rounds=5):
    kept = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:clusters]
    c = [list(q) for _, q in seeds]
    near = lambda q: min((sum((x - y) ** 2 for x, y in zip(q, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in set(own):
            mine = [q for (_, q), k in zip(kept, own, strict=True) if k == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    ends = [(i, *near(q)) for i, q in kept]
    per, total = Counter(), sum(d for _, d, _ in ends)
    for _, d, j in ends:
        per[j] += d
    return [(i, j, d, per[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in ends]


@pytest.mark.parametrize("spread", [1.0, 300_000.0])
def test_centroids_with_copies_nulls_and_ties(spark, spread):
    """A third of the rows are one vector, ids are null or repeated, and some vectors aren't kept; components of either sign, small and large."""
    rng = np.random.default_rng(7)
    rows = [(i if i % 9 else i // 2, [float(x) for x in np.float32(rng.normal(size=4) * spread / 4)]) for i in range(200)]
    rows += [(1000 + i, [spread * 0.5] * 4) for i in range(100)] + [(None, [-spread * 0.25] * 4)] * 3
    rows += [(1, None), (2, [1.0] * 3), (3, [1.0, None, 1.0, 1.0]), (4, [float("nan")] * 4), (5, [float("inf")] * 4), (6, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    table = table.selectExpr("*", "1 AS q", "2 AS n")
    plain = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = centroids.cluster_vectors(table, size=4, clusters=7, hot_share=10)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, plain_clusters(plain, 4, 7)))
    assert centroids.cluster_vectors(table.where("false"), size=4).collect() == []


def test_centroids_refuse_what_does_not_fit(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>"), size=2).collect()
