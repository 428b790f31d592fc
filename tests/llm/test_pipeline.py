"""corpus_pipeline against a plain chain of its stages, with nulls, repeated rows, shared ids, an empty table and extra columns."""

import random
from collections import Counter

import pytest
from brute import LOW, edit_substring, near_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = "river stone bright carry under seven bridge window letter garden morning silver corner market winter paper orange travel music forest".split()
ITEM = "which of the seven bridges over the silver river was built from orange stone in the winter before the market burned down"


def rows():
    rnd = random.Random(6)
    prose = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    base = prose(60)
    texts = [base, base + " end", base.upper(), prose(50), prose(40) + " " + ITEM + " " + prose(9), prose(30), "", None, " ", prose(3000)]
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(3, prose(20)), (None, prose(33)), (None, base), (None, ITEM), (None, None), (5, texts[5]), (40, texts[3].title())]
    for k in range(50, 110):
        bad = k % 3 == 0
        out.append((k, prose(15) + (" you zorgle smelly grubnik " * 3 if bad else " you are kind ") + prose(10)))
    return [(i, t, "en", f"src{n % 3}", len(t or ""), n) for n, (i, t) in enumerate(out)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, place int"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(50, 110)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def low(text):
    return (text or "").translate(LOW)


def test_stages_against_plain_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    have = [tuple(r) for r in docs.collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]

    def after(name):
        nonlocal docs
        docs = spark.createDataFrame([tuple(r) for r in steps[name](spark, docs, folder).collect()], SCHEMA)
        return Counter(tuple(r) for r in docs.collect())

    got = after("toxicity")
    gone = {r[0] for r in have} - {r[0] for r in got}
    assert gone and all(k >= 50 and k % 3 == 0 for k in gone) and len(gone) >= 18 and not got - Counter(have)
    have = list(got.elements())

    best = {}
    for r in have:
        best[low(r[1])] = max((x for x in (best.get(low(r[1])), r[0]) if x is not None), default=None)
    have = [r for r in have if r[0] == best[low(r[1])]]
    assert after("exact_dedup") == Counter(have)

    whole, label = [r for r in have if r[0] is not None], {}
    for i, (_, component) in near_components([(n, r[1]) for n, r in enumerate(whole)]).items():
        label[i] = component
    parent = {}  # rows that share an id are one document

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, r in enumerate(whole):
        a, b = find(r[0]), find(whole[label[n]][0])
        parent[max(a, b)] = min(a, b)
    have = [r for r in have if r[0] is None or find(r[0]) == r[0]]
    assert after("near_dedup") == Counter(have)

    have = [r for r in have if edit_substring(ITEM, " ".join(low(r[1]).split())) > int(0.15 * len(ITEM))]
    assert after("decontamination") == Counter(have)

    last = steps["sentencepiece"](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r[0] for r in have) and all(r["round_trip"] for r in last)
    whole_run = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in whole_run) == Counter((r["doc_id"], tuple(r["ids"])) for r in last)


def test_an_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
