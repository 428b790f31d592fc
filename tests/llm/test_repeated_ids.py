"""Many rows on one id, and columns with the operators' own names."""

from pyspark.sql import functions as F

from touchline.llm import decontaminate, exact_dedup, langid, toxicity
from touchline.llm.shared import bounded, free_name

#: An id that every sample chooses: its hash is among the smallest.
def chosen_id(spark, modulus, remainder):
    ids = spark.range(400_000).where(f"crc32(cast(id as string)) % {modulus} <> {remainder}").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    return ids.first()["id"]


def test_language_sample_is_bounded(spark, monkeypatch):
    one, seen = chosen_id(spark, 3, 1), []
    rows = [(one, f"the same id and the words number {i} of many", "en") for i in range(6000)] + [(one, "equal rows count once", "en")] * 3000 + [(i, f"der Satz Nummer {i} ist nicht lang", "de") for i in range(600)]
    real = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, lang: seen.append(len(lang)) or real(x, lang))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6), "doc_id", "text", "lang", (3, 1), 40)
    assert 20 < seen[0] <= langid.MOST * 40 and model.families


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    one = chosen_id(spark, 5, 0)
    monkeypatch.setattr(toxicity, "FIT_DOCS", 30)
    docs = spark.createDataFrame([(one, f"clean words {i} in a row") for i in range(8000)] + [(one + 1 + i, f"you are an idiot and clown {i}" if i % 2 else f"a calm day {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 0)] * 5000 + [(one + 1 + i, i % 2) for i in range(200)], "doc_id long, toxic int")
    sizes = []
    real = toxicity.bounded
    monkeypatch.setattr(toxicity, "bounded", lambda df, columns, most: sizes.append((df.count(), (out := real(df, columns, most)).count(), most)) or out)
    toxicity.train(docs, labels, fit_docs=30)
    before, after, most = sizes[0]
    assert before >= 8000 and after <= most == 90


def test_bounded_keeps_small_samples_whole(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b")], "id long, text string")
    assert sorted(map(str, bounded(df, ["id", "text"], 10).collect())) == sorted(map(str, df.distinct().collect()))
    assert bounded(df, ["id", "text"], 2).count() == 2


def test_columns_of_the_operators_names_stay(spark):
    docs = spark.createDataFrame([(1, "One text", "x", 1), (2, "one TEXT", "y", 2), (3, "another", None, 3)], "doc_id long, text string, __digest string, __DIGEST_ int")
    assert free_name(docs, "__digest") == "__digest__"
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(2, "one TEXT", "y", 2), (3, "another", None, 3)]
    item = "which of the seven bridges over the silver river was built from orange stone in the winter before the market burned down"
    docs = docs.unionByName(spark.createDataFrame([(4, f"so {item} it is", "z", 4)], docs.schema))
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
