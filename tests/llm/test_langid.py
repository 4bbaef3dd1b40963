import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import langid as L

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = L.fit(docs.where(~held))
    rows = L.predict(docs.where(held), model, lang=F.col("lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    # words that were never seen still go by their letters
    unseen = L.Model(model.langs, {}, model.word_scores[:0], model.grams, model.gram_scores)
    rows = L.predict(docs.where(held), unseen, lang=F.col("lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, "the cat and the dog", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, None, "en", "s"), (4, "the the", None, "s"), (5, "12 ?! ²", "en", "s"),
            (6, "", "de", "s"), (7, "und " * 30000, "de", "s"), (7, "und " * 30000, "de", "s"), (None, "Der, HUND!", "de", "s"), (8, "xyzzy", "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = L.fit(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.predict(docs, model, doc_id=F.col("doc_id")).collect()]
    found = {i: lang for i, lang, _ in got}
    assert len(got) == len(rows)
    assert found == {1: "en", 2: "de", 3: "und", 4: "en", 5: "und", 6: "und", 7: "de", None: "de", 8: found[8]} and found[8] in ("en", "de")
    assert all((score == 0) == (lang == "und") for _, lang, score in got)
    empty = L.fit(docs.limit(0))
    assert {r["lang_pred"] for r in L.predict(docs, empty, doc_id=F.col("doc_id")).collect()} == {"und"}
    assert L.predict(docs.limit(0), model, doc_id=F.col("doc_id")).count() == 0
    # a bounded model hands rarer words to the n-grams
    small = L.fit(docs, max_words=1, max_grams=50)
    assert len(small.words) <= 1 and 0 < len(small.grams) <= 50


def test_words_and_grams_of_a_small_language_beside_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_WORDS", 100, raising=False)  # the words' scores come by join
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(56_000)})
    often, small, unseen = words[:52_000], words[52_000:52_040], words[52_040:52_080]
    rows = [(k, " ".join(often[k % 260 :: 260]), "aa", "s") for k in range(520)] + [(1000, " ".join(small), "bb", "s")]
    model = L.fit(spark.createDataFrame(rows, SCHEMA))
    texts = [" ".join(small), " ".join(small[:3] + often[:2]), " ".join(unseen), f"{unseen[0]} {small[1]}x ñandú", "ñ", *unseen, *small, None]
    docs = spark.createDataFrame([(k, t, None, "s") for k, t in enumerate(texts)], SCHEMA)
    got, whole = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(docs, m, doc_id=F.col("doc_id")).collect()}
                  for m in (model, L.fit(spark.createDataFrame(rows, SCHEMA), max_words=10**9, max_grams=10**9)))
    assert got[0] == ("bb", 1.0) and len(got) == len(texts)
    assert all(got[k][0] == whole[k][0] and abs(got[k][1] - whole[k][1]) < 1e-9 for k in whole)
