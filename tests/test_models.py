import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillspark.catalog import models
from quillspark.operators import classify, explain, ngrams, vectors
from quillspark.sources import readers, writers


def toy(spark):
    rows = [(i, ["good", f"w{i % 5}"] if i % 2 else ["bad", f"w{i % 5}"], float(i % 2), float(i % 2) + (i % 5) / 10) for i in range(40)]
    return spark.createDataFrame(rows, "id long, ngrams array<string>, y double, f double").cache()


def test_naive_bayes_equals_closed_form(spark):
    train = toy(spark)
    model = classify.train_naive_bayes(train)
    vocabulary, theta = model.stages[0].vocabulary, model.stages[1].theta.toArray()
    counts = train.select("y", F.explode("ngrams").alias("ngram")).groupBy("y", "ngram").agg(F.count("*").alias("n"))
    for r in classify.naive_bayes_log_probabilities(counts, "y").collect():
        assert abs(theta[int(r.label), vocabulary.index(r.ngram)] - r.log_prob) < 1e-9


def test_separable_classes_and_probabilities(spark, tmp_path):
    train = toy(spark)
    model = classify.train_style_svm(train, ["f"], ["ngrams"], max_iter=20)
    scored = classify.predict(model, train, ["id", "y"])
    assert scored.where("prediction <> y").count() == 0
    calibrated = classify.with_probability(classify.calibrate(scored), scored)
    assert all(0 <= r.probability <= 1 and (r.probability > 0.5) == (r.y == 1) for r in calibrated.collect())
    writers.save_model(model, str(tmp_path / "m"))
    again = classify.predict(readers.load_model(str(tmp_path / "m")), train, ["id", "y"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))


def test_unseen_words_are_ignored_by_a_saved_vocabulary(spark):
    model = classify.train_naive_bayes(toy(spark))
    other = spark.createDataFrame([(1, ["never", "seen"])], "id long, ngrams array<string>")
    assert classify.score_unrelated(model, other).count() == 1


def test_importance_order(spark):
    model = classify.train_linear_svm(toy(spark), max_iter=10)
    table = explain.feature_importance(spark, explain.last_stage(model), model.stages[0].vocabulary)
    names = [r.feature for r in table.collect()]
    assert names[0] == "bad" and names[-1] == "good"


def test_imputer_and_scaler(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, float("nan")), (None, 4.0)], "a double, b double")
    out = classify.impute_mean(df, ["a", "b"]).transform(df).collect()
    assert [r.a_imputed for r in out] == [1.0, 3.0, 2.0] and out[1].b_imputed == 3.0


def test_similar_words(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "word string, vector array<float>")
    got = vectors.similar_words(df, "a", 3).collect()
    assert [r.word for r in got] == ["b", "c", "z"] and math.isclose(got[0].similarity, 2 / math.hypot(2, 0.1), rel_tol=1e-6)


def test_layout_is_sorted(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, a double")
    out = ngrams.vectorize_features(df, ["b", "a"]).transform(df).first()["feature_vector"]
    assert list(out) == [2.0, 1.0]


def test_calibration_equals_a_dense_fit(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(200) < 0.2).astype(float)
    score = rng.normal(size=200) + 1.5 * y
    scored = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, score, strict=True)], "y double, score double")
    one, zero = y.sum(), (1 - y).sum()
    for smooth, target in ((True, np.where(y == 1, (one + 1) / (one + 2), 1 / (zero + 2))), (False, y)):
        w, x = np.zeros(2), np.stack([score, np.ones(200)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-w @ x))
            w += np.linalg.solve((x * (p * (1 - p))) @ x.T, x @ (target - p))
        fitted = classify.calibrate(scored, smooth=smooth).stages[-1]
        assert abs(fitted.coefficients[0] - w[0]) < 1e-6 and abs(fitted.intercept - w[1]) < 1e-6


def test_perfectly_separated_scores_keep_finite_probabilities(spark):
    scored = spark.createDataFrame([(float(i > 4), float(i)) for i in range(10)], "y double, score double")
    out = classify.with_probability(classify.calibrate(scored), scored).agg(F.min("probability"), F.max("probability")).first()
    assert 0 < out[0] < 0.2 and 0.8 < out[1] < 1


def test_folds_score_both_sides(spark):
    rows = [(i, float(i % 2), float(i % 2) + (i * 7 % 13) / 14) for i in range(300)]
    train = spark.createDataFrame(rows, "id long, y double, f double")
    got = classify.grid_folds(train, ["f"], c_values=(0.1, 1.0), max_iters=(1, 4), folds=2).collect()
    assert len(got) == 8 and {(r.c, r.max_iter, r.fold) for r in got} == {(c, m, f) for c in (0.1, 1.0) for m in (1, 4) for f in range(2)}
    numbered = train.withColumn("fold", classify.fold_number("id", 2)).cache()
    for fold in range(2):
        part, held = numbered.where(F.col("fold") != fold), numbered.where(F.col("fold") == fold)
        model = classify.Pipeline(stages=classify.feature_stages(["f"]) + [classify.linear_svm(part.count(), 1.0, 4)]).fit(part)
        row = next(r for r in got if (r.c, r.max_iter, r.fold) == (1.0, 4, fold))
        for side, value in ((part, row.train), (held, row.validation)):
            assert abs(classify.MulticlassClassificationEvaluator(labelCol="y", metricName="f1").evaluate(model.transform(side)) - value) < 1e-9


def test_selection_by_model_follows_the_coefficients(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = (x[:, 1] - 2 * x[:, 3] > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, d double, y double")
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="x").transform(df).cache()
    slicer = classify.model_selection(rows, "x", max_iter=10)
    assert slicer.getIndices() == [1, 3] and len(slicer.transform(rows).first()["selected"]) == 2
    weights = [abs(w) for w in classify.linear_svm(300, max_iter=10).setFeaturesCol("x").fit(rows).coefficients]
    everything = classify.model_selection(rows, "x", threshold=min(weights), max_iter=10)
    assert everything.getIndices() == [0, 1, 2, 3]


def test_f_values_choose_what_anova_chooses(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5))
    y = (rng.random(200) < 0.5).astype(float)
    x[:, 2] += y * 0.6
    x[:, 4] += y * 0.9
    groups = [x[y == k] for k in (0, 1)]
    between = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups)
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / (len(x) - 2)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, d double, e double, y double")
    rows = VectorAssembler(inputCols=list("abcde"), outputCol="x").transform(df)
    assert sorted(classify.feature_selection(rows, "x", k=3).selectedFeatures) == sorted(np.argsort(-between / within)[:3].tolist())


def test_folds_of_the_grid_hold_no_texts(spark, monkeypatch):
    held = []
    monkeypatch.setattr(classify.CrossValidator, "fit", lambda self, rows: held.append(rows.columns))
    classify.grid_search(toy(spark).withColumn("text", F.lit("a text")), ["f"], folds=2)
    assert held == [["f", "y"]]


def test_an_unbounded_vocabulary_needs_no_counting_pass(spark, monkeypatch):
    def counted(*_):
        raise AssertionError("the vocabulary was counted ahead of the fit")

    monkeypatch.setattr(ngrams, "fit_vocabulary", counted)
    monkeypatch.setattr(classify, "fit_vocabulary", counted, raising=False)
    model = classify.train_naive_bayes(toy(spark))
    words = {t for r in toy(spark).collect() for t in r["ngrams"]}
    assert set(model.stages[0].vocabulary) == words == set(ngrams.fit_count_vectorizer(toy(spark)).vocabulary)
    assert len(classify.train_naive_bayes(toy(spark), max_vocab=1).stages[0].vocabulary) == 1


def test_training_table_holds_the_lists_that_are_read(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "ab cd" if k % 2 else "ef gh", "target" if k % 2 else "background") for k in range(40)], "id long, text string, label string")
    monkeypatch.setattr(models, "labelled", lambda *_: rows)
    assert not {"ngrams", "char_ngrams"} & set(models.training(spark, "").columns)
    table = models.training(spark, "", "ngrams")
    assert "char_ngrams" not in table.columns and sorted(table.where("id = 1").first()["ngrams"]) == ["ab", "cd"]
    assert models.training(spark, "", "char_ngrams").where("id = 1").first()["char_ngrams"] == ["ab ", "b c", " cd"]
