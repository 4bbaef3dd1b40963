"""Queries: evaluation, training, calibration, explanation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillspark.catalog.base import LABELS_CTE, MASKED_CTE, labelled, query, r9, raw_posts, re2, table
from quillspark.catalog.styles import CHAR_SQL
from quillspark.catalog.vocabularies import _SPLIT_WORDS, split_posts
from quillspark.functions import constants as C
from quillspark.functions import patterns as P
from quillspark.functions.rows import explode_rows
from quillspark.operators import blocks, classify, evaluate, explain, features, filters, ngrams, splits, term_models
from quillspark.plans import style as style_plan
from quillspark.session import materialize, new_path

# ----------------------------------------------------------------------- evaluation

_GUESS = (
    "CASE WHEN contains(text, 'ß') OR contains(text, 'ä') THEN 'de' WHEN contains(text, 'é') THEN 'fr' "
    "WHEN contains(text, 'ñ') THEN 'pt' ELSE 'en' END"
)
GUESS_CTE = f"g AS (SELECT doc_id AS id, text, lang AS label, {_GUESS} AS prediction FROM documents)"


def guesses(spark, sf):
    """Language as the class, and a guess by letters; one guessed class never occurs as a label, one label is never guessed."""
    return raw_posts(spark, sf).select("id", "text", F.col("language").alias("label"), F.expr(_GUESS).alias("prediction"))


@query("misclassified", f"WITH {GUESS_CTE} SELECT id, label, prediction FROM g WHERE label <> prediction")
def misclassified(spark, sf):
    return filters.misclassified(guesses(spark, sf)).select("id", "label", "prediction")


_COUNTS_CTE = (
    f"{GUESS_CTE}, cls AS (SELECT DISTINCT label AS c FROM g), cc AS (SELECT c AS label, "
    "(SELECT count(*) FROM g WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM g WHERE label <> c AND prediction = c) AS fp, "
    "(SELECT count(*) FROM g WHERE label = c AND prediction <> c) AS fn FROM cls)"
)


@query("confusion_counts", f"WITH {_COUNTS_CTE} SELECT label, tp AS true_positives, fp AS false_positives, fn AS false_negatives FROM cc")
def confusion_counts(spark, sf):
    return evaluate.confusion_counts(guesses(spark, sf))


@query(
    "prf_rounded",
    f"WITH {_COUNTS_CTE}, pr AS (SELECT label, round(tp::DOUBLE / nullif(tp + fp, 0), 2) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 2) AS recall FROM cc) "
    "SELECT label, precision, recall, round(2 * precision * recall / nullif(precision + recall, 0), 2) AS f1 FROM pr",
)
def prf_rounded(spark, sf):
    return evaluate.prf_rounded(evaluate.confusion_counts(guesses(spark, sf)))


def _report_sql(gold: str, machine: str) -> str:
    return (
        f"WITH {GUESS_CTE}, classes AS (SELECT label AS c FROM g UNION SELECT prediction FROM g), "
        f"s AS (SELECT c, count(*) FILTER ({gold} = c AND {machine} = c) AS tp, count(*) FILTER ({machine} = c) AS m, count(*) FILTER ({gold} = c) AS gd FROM g, classes GROUP BY c), "
        "pc AS (SELECT c AS label, tp, gd AS support, coalesce(tp::DOUBLE / nullif(m, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(gd, 0), 0) AS r, coalesce(2 * tp::DOUBLE / nullif(m + gd, 0), 0) AS f FROM s) "
        "SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM pc UNION ALL "
        "SELECT 'accuracy', round(sum(tp)::DOUBLE / sum(support), 6), round(sum(tp)::DOUBLE / sum(support), 6), round(sum(tp)::DOUBLE / sum(support), 6), sum(support)::BIGINT FROM pc UNION ALL "
        "SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM pc UNION ALL "
        "SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM pc"
    )


@query("classification_report", _report_sql("label", "prediction"))
def classification_report(spark, sf):
    return evaluate.classification_report(guesses(spark, sf))


@query("classification_report_swapped", _report_sql("prediction", "label"))
def classification_report_swapped(spark, sf):
    return evaluate.classification_report(guesses(spark, sf), swap=True)


@query("confusion_matrix", f"WITH {GUESS_CTE} SELECT label, prediction, count(*) AS value FROM g GROUP BY ALL")
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(guesses(spark, sf))


@query(
    "confusion_matrix_normalized",
    f"WITH {GUESS_CTE}, c AS (SELECT label, prediction, count(*) AS n FROM g GROUP BY ALL) "
    "SELECT 'true' AS norm, label, prediction, round(n::DOUBLE / sum(n) OVER (PARTITION BY label), 6) AS value FROM c UNION ALL "
    "SELECT 'pred', label, prediction, round(n::DOUBLE / sum(n) OVER (PARTITION BY prediction), 6) FROM c UNION ALL "
    "SELECT 'all', label, prediction, round(n::DOUBLE / sum(n) OVER (), 6) FROM c",
)
def confusion_matrix_normalized(spark, sf):
    rows = guesses(spark, sf)
    parts = [evaluate.confusion_matrix(rows, normalize=n).withColumn("norm", F.lit(n)) for n in ("true", "pred", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "confusion_table",
    f"WITH {GUESS_CTE} SELECT label, count(*) FILTER (prediction = 'de') AS de, count(*) FILTER (prediction = 'en') AS en, count(*) FILTER (prediction = 'fr') AS fr FROM g GROUP BY label",
)
def confusion_table(spark, sf):
    return evaluate.confusion_table(guesses(spark, sf), ["de", "en", "fr"])


@query("attach_labels", f"WITH {GUESS_CTE} SELECT id, text, label, prediction FROM g")
def attach_labels(spark, sf):
    rows = guesses(spark, sf)
    return evaluate.attach_labels(rows.select("id", "prediction"), rows.select("id", "text", "label"))


# -------------------------------------------------------------------------- training

CHAR_NAMES = features.feature_names(levels=("character_level",))


#: Solver steps of the registered training runs; the vocabulary is never cut.
ITERATIONS = 100


def training(spark, sf, *lists):
    """Labelled posts with character features, class index and split, written once, with the n-gram lists that the query reads."""
    rows = features.extract_features(labelled(spark, sf), names=CHAR_NAMES, keep=("label", "text"))
    rows = splits.stratified_split(materialize(classify.with_class_index(rows, "target"), "features"))
    rows = ngrams.with_word_ngrams(ngrams.with_char_ngrams(rows, 3, out="char_ngrams"), 1, out="ngrams")
    return materialize(rows.drop(*{"char_ngrams", "ngrams"}.difference(lists)), "training")


def parts(rows):
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def shown(df, *more):
    return df.select("id", "label", F.col("prediction").cast("int").alias("prediction"), *more)


_NB_CTE = (
    f"{_SPLIT_WORDS}, k AS (SELECT label, ngram, count(*) AS n FROM w WHERE split = 'train' GROUP BY ALL), "
    "tot AS (SELECT label, sum(n) AS total FROM k GROUP BY 1), "
    "lp AS (SELECT tot.label AS c, v.ngram, ln((coalesce(k.n, 0) + 1.0::DOUBLE) / (tot.total + (SELECT count(*) FROM vocab))::DOUBLE) AS log_prob "
    "FROM vocab v CROSS JOIN tot LEFT JOIN k ON k.ngram = v.ngram AND k.label = tot.label), "
    "prior AS (SELECT label AS c, ln(count(*) + 1.0::DOUBLE) - ln((SELECT count(*) FROM s WHERE split = 'train') + 2.0::DOUBLE) AS p FROM s WHERE split = 'train' GROUP BY label)"
)


def _nb_sql(ctes: str, posts: str, words: str) -> str:
    """Class with the largest prior plus summed log probabilities; ``posts`` has id and label, ``words`` id and ngram."""
    return (
        f"WITH {_NB_CTE}{ctes}, hit AS (SELECT x.id, lp.c, sum(lp.log_prob) AS l FROM {words} x JOIN lp USING (ngram) GROUP BY ALL), "
        f"scored AS (SELECT d.id, d.label, prior.c, prior.p + coalesce(hit.l, 0) AS l FROM {posts} d CROSS JOIN prior LEFT JOIN hit ON hit.id = d.id AND hit.c = prior.c) "
        "SELECT id, label, (max(l) FILTER (c = 'target') > max(l) FILTER (c <> 'target'))::INTEGER AS prediction FROM scored GROUP BY ALL"
    )


_NB_TEST_SQL = _nb_sql("", "(SELECT id, label FROM s WHERE split = 'test')", "(SELECT id, ngram FROM w WHERE split = 'test')")


@query("train_naive_bayes", _NB_TEST_SQL)
def train_naive_bayes(spark, sf):
    train, test = parts(training(spark, sf, "ngrams"))
    return shown(classify.train_naive_bayes(train).transform(test))


@query("naive_bayes_from_tables", _NB_TEST_SQL)
def naive_bayes_from_tables(spark, sf):
    """Naive Bayes whose vocabulary and log probabilities are tables."""
    train, test = (blocks.term_blocks(rows, "ngrams", ["id", "label"]) for rows in parts(materialize(split_posts(spark, sf), "split-posts")))
    scored = term_models.NaiveBayesTable.fit(train).predict(test)
    return scored.select("id", "label", (F.col("prediction") == "target").cast("int").alias("prediction"))


@query("train_squared_hinge")
def train_squared_hinge(spark, sf):
    """Linear SVM with squared hinge loss on word counts, weights in a table."""
    train, test = (blocks.term_blocks(rows, "ngrams", ["id", "label"]) for rows in parts(materialize(split_posts(spark, sf), "split-posts")))
    model = term_models.SquaredHinge.fit(train, "label", "target", c=C.SVM_C)
    return shown(model.predict(test), "score")


@query(
    "naive_bayes_log_probabilities",
    f"WITH {_SPLIT_WORDS}, k AS (SELECT label, ngram, count(*) AS n FROM w WHERE split = 'train' GROUP BY ALL), "
    "tot AS (SELECT label, sum(n) AS total FROM k GROUP BY 1) "
    "SELECT tot.label, v.ngram, round(ln((coalesce(k.n, 0) + 1.0::DOUBLE) / (tot.total + (SELECT count(*) FROM vocab))::DOUBLE), 9) AS log_prob "
    "FROM vocab v CROSS JOIN tot LEFT JOIN k ON k.ngram = v.ngram AND k.label = tot.label",
)
def naive_bayes_log_probabilities(spark, sf):
    train = split_posts(spark, sf).where("split = 'train'")
    counts = explode_rows(train, ["label"], "ngrams", "ngram").groupBy("label", "ngram").agg(F.count(F.lit(1)).alias("n"))
    out = classify.naive_bayes_log_probabilities(counts)
    return out.withColumn("log_prob", r9("log_prob"))


@query("train_linear_svm")
def train_linear_svm(spark, sf):
    train, test = parts(training(spark, sf, "char_ngrams"))
    model = classify.train_linear_svm(train, "char_ngrams", max_iter=ITERATIONS)
    return shown(model.transform(test))


@query("train_random_forest")
def train_random_forest(spark, sf):
    train, test = parts(training(spark, sf, "char_ngrams"))
    return shown(classify.train_random_forest(train, "char_ngrams", n_trees=C.FOREST_TREES).transform(test))


@query("grid_search")
def grid_search(spark, sf):
    train, _ = parts(training(spark, sf))
    model = classify.grid_search(train, CHAR_NAMES, c_values=(0.1, 1.0), max_iters=(20, 100), folds=3)
    return classify.grid_scores(model, spark)


@query("grid_search_folds")
def grid_search_folds(spark, sf):
    """Every grid point on both sides of every fold."""
    train, _ = parts(training(spark, sf))
    return classify.grid_folds(train, CHAR_NAMES, c_values=(0.1, 1.0), max_iters=(5, 10))


_FOLD_SQL = f"floor(('0x' || md5(id::VARCHAR || ':{C.SPLIT_SEED}:fold')[1:8])::BIGINT::DOUBLE / 4294967296::DOUBLE * 3)::INTEGER"


@query("fold_number", f"WITH {_SPLIT_WORDS} SELECT id, label, {_FOLD_SQL} AS fold FROM s WHERE split = 'train'")
def fold_number(spark, sf):
    train = split_posts(spark, sf).where("split = 'train'")
    return train.select("id", "label", classify.fold_number("id", 3).alias("fold"))


@query("feature_selection_by_model")
def feature_selection_by_model(spark, sf):
    """Features whose coefficient is at least of mean size, fitted on scaled training rows."""
    train, _ = parts(training(spark, sf))
    prepared = Pipeline(stages=classify.feature_stages(CHAR_NAMES)).fit(train).transform(train)
    slicer = classify.model_selection(materialize(prepared.select("x", "y"), "scaled"), "x", max_iter=ITERATIONS)
    names = sorted(CHAR_NAMES)
    return spark.createDataFrame([(names[i],) for i in slicer.getIndices()], "feature string")


@query("train_style_svm")
def train_style_svm(spark, sf):
    _, scored = style_plan.train_and_score(training(spark, sf, "char_ngrams"), CHAR_NAMES, ["char_ngrams"], max_iter=ITERATIONS)
    return shown(scored, "score", "probability", "confidence")


@query(
    "scale_features",
    f"WITH {MASKED_CTE}, {LABELS_CTE}, l2 AS (SELECT id, replace(text, '@USER', '@user') AS text FROM labelled), "
    f"v AS (SELECT id, {CHAR_SQL['digit_freq']} AS a, {CHAR_SQL['uppercased_char_freq']} AS b FROM l2) "
    "SELECT id, round(a / (SELECT stddev_samp(a) FROM v), 6) AS digit_scaled, round(b / (SELECT stddev_samp(b) FROM v), 6) AS upper_scaled FROM v",
)
def scale_features(spark, sf):
    names = ["digit_freq", "uppercased_char_freq"]
    rows = features.extract_features(labelled(spark, sf), names=names)
    scaled = vector_to_array("scaled")
    out = classify.scale_features(rows, names).transform(rows)
    return out.select("id", F.round(scaled[0], 6).alias("digit_scaled"), F.round(scaled[1], 6).alias("upper_scaled"))


@query(
    "impute_mean",
    "WITH v AS (SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN n_chars::DOUBLE END AS x FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) "
    "SELECT id, round(coalesce(x, (SELECT avg(x) FROM v)), 6) AS x FROM v",
)
def impute_mean(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("good"))
    rows = raw_posts(spark, sf).join(good, "id", "left").select("id", F.when(F.col("good"), F.col("favs").cast("double")).alias("x"))
    return classify.impute_mean(rows, ["x"]).transform(rows).select("id", F.round("x_imputed", 6).alias("x"))


def _svm(spark, sf):
    train, test = parts(training(spark, sf))
    return classify.train_style_svm(train, CHAR_NAMES, max_iter=ITERATIONS), train, test


@query("predict")
def predict(spark, sf):
    model, _, test = _svm(spark, sf)
    return classify.predict(model, test, ["id", "label"])


@query("calibrate")
def calibrate(spark, sf):
    model, train, test = _svm(spark, sf)
    sigmoid = classify.calibrate(classify.predict(model, train, ["y"]))
    out = classify.with_probability(sigmoid, classify.predict(model, test, ["id", "label", "y"]))
    return out.select("id", "label", "score", "probability")


@query(
    "score_unrelated",
    _nb_sql(
        f", other AS (SELECT item_id AS id, 'background' AS label, text FROM benchmark), ow AS (SELECT id, unnest(regexp_extract_all(text, {re2(P.LONG_WORD)})) AS ngram FROM other)",
        "other", "ow",
    ),
)
def score_unrelated(spark, sf):
    train, _ = parts(training(spark, sf, "ngrams"))
    model = classify.train_naive_bayes(train)
    other = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("background").alias("label"))
    scored = classify.score_unrelated(model, ngrams.with_word_ngrams(other, 1))
    return shown(scored)


@query("feature_ablation")
def feature_ablation(spark, sf):
    train, test = parts(training(spark, sf))
    sets = {
        "all": CHAR_NAMES, "flags": [n for n in CHAR_NAMES if not n.endswith("_freq")],
        "ratios": [n for n in CHAR_NAMES if n.endswith("_freq")],
    }
    return classify.feature_ablation(train, test, sets, max_iter=ITERATIONS)


@query("feature_selection")
def feature_selection(spark, sf):
    train, _ = parts(training(spark, sf))
    assembled = ngrams.vectorize_features(train, CHAR_NAMES).transform(train)
    chosen = classify.feature_selection(assembled, "feature_vector", k=5).selectedFeatures
    names = sorted(CHAR_NAMES)
    return spark.createDataFrame([(names[i],) for i in chosen], "feature string")


@query("feature_importance")
def feature_importance(spark, sf):
    model, train, _ = _svm(spark, sf)
    return explain.feature_importance(spark, explain.last_stage(model), sorted(CHAR_NAMES))


@query("top_predictive")
def top_predictive(spark, sf):
    train, _ = parts(training(spark, sf, "char_ngrams"))
    model = classify.train_linear_svm(train, "char_ngrams", max_iter=ITERATIONS)
    vocabulary = model.stages[0].vocabulary
    return explain.top_predictive(explain.feature_importance(spark, explain.last_stage(model), vocabulary))


_COEF = {"digit_freq": 2.0, "special_char_freq": -1.5, "contains_equals": 0.25}
_SHAP_SQL = (
    f"WITH {MASKED_CTE}, {LABELS_CTE}, l2 AS (SELECT id, replace(text, '@USER', '@user') AS text FROM labelled), "
    f"v AS (SELECT id, {', '.join(f'{CHAR_SQL[n]} AS {n}' for n in _COEF)} FROM l2), sh AS ("
    + " UNION ALL ".join(f"SELECT id, '{n}' AS feature, {c}::DOUBLE * ({n} - (SELECT avg({n}) FROM v)) AS contribution FROM v" for n, c in _COEF.items())
    + ") "
)


def _shap(spark, sf):
    rows = features.extract_features(labelled(spark, sf), names=list(_COEF))
    return explain.linear_shap(rows, rows, _COEF)


@query("linear_shap", _SHAP_SQL + "SELECT id, feature, round(contribution, 9) AS contribution FROM sh")
def linear_shap(spark, sf):
    return _shap(spark, sf).withColumn("contribution", r9("contribution"))


@query("shap_ranking", _SHAP_SQL + "SELECT feature, round(avg(abs(contribution)), 9) AS mean_abs FROM sh GROUP BY 1")
def shap_ranking(spark, sf):
    return explain.shap_ranking(_shap(spark, sf)).withColumn("mean_abs", r9("mean_abs"))


@query("run_log")
def run_log(spark, sf):
    from quillspark.sources import writers

    model, _, test = _svm(spark, sf)
    path = new_path(spark, "run-log")
    writers.append_run_log(classify.run_metrics(model.transform(test), "style-svm", len(CHAR_NAMES), True), path)
    return spark.read.parquet(path)


@query("save_load_model", _NB_TEST_SQL)
def save_load_model(spark, sf):
    from quillspark.sources import readers, writers

    train, test = parts(training(spark, sf, "ngrams"))
    path = new_path(spark, "model")
    writers.save_model(classify.train_naive_bayes(train), path)
    return shown(readers.load_model(path).transform(test))
