"""Training, calibration and scoring of style classifiers on Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, Imputer, StandardScaler, UnivariateFeatureSelector, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.operators.ngrams import ALL_TERMS
from quillspark.operators.evaluate import classification_report
from quillspark.operators.filters import misclassified
from quillspark.operators.splits import position_share
from quillspark.session import materialize


def with_class_index(df: DataFrame, target: str, label_col: str = "label", out: str = "y") -> DataFrame:
    """0.0 / 1.0 column: 1.0 for the target class."""
    return df.withColumn(out, F.when(F.col(label_col) == target, 1.0).otherwise(0.0))


def ngram_stages(ngrams_col: str = "ngrams", out: str = "ngram_vector", max_vocab: int | None = None) -> list:
    """Count vectors of all n-grams of the training rows, or of the ``max_vocab`` most frequent."""
    return [CountVectorizer(inputCol=ngrams_col, outputCol=out, vocabSize=ALL_TERMS if max_vocab is None else max_vocab, minDF=1.0)]


def feature_stages(names: list[str], vectors: list[str] | None = None, scale: bool = True, out: str = "x") -> list:
    """Mean imputation, assembly in sorted order, variance scaling without centring.

    The imputer is always fitted on the training rows.
    """
    names = sorted(names)
    imputed = [f"{n}_imputed" for n in names]
    stages: list = [Imputer(strategy="mean", inputCols=names, outputCols=imputed)] if names else []
    raw = f"{out}_raw" if scale else out
    stages.append(VectorAssembler(inputCols=imputed + list(vectors or []), outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=out, withMean=False, withStd=True))
    return stages


def impute_mean(train: DataFrame, names: list[str]):
    """Imputer fitted on the training rows; NULL and NaN both count as missing."""
    return Imputer(strategy="mean", inputCols=names, outputCols=[f"{n}_imputed" for n in names]).fit(train)


def scale_features(train: DataFrame, names: list[str]) -> PipelineModel:
    """Variance scaling (sample standard deviation, no centring) fitted on the training rows."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(names), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="scaled", withMean=False, withStd=True),
    ]).fit(train)


def naive_bayes(features_col: str = "x", label_col: str = "y") -> NaiveBayes:
    return NaiveBayes(modelType="multinomial", smoothing=1.0, featuresCol=features_col, labelCol=label_col)


def linear_svm(n_rows: int, c: float = C.SVM_C, max_iter: int = C.SVM_MAX_ITER, features_col: str = "x", label_col: str = "y") -> LinearSVC:
    """Linear SVM with an L2 penalty of ``1 / (c * n_rows)``.

    Hinge loss and an unpenalised intercept (the squared hinge loss does not
    exist in Spark ML).
    """
    return LinearSVC(
        regParam=1.0 / (c * max(n_rows, 1)), standardization=False, maxIter=max_iter, tol=1e-4,
        featuresCol=features_col, labelCol=label_col, rawPredictionCol="rawPrediction",
    )


def random_forest(n_trees: int = C.FOREST_TREES, max_depth: int = 30, seed: int = C.SPLIT_SEED, features_col: str = "x", label_col: str = "y") -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=n_trees, maxDepth=max_depth, seed=seed, featuresCol=features_col, labelCol=label_col
    )


def train_naive_bayes(train: DataFrame, ngrams_col: str = "ngrams", max_vocab: int | None = None) -> PipelineModel:
    """Multinomial naive Bayes on n-gram counts."""
    return Pipeline(stages=ngram_stages(ngrams_col, "x", max_vocab) + [naive_bayes()]).fit(train)


def train_linear_svm(train: DataFrame, ngrams_col: str = "ngrams", max_vocab: int | None = None, scale: bool = True, **svm) -> PipelineModel:
    """Linear SVM on n-gram counts."""
    stages = ngram_stages(ngrams_col, "ngram_vector", max_vocab) + feature_stages([], ["ngram_vector"], scale)
    return Pipeline(stages=stages + [linear_svm(train.count(), **svm)]).fit(train)


def train_random_forest(train: DataFrame, ngrams_col: str = "ngrams", max_vocab: int | None = None, **forest) -> PipelineModel:
    return Pipeline(stages=ngram_stages(ngrams_col, "x", max_vocab) + [random_forest(**forest)]).fit(train)


def train_style_svm(
    train: DataFrame, names: list[str], ngram_cols: list[str] | None = None, max_vocab: int | None = None, scale: bool = True, **svm
) -> PipelineModel:
    """Linear SVM on style features with any number of n-gram blocks (characters, tags)."""
    stages: list = []
    for column in ngram_cols or []:
        stages += ngram_stages(column, f"{column}_vector", max_vocab)
    stages += feature_stages(names, [f"{c}_vector" for c in ngram_cols or []], scale)
    return Pipeline(stages=stages + [linear_svm(train.count(), **svm)]).fit(train)


def predict(model: Transformer, df: DataFrame, keep: list[str]) -> DataFrame:
    """Label and signed decision score per row."""
    scored = model.transform(df)
    return scored.select(*keep, "prediction", vector_to_array("rawPrediction")[1].alias("score"))


def calibrate(scored_train: DataFrame, label_col: str = "y", score_col: str = "score", smooth: bool = True) -> PipelineModel:
    """Sigmoid fitted to the decision scores of the training rows.

    With ``smooth`` (Platt) the n1 rows of the target class stand for a probability of (n1 + 1) / (n1 + 2) and the n0
    others for 1 / (n0 + 2): every row counts as one row of each class with these weights.  Otherwise for 1 and 0.
    """
    rows = scored_train.select(F.col(label_col).cast("double").alias("_y"), F.col(score_col).cast("double").alias(score_col))
    if smooth:
        n = rows.agg(F.struct(F.sum("_y").alias("one"), F.sum(1 - F.col("_y")).alias("zero"))).scalar()
        target = F.when(F.col("_y") == 1, (n["one"] + 1) / (n["one"] + 2)).otherwise(1 / (n["zero"] + 2))
        shared = rows.select(score_col, target.alias("_t"))
        both = F.array(F.struct(F.lit(1.0).alias("y"), F.col("_t").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("_t")).alias("w")))
        rows = shared.select(score_col, F.explode(both).alias("_e")).select(score_col, F.col("_e.y").alias("_y"), F.col("_e.w").alias("_w"))
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    return Pipeline(stages=[
        VectorAssembler(inputCols=[score_col], outputCol="_score"),
        LogisticRegression(
            regParam=0.0, tol=1e-12, maxIter=200, featuresCol="_score", labelCol="_y", weightCol="_w",
            predictionCol="calibrated_label", rawPredictionCol="_calibrated_raw", probabilityCol="probability",
        ),
    ]).fit(rows)


def with_probability(calibrated: Transformer, scored: DataFrame) -> DataFrame:
    out = calibrated.transform(scored)
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("_score", "_calibrated_raw")


def grid_search(train: DataFrame, names: list[str], c_values=(0.01, 0.1, 1.0), max_iters=(100,), folds: int = 3, seed: int = C.SPLIT_SEED, parallelism: int = 4) -> CrossValidatorModel:
    """Cross-validated grid over C and the iteration limit, scored by F1 weighted by class size.

    The folds are cached, so they hold the features and the class and no text or n-grams.
    """
    train = train.select(*names, "y")
    n = train.count()
    svm = linear_svm(n)
    grid = (
        ParamGridBuilder()
        .addGrid(svm.regParam, [1.0 / (c * max(n, 1)) for c in c_values])
        .addGrid(svm.maxIter, list(max_iters))
        .build()
    )
    return CrossValidator(
        estimator=Pipeline(stages=feature_stages(names) + [svm]), estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="f1"),
        numFolds=folds, seed=seed, parallelism=parallelism,
    ).fit(train)


def grid_scores(model: CrossValidatorModel, spark) -> DataFrame:
    """(reg_param, max_iter, score), one row per grid point."""
    rows = []
    for params, score in zip(model.getEstimatorParamMaps(), model.avgMetrics):
        named = {p.name: v for p, v in params.items()}
        rows.append((float(named["regParam"]), int(named["maxIter"]), float(score)))
    return spark.createDataFrame(rows, "reg_param double, max_iter int, score double")


def fold_number(id_col: str, folds: int, seed: int = C.SPLIT_SEED):
    """A row's fold, from its id alone: 0 .. folds - 1."""
    return F.floor(position_share(id_col, f"{seed}:fold") * folds).cast("int")


def grid_folds(
    train: DataFrame, names: list[str], c_values=(0.01, 0.1, 1.0), max_iters=(100,), folds: int = 3, seed: int = C.SPLIT_SEED, id_col: str = "id",
    parallelism: int = 4,
) -> DataFrame:
    """(c, max_iter, fold, train, validation): F1 weighted by class size of every grid point on both sides of every fold.

    A fold's models score all rows in one pass, and one aggregation counts hits of all grid points and both sides.  The
    imputer and the scaler are fitted without the fold that is held out.  Every side needs rows of both classes.
    """
    rows = materialize(train.select(*names, "y", fold_number(id_col, folds, seed).alias("fold")), "folds")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    counted = None
    for fold in range(folds):
        part = rows.where(F.col("fold") != fold)
        prepared = Pipeline(stages=feature_stages(names)).fit(part)
        known = materialize(prepared.transform(part).select("x", "y"), "fold-train")
        scored, points = prepared.transform(rows).select("x", "y", "fold"), []
        n = sum(sizes.values()) - sizes.get(fold, 0)
        grid = [(c, m) for c in c_values for m in max_iters]
        with ThreadPoolExecutor(parallelism) as pool:
            models = list(pool.map(lambda p, n=n, known=known: linear_svm(n, *p).fit(known), grid))
        for k, ((c, max_iter), model) in enumerate(zip(grid, models, strict=True)):
            scored = model.setPredictionCol(f"_p{k}").setRawPredictionCol(f"_r{k}").transform(scored)
            points.append(F.struct(F.lit(float(c)).alias("c"), F.lit(max_iter).alias("max_iter"), F.col(f"_p{k}").alias("p")))
        hits = scored.select("y", (F.col("fold") == fold).alias("held_out"), F.lit(fold).alias("fold"), F.explode(F.array(*points)).alias("e"))
        counted = hits if counted is None else counted.unionByName(hits)
    count = lambda y, p: F.count_if((F.col("y") == y) & (F.col("e.p") == p)).alias(f"n{y}{p}")
    tables = counted.groupBy("e.c", "e.max_iter", "fold", "held_out").agg(*[count(y, p) for y in (0, 1) for p in (0, 1)])
    wrong = F.col("n01") + F.col("n10")
    f1 = [F.coalesce(F.try_divide(2 * F.col(hit), 2 * F.col(hit) + wrong), F.lit(0.0)) for hit in ("n00", "n11")]
    size = [F.col("n00") + F.col("n01"), F.col("n10") + F.col("n11")]
    score = F.try_divide(f1[0] * size[0] + f1[1] * size[1], size[0] + size[1])
    sides = tables.select("c", "max_iter", "fold", "held_out", score.alias("score")).groupBy("c", "max_iter", "fold")
    return sides.agg(F.max(F.when(~F.col("held_out"), F.col("score"))).alias("train"), F.max(F.when(F.col("held_out"), F.col("score"))).alias("validation"))


def score_unrelated(model: Transformer, df: DataFrame, positive: DataFrame | None = None, label_col: str = "label") -> DataFrame:
    """Score a corpus the model has never seen, with the vocabulary it was fitted with.

    ``positive`` adds rows of the target class so that both classes exist.
    """
    rows = df if positive is None else df.unionByName(positive)
    return predict(model, rows, [c for c in (label_col, "id") if c in rows.columns])


def feature_ablation(train: DataFrame, test: DataFrame, feature_sets: dict[str, list[str]], **svm) -> DataFrame:
    """The style SVM over named feature sets; report rows of each set, tagged with its name."""
    reports = None
    for name, features in feature_sets.items():
        scored = train_style_svm(train, features, **svm).transform(test)
        rows = classification_report(scored, "y", "prediction").withColumn("feature_set", F.lit(name))
        reports = rows if reports is None else reports.unionByName(rows)
    return reports


def feature_selection(train: DataFrame, features_col: str, label_col: str = "y", k: int = 10):
    """Keep the ``k`` features with the highest F value."""
    selector = UnivariateFeatureSelector(featuresCol=features_col, labelCol=label_col, outputCol="selected", selectionMode="numTopFeatures")
    selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return selector.fit(train)


def model_selection(train: DataFrame, features_col: str, label_col: str = "y", threshold: float | None = None, out: str = "selected", **svm) -> VectorSlicer:
    """Keep the features whose coefficient in a linear SVM is at least ``threshold`` in size (default: the mean size).

    The slicer holds the places, so training and test rows get the same layout.
    """
    model = linear_svm(train.count(), features_col=features_col, label_col=label_col, **svm).fit(train)
    sizes = [abs(float(w)) for w in model.coefficients.toArray()]
    limit = sum(sizes) / len(sizes) if threshold is None else threshold
    kept = [i for i, w in enumerate(sizes) if w >= limit]
    if not kept:
        raise ValueError(f"no coefficient reaches {limit}")
    return VectorSlicer(inputCol=features_col, outputCol=out, indices=kept)


def errors(predictions: DataFrame, label_col: str = "y") -> DataFrame:
    return misclassified(predictions, label_col, "prediction")


def run_metrics(predictions: DataFrame, run: str, n_features: int, scaled: bool, label_col: str = "y") -> DataFrame:
    """One log row of a run: size, number of features, scaling, macro averages."""
    report = classification_report(predictions, label_col, "prediction")
    return report.where("label = 'macro avg'").select(
        F.lit(run).alias("run"), F.col("support").alias("n_instances"), F.lit(n_features).alias("n_features"),
        F.lit(scaled).alias("scaled"), "precision", "recall", "f1",
    )


# Naive Bayes in closed form -----------------------------------------------------


def naive_bayes_log_probabilities(counts: DataFrame, label_col: str = "label", smoothing: float = 1.0) -> DataFrame:
    """(label, ngram, log_prob) of multinomial naive Bayes from a (label, ngram, n) table.

    Every n-gram of the vocabulary gets a row in every class, also where its
    count is 0, so the classes are taken as columns and then unpivoted.
    """
    per = counts.groupBy("ngram", label_col).agg(F.sum("n").alias("n"))
    totals = per.groupBy(label_col).agg(F.sum("n").alias("total"))
    size = per.agg(F.countDistinct("ngram")).scalar()
    classes = totals.agg(F.sort_array(F.collect_list(F.struct(F.col(label_col).alias("label"), "total")))).scalar()
    seen = per.groupBy("ngram").agg(F.map_from_entries(F.collect_list(F.struct(F.col(label_col), "n"))).alias("by_class"))
    grid = seen.select("ngram", "by_class", F.explode(classes).alias("c"))
    n = F.coalesce(F.try_element_at("by_class", F.col("c.label")), F.lit(0))
    return grid.select(
        F.col("c.label").alias("label"), "ngram", F.log((n + smoothing) / (F.col("c.total") + smoothing * size)).alias("log_prob")
    )
