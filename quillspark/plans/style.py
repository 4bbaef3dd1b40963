"""Which style features tell two classes apart, and how well a classifier does with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import style
from quillspark.functions import tokens as T
from quillspark.operators import classify, dedup, features, filters, splits
from quillspark.functions import text as X
from quillspark.session import materialize


def style_differences(
    posts: DataFrame, labels: DataFrame, target: str, background: str, language: str | None = "en", id_col: str = "id"
) -> DataFrame:
    """Class means of the character features of two labelled classes, largest difference first.

    Labelled posts of one language, one row per text, mentions and links masked.
    """
    kept = filters.language_filter(posts, language).select(id_col, "text").join(labels.select(id_col, "label"), id_col)
    unique = dedup.dedup_text(kept, "text", id_col)
    masked = unique.withColumn("text", X.lowercase_mentions(X.mask_urls(X.mask_mentions("text"))))
    table = masked.select("label", *[c.alias(n) for n, c in style.character_features("text").items()])
    names = features.feature_names(levels=("character_level",))
    return features.feature_differences(table, names, "label", target, background)


def style_training_table(posts: DataFrame, target: str, *, split: bool = True) -> DataFrame:
    """Feature table with class index, character and tag n-grams and the split, written once.

    Several estimators read it, so it is materialised instead of computed for each.
    """
    annotated = posts.withColumn("tokens", T.annotate("text"))
    table = features.extract_features(
        annotated, tokens_col="tokens", keep=("label", "text", "tokens")
    ).withColumn("pos_ngrams", style.pos_ngrams("tokens")).drop("tokens")
    table = classify.with_class_index(table.withColumn("char_ngrams", T.char_ngrams("text", 3)), target)
    if split:
        table = splits.stratified_split(materialize(table, "features"))
    return materialize(table, "training")


def train_and_score(table: DataFrame, names: list[str], ngram_cols: list[str] | None = None, **svm):
    """Style SVM on the training rows, calibrated there, scored on the test rows."""
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    model = classify.train_style_svm(train, names, ngram_cols, **svm)
    sigmoid = classify.calibrate(classify.predict(model, train, ["y"]))
    scored = classify.with_probability(sigmoid, classify.predict(model, test, ["id", "text", "label", "y"]))
    confidence = F.greatest(F.col("probability"), 1 - F.col("probability"))
    return model, scored.withColumn("confidence", confidence)
