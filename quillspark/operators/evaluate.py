"""Evaluation of predictions.  One count per (label, prediction) pair, then arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """(label, prediction, n): the only pass over the predictions."""
    return df.groupBy(
        F.col(label_col).cast("string").alias("label"), F.col(prediction_col).cast("string").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def _sides(pairs: DataFrame) -> DataFrame:
    """Per class: true positives, predicted rows, true rows.  Classes of either side appear."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    both = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("machine"), hit.alias("tp")),
        F.struct(
            F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("machine"),
            F.lit(0).cast("bigint").alias("tp"),
        ),
    )
    return pairs.select(F.explode(both).alias("x")).groupBy("x.class").agg(
        F.sum("x.tp").alias("tp"), F.sum("x.machine").alias("machine"), F.sum("x.gold").alias("gold")
    )


def confusion_counts(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """True positives, false positives and false negatives per gold class."""
    sides = _sides(pair_counts(df, label_col, prediction_col)).where("gold > 0")
    return sides.select(
        F.col("class").alias("label"),
        F.col("tp").alias("true_positives"),
        (F.col("machine") - F.col("tp")).alias("false_positives"),
        (F.col("gold") - F.col("tp")).alias("false_negatives"),
    )


def prf_rounded(counts: DataFrame) -> DataFrame:
    """Precision and recall at 2 decimals and F1 from those rounded values, again at 2 decimals."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    out = counts.select(
        "label",
        F.round(F.try_divide(tp, tp + fp), 2).alias("precision"),
        F.round(F.try_divide(tp, tp + fn), 2).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.round(F.try_divide(2 * p * r, p + r), 2))


def classification_report(
    df: DataFrame, label_col: str = "label", prediction_col: str = "prediction", swap: bool = False
) -> DataFrame:
    """Per class precision, recall, F1, support, then accuracy, macro and weighted averages.

    0/0 counts as 0.  ``swap=True`` exchanges gold and predicted labels.
    """
    if swap:
        label_col, prediction_col = prediction_col, label_col
    sides = _sides(pair_counts(df, label_col, prediction_col))

    def share(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    per_class = sides.select(
        F.col("class").alias("label"), "tp", "gold",
        share(F.col("tp"), F.col("machine")).alias("precision"),
        share(F.col("tp"), F.col("gold")).alias("recall"),
        share(2 * F.col("tp"), F.col("machine") + F.col("gold")).alias("f1"),
    )
    scores = ("precision", "recall", "f1")
    total = F.sum("gold")
    accuracy = share(F.sum("tp"), total)
    summary = per_class.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(s) for s in scores], total.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), *[F.avg(s).alias(s) for s in scores], total.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[share(F.sum(F.col(s) * F.col("gold")), total).alias(s) for s in scores],
                total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    rows = per_class.select("label", *scores, F.col("gold").alias("support")).unionByName(summary)
    return rows.select("label", *[F.round(s, 6).alias(s) for s in scores], "support")


def confusion_matrix(
    df: DataFrame, label_col: str = "label", prediction_col: str = "prediction", normalize: str | None = None
) -> DataFrame:
    """(label, prediction, value): counts, or shares by ``true`` class, ``pred`` class or ``all``."""
    pairs = pair_counts(df, label_col, prediction_col)
    if normalize is None:
        return pairs.withColumnRenamed("n", "value")
    if normalize == "all":
        return pairs.select("label", "prediction", F.round(F.col("n") / pairs.agg(F.sum("n")).scalar(), 6).alias("value"))
    key = {"true": "label", "pred": "prediction"}[normalize]
    sums = pairs.groupBy(key).agg(F.sum("n").alias("total"))
    return pairs.join(sums, key).select("label", "prediction", F.round(F.col("n") / F.col("total"), 6).alias("value"))


def confusion_table(df: DataFrame, classes: list[str], label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """Class by class table of counts, one column per predicted class."""
    pairs = pair_counts(df, label_col, prediction_col)
    return pairs.groupBy("label").pivot("prediction", classes).agg(F.sum("n")).fillna(0, subset=classes)


def attach_labels(
    predictions: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label"
) -> DataFrame:
    """Text, prediction and truth side by side, matched on the id."""
    return predictions.select(id_col, "prediction").join(texts.select(id_col, text_col, label_col), id_col)
