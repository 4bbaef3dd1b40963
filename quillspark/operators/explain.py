"""What a fitted model looks at.  Tables here are as long as the vocabulary, not the corpus."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import constants as C


def feature_importance(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """(feature, importance) ascending: coefficients of a linear model, importances of a forest."""
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    rows = list(zip(names, (float(v) for v in values.toArray())))
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.asc("importance"), F.asc("feature"))


def top_predictive(importance: DataFrame, k: int = C.TOP_FEATURES) -> DataFrame:
    """The ``k`` lowest and the ``k`` highest features."""
    low = importance.orderBy(F.asc("importance"), F.asc("feature")).limit(k).withColumn("side", F.lit("negative"))
    high = importance.orderBy(F.desc("importance"), F.asc("feature")).limit(k).withColumn("side", F.lit("positive"))
    return low.unionByName(high)


def linear_shap(train: DataFrame, rows: DataFrame, coefficients: dict[str, float], id_col: str = "id") -> DataFrame:
    """(id, feature, contribution) of a linear model: coefficient times distance from the training mean."""
    names = sorted(coefficients)
    means = train.agg(F.struct(*[F.avg(F.col(n).cast("double")).alias(n) for n in names])).scalar()
    parts = [
        (F.lit(float(coefficients[n])) * (F.col(n).cast("double") - F.col("_mean")[n])).alias(n) for n in names
    ]
    shap = rows.select(id_col, *names, means.alias("_mean")).select(id_col, *parts)
    return shap.unpivot([id_col], names, "feature", "contribution")


def shap_ranking(contributions: DataFrame) -> DataFrame:
    """Features by mean absolute contribution."""
    out = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return out.orderBy(F.desc("mean_abs"), F.asc("feature"))


def last_stage(model: PipelineModel):
    return model.stages[-1]
