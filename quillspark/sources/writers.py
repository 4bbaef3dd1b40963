"""Writers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST


def save_processed(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_ranked_terms(terms: DataFrame, path: str) -> None:
    """(term, n) as CSV, most frequent first within the output."""
    terms.select("term", "n").orderBy(F.desc("n"), F.asc("term")).write.mode("overwrite").option("header", True).csv(path)


def _flat(df: DataFrame) -> DataFrame:
    """Vectors and arrays as text, which CSV can hold."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "vectorudt":
            c = F.to_json(vector_to_array(c))
        elif isinstance(f.dataType, (ST.ArrayType, ST.StructType, ST.MapType)):
            c = F.to_json(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def write_predictions(predictions: DataFrame, path: str) -> None:
    _flat(predictions).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_errors(predictions: DataFrame, path: str, label_col: str = "label") -> None:
    """Misclassified rows, tab separated."""
    from quillspark.operators.filters import misclassified

    out = _flat(misclassified(predictions, label_col))
    out.write.mode("overwrite").option("header", True).option("sep", "\t").option("escape", '"').csv(path)


def write_feature_report(reports: dict[str, DataFrame], path: str) -> None:
    """One table per result below ``path``."""
    for name, report in reports.items():
        report.write.mode("overwrite").parquet(f"{path}/{name}")


def append_run_log(row: DataFrame, path: str) -> None:
    """Append one row of run metrics to the log table."""
    row.write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
