"""Readers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quillspark.functions import text as X
from quillspark.functions import patterns as P
from quillspark.operators.dedup import dedup_text
from quillspark.operators.filters import language_filter

#: The post table.
POST_SCHEMA = ST.StructType([
    ST.StructField("id", ST.LongType()),
    ST.StructField("user", ST.StringType()),
    ST.StructField("language", ST.StringType()),
    ST.StructField("text", ST.StringType()),
    ST.StructField("date", ST.StringType()),
    ST.StructField("favs", ST.LongType()),
])


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """CSV files without a header; quoted texts may hold line breaks.

    A file with line breaks inside quotes cannot be split, so give many files
    of moderate size.
    """
    return (
        spark.read.schema(POST_SCHEMA)
        .option("multiLine", True).option("quote", '"').option("escape", '"')
        .csv(path)
    )


def prepare_posts(posts: DataFrame, language: str | None = "en") -> DataFrame:
    """Language filter, one row per text, then mentions and links masked."""
    kept = dedup_text(language_filter(posts, language))
    return kept.withColumn("text", X.mask_urls(X.mask_mentions("text")))


def read_accounts(spark: SparkSession, path: str, handle_column: int) -> DataFrame:
    """CSV with a header; the handle column is given by its position."""
    table = spark.read.option("header", True).csv(path)
    return table.select(F.col(f"`{table.columns[handle_column]}`").alias("handle"))


def parse_id_lines(lines: DataFrame, label: str, order: Column) -> DataFrame:
    """Lines ``id text`` to (id, text, label), cut at the first blank; the last line of an id by ``order`` wins."""
    parts = F.split(F.col("value"), " ", 2)
    rows = lines.select(parts[0].alias("id"), F.coalesce(F.get(parts, 1), F.lit("")).alias("text"), order.alias("_line"))
    return rows.groupBy("id").agg(F.max_by("text", "_line").alias("text")).withColumn("label", F.lit(label))


def read_id_lines(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Text files of ``id text`` lines, in the order of their names and of the lines inside.

    A file that is read in several blocks keeps its order through the block's offset.
    """
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return parse_id_lines(spark.read.text(path), label, order)


def fill_headers(names: list[str | None]) -> list[str]:
    """Forward-fill the empty names that merged header cells leave behind, and number repeats."""
    filled, last, seen = [], "", {}
    for name in names:
        last = name or last
        seen[last] = seen.get(last, 0) + 1
        filled.append(last if seen[last] == 1 else f"{last}#{seen[last]}")
    return filled


def read_lexicon(spark: SparkSession, path: str, header: list[str | None] | None = None) -> DataFrame:
    """Wide CSV (a category per column) to (category, term, is_prefix)."""
    from quillspark.operators.lexicon import lexicon_from_wide

    if header is None:
        wide = spark.read.option("header", True).csv(path)
    else:
        wide = spark.read.csv(path).toDF(*fill_headers(header))
    return lexicon_from_wide(wide).withColumn("category", F.regexp_replace("category", "#[0-9]+$", ""))


def parse_vectors(lines: DataFrame) -> DataFrame:
    """Lines ``word v1 v2 ...`` to (word, vector).

    A ``count size`` line, two whole numbers of which the second is the number
    of values of the longest line (above 1), is the header and is dropped.
    """
    parts = F.split(F.regexp_replace("value", f"{P.SPACE}+$", ""), " ")
    numbers = F.slice(parts, F.lit(2), F.size(parts) - 1)
    widest = lines.agg(F.max(F.size(parts) - 1)).scalar()
    header = (F.size(parts) == 2) & parts[0].rlike("^[0-9]+$") & (widest > 1) & (parts[1] == widest.cast("string"))
    rows = lines.where((F.size(parts) > 1) & ~header)
    return rows.select(parts[0].alias("word"), F.transform(numbers, lambda v: v.cast("float")).alias("vector"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(spark.read.text(path))


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
