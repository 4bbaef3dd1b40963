"""Row filters and simple projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quillspark.functions import constants as C
from quillspark.functions import style, text


def language_filter(df: DataFrame, language: str | None = "en", language_col: str = "language") -> DataFrame:
    """Posts in one language; rows without a language drop.  ``None`` keeps all rows."""
    return df if language is None else df.where(F.col(language_col) == language)


def drop_short_docs(df: DataFrame, tokens_col: str = "tokens", min_tokens: int = C.MIN_TOKENS) -> DataFrame:
    """Drop rows with fewer than ``min_tokens`` tokens."""
    return df.where(F.size(tokens_col) >= min_tokens)


def label_corpus(df: DataFrame, label: str, label_col: str = "label") -> DataFrame:
    return df.withColumn(label_col, F.lit(label))


def select_features(df: DataFrame, names: list[str], id_col: str = "id") -> DataFrame:
    """The chosen features; the tag n-grams are no column of the feature table."""
    return df.select(id_col, *[n for n in names if n != "pos_ngrams"])


def split_features_by_kind(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, kind): whole-number columns with a value above 1 are ``absolute``, other
    whole-number columns ``binary``, fractional columns ``frequency``."""
    whole = (ST.IntegerType, ST.LongType, ST.ShortType, ST.ByteType)
    is_whole = {n: isinstance(df.schema[n].dataType, whole) for n in names}
    kinds = [
        F.when(F.max(n) > 1, "absolute").otherwise("binary").alias(n) if is_whole[n]
        else F.first(F.lit("frequency")).alias(n)
        for n in names
    ]
    return df.agg(*kinds).unpivot([], names, "feature", "kind")


def pseudonymise_user(df: DataFrame, salt: str, user_col: str = "user") -> DataFrame:
    return df.withColumn(user_col, text.pseudonym(user_col, salt))


def handle_to_query(df: DataFrame, handle_col: str) -> DataFrame:
    return df.select(text.query_from_handle(handle_col).alias("query"))


def pattern_search(df: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """One row: posts with the pattern, all of its matches, percentage of posts with it."""
    found = F.col(text_col).rlike(pattern)
    return df.agg(
        F.count_if(found).alias("n_posts"),
        F.coalesce(F.sum(style.pattern_hits(text_col, pattern)), F.lit(0)).alias("n_hits"),
        F.round(F.try_divide(100.0 * F.count_if(found), F.count(F.lit(1))), 6).alias("pct_posts"),
    )


def misclassified(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    return df.where(F.col(label_col) != F.col(prediction_col))
