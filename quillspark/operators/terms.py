"""Ranked term lists: words, hashtags, emojis, emoticons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.rows import explode_rows
from quillspark.functions import constants as C


def term_counts(df: DataFrame, tokens: Column | str) -> DataFrame:
    """(term, n) over all posts.  Counted within each input partition before the shuffle."""
    return explode_rows(df, [], tokens, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(df: DataFrame, tokens: Column | str, k: int = C.TOP_TERMS) -> DataFrame:
    return term_counts(df, tokens).orderBy(F.desc("n"), F.asc("term")).limit(k)


def top_keywords(df: DataFrame, tokens_col: str = "tokens_norm", k: int = C.TOP_TERMS) -> DataFrame:
    return top_terms(df, tokens_col, k)


def top_hashtags(df: DataFrame, hashtags_col: str = "hashtags", k: int = C.TOP_TERMS) -> DataFrame:
    return top_terms(df, hashtags_col, k)


def emoji_counts(df: DataFrame, emotes_col: str = "emotes") -> DataFrame:
    """Every emoji with its count, most frequent first."""
    return term_counts(df, f"{emotes_col}.emojis").orderBy(F.desc("n"), F.asc("term"))


def emoticon_counts(df: DataFrame, emotes_col: str = "emotes") -> DataFrame:
    return term_counts(df, f"{emotes_col}.emoticons").orderBy(F.desc("n"), F.asc("term"))


def emote_share(counts: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Percentage of each emote in its own kind, and whether it is below ``threshold``."""
    everything = counts.agg(F.sum("n")).scalar()
    pct = 100.0 * F.col("n") / everything
    return counts.withColumn("pct", F.round(pct, 6)).withColumn("minor", pct < threshold)


def wordcloud_weights(df: DataFrame, tokens: Column | str, k: int = C.WORDCLOUD_TERMS) -> DataFrame:
    """The top ``k`` terms with their frequency relative to the most frequent one."""
    most = F.max("n").over(Window.partitionBy())  # over the k rows of the top
    return top_terms(df, tokens, k).withColumn("weight", F.round(F.col("n") / most, 6))
