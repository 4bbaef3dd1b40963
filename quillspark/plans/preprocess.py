"""The two preprocessing modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import text as X
from quillspark.functions import tokens as T


def _keep_long(df: DataFrame, carried: list[str], made: dict[str, Column], tokens: str, min_tokens: int) -> DataFrame:
    """Add the ``made`` columns and drop rows with too few ``tokens``.

    A plain filter on a token list would be pushed below the projection, and
    every post would be tokenised once to decide and once more to keep.  Here
    the row is made once and dropped by opening an empty array.
    """
    if min_tokens <= 0:
        return df.select(*carried, *[c.alias(n) for n, c in made.items()])
    row = F.array(F.struct(*[c.alias(n) for n, c in made.items()]))
    opened = df.select(*carried, F.inline_outer(F.filter(row, lambda r: F.size(r[tokens]) >= min_tokens)))
    return opened.where(F.col(tokens).isNotNull())


def preprocess_classify(df: DataFrame, text_col: str = "text", min_tokens: int = C.MIN_TOKENS) -> DataFrame:
    """Light mode: add ``text_clean``, ``tokens_clean``, ``hashtags``, ``emotes``; short posts drop."""
    made = {
        "text_clean": X.clean_text(text_col),
        "tokens_clean": T.clean_tokens("_tokens"),
        "hashtags": T.hashtags_of("_tokens"),
        "emotes": T.extract_emotes("_tokens"),
    }
    tokens = df.withColumn("_tokens", T.social_tokenize(text_col))
    return _keep_long(tokens, df.columns, made, "tokens_clean", min_tokens)


def preprocess_topic(
    df: DataFrame,
    text_col: str = "text",
    stop_words=C.STOP_WORDS + C.PLATFORM_STOP_WORDS,
    lemmas=C.LEMMAS,
    min_tokens: int = C.MIN_TOKENS,
) -> DataFrame:
    """Aggressive mode: add ``text_norm``, ``tokens_norm``, ``hashtags``; short posts drop."""
    tokens = df.withColumn("_tokens", T.word_tokenize_norm(X.deflood(text_col)))
    content = T.keep_content_tokens(T.remove_punct_tokens(T.remove_stopwords("_tokens", stop_words)))
    made = {"tokens_norm": T.lemmatize(content, lemmas), "hashtags": T.hashtags_of("_tokens")}
    out = _keep_long(tokens, df.columns, made, "tokens_norm", min_tokens)
    return out.withColumn("text_norm", F.array_join("tokens_norm", " "))
