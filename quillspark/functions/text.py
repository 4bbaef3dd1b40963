"""Text normalisation as column expressions.  Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import patterns as P


def as_col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def string_array(values) -> Column:
    """Array literal of strings (``array<string>`` also when empty)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def mask_mentions(text: Column | str) -> Column:
    """``@name`` becomes the mention placeholder."""
    return F.regexp_replace(as_col(text), P.MENTION, C.MENTION_PLACEHOLDER)


def mask_urls(text: Column | str) -> Column:
    """Web addresses become the link placeholder."""
    return F.regexp_replace(as_col(text), P.URL_GUARDED, C.URL_PLACEHOLDER)


def lowercase_mentions(text: Column | str) -> Column:
    """Placeholder to lower case, so that it adds nothing to the upper-case counts."""
    return F.replace(as_col(text), F.lit(C.MENTION_PLACEHOLDER), F.lit(C.MENTION_PLACEHOLDER.lower()))


def strip_emojis(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), P.EMOJI_GUARDED, "")


def strip_hashtags(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), P.HASHTAG, "")


def strip_retweet_marker(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), P.RETWEET, "")


def strip_url_placeholder(text: Column | str) -> Column:
    """Delete the link placeholder anywhere, inside words too."""
    return F.replace(as_col(text), F.lit(C.URL_PLACEHOLDER), F.lit(""))


def strip_emoticons(text: Column | str, emoticons=C.EMOTICONS) -> Column:
    """Delete every known emoticon, the longest match first."""
    return F.regexp_replace(as_col(text), P.guarded_alternation(emoticons), "")


def clean_text(text: Column | str, emoticons=C.EMOTICONS) -> Column:
    """Emojis, hashtags, retweet marker, link placeholder, emoticons: all deleted in that order."""
    out = strip_retweet_marker(strip_hashtags(strip_emojis(text)))
    return strip_emoticons(strip_url_placeholder(out), emoticons)


def deflood(text: Column | str) -> Column:
    """Cut runs of one character that are longer than three down to three."""
    return F.regexp_replace(as_col(text), P.FLOOD, "$1$1$1")


def query_from_handle(handle: Column | str) -> Column:
    """``@name`` to ``from:name``."""
    handle = as_col(handle)
    return F.concat(F.lit("from:"), F.substring(handle, F.lit(2), F.length(handle)))


def pseudonym(value: Column | str, salt: str) -> Column:
    """Salted SHA-256, equal in every run and on every executor."""
    return F.sha2(F.concat(F.lit(salt), as_col(value).cast("string")), 256)


def post_timestamp(text: Column | str) -> Column:
    """``Fri Dec 11 00:41:21 +0000 2020`` to a timestamp; NULL where it does not parse.

    The weekday is cut off: Spark's parser has no pattern letter for it.
    """
    text = as_col(text)
    return F.try_to_timestamp(F.substring(text, F.lit(5), F.length(text)), F.lit("MMM dd HH:mm:ss Z yyyy"))
