"""Registry and shared inputs of the queries.

The test corpus lacks links, hashtags, emojis, emoticons and a few marks, so
each post gets a tail of such marks that depends on its language, source and
id.  The SQL side builds the same text from the same strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import patterns as P
from quillspark.functions import text as X
from quillspark.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# fixed values: the tails, by language
TAILS = {
    "en": ' said "these are the best votes ever" ??? #News #news 😀 😀❤️ :) :-) XD soooo GOOD... two better 3.5 = well-known don\'t \'quoted bit\' snake_case went yesssss!!',
    "de": " sagt #Nachrichten 🇩🇪 👍🏽 :D <3 seine curl=URLs (= :-) heyyyy was 100 BESTE!!! walked",
    "fr": " dit #Nouvelles #vu ❤ ;-) :/ :/ people said 'oui oui' 12,5 ... quickly",
}


def tail(doc_id: Column, lang: Column, source: Column) -> Column:
    """Marks appended to a post."""
    marks = F.lit("")
    for language, text in TAILS.items():
        marks = F.when(lang == language, text).otherwise(marks)
    return F.concat(
        F.lit(" RT @"), source, F.lit(" https://ex.org/"), doc_id.cast("string"), F.lit("?l="), lang, marks
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the text as given."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("user"), F.col("lang").alias("language"), "text",
        F.col("n_chars").alias("favs"),
    )


def marked(raw: DataFrame) -> DataFrame:
    """Marks appended to the texts of raw posts."""
    return raw.withColumn("text", F.concat("text", tail(F.col("id"), F.col("language"), F.col("user"))))


def mask(df: DataFrame) -> DataFrame:
    """Mentions and links masked."""
    return df.withColumn("text", X.mask_urls(X.mask_mentions("text")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the marks appended."""
    return marked(raw_posts(spark, sf_dir))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked posts with mentions and links masked."""
    return mask(posts(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str, posts_df: DataFrame | None = None) -> DataFrame:
    """Labelled posts; target = quality 1."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "target").otherwise("background").alias("label")
    )
    return (posts_df if posts_df is not None else masked(spark, sf_dir)).join(labels, "id")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated posts made from the event table."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("language"),
        F.col("ts").alias("date"), F.col("value").alias("favs"),
    )


def r9(col) -> Column:
    return F.round(X.as_col(col).cast("double"), 9)


# --------------------------------------------------------------------- SQL pieces


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def re2(pattern: str) -> str:
    """Pattern as a literal for the SQL engine, which has no possessive groups."""
    return lit(pattern.replace(")*+", ")*"))


_MARKS = "CASE lang " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in TAILS.items()) + " ELSE '' END"
MARKED_SQL = f"text || ' RT @' || source || ' https://ex.org/' || doc_id::VARCHAR || '?l=' || lang || {_MARKS}"

RAW_CTE = 'raw_posts AS (SELECT doc_id AS id, source AS "user", lang AS language, text, n_chars AS favs FROM documents)'
POSTS_CTE = f'posts AS (SELECT doc_id AS id, source AS "user", lang AS language, {MARKED_SQL} AS text, n_chars AS favs FROM documents)'


def mask_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {re2(P.MENTION)}, '@USER', 'g'), {re2(P.URL)}, 'URL', 'g')"


MASKED_CTE = f'{POSTS_CTE}, masked AS (SELECT id, "user", language, {mask_sql("text")} AS text, favs FROM posts)'
LABELS_CTE = "labelled AS (SELECT m.*, CASE WHEN l.quality = 1 THEN 'target' ELSE 'background' END AS label FROM masked m JOIN labels l ON l.doc_id = m.id)"


def hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {re2(pattern)}))"


def unnest_cte(name: str, source: str, key: str, list_sql: str, value: str = "term") -> str:
    """CTE with one row per list entry, numbered from 1."""
    return (
        f"{name} AS (SELECT {key}, unnest(l) AS {value}, generate_subscripts(l, 1) AS pos "
        f"FROM (SELECT {key}, {list_sql} AS l FROM {source}))"
    )


SOCIAL_SQL = f"regexp_extract_all(text, {re2(P.SOCIAL_TOKEN)})"
NORM_SQL = f"regexp_extract_all(text, {re2(P.NORM_TOKEN)})"
STOP_SQL = sql_list(C.STOP_WORDS + C.PLATFORM_STOP_WORDS)
