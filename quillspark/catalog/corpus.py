"""Queries: deduplication, sampling, splits, statistics, ranked terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.catalog.base import (
    MASKED_CTE, POSTS_CTE, RAW_CTE, dated, masked, posts, query, raw_posts, table,
)
from quillspark.catalog.cleaning import CLASSIFY_CTE, TOPIC_CTE, topic_posts
from quillspark.functions import text as X
from quillspark.operators import dedup, sketches, splits, stats, terms
from quillspark.plans import preprocess
from quillspark.session import materialize

# -------------------------------------------------------------------- dedup, set ops


@query(
    "dedup_text",
    f"WITH {RAW_CTE} SELECT id, \"user\", language, text FROM raw_posts "
    "QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1",
)
def dedup_text(spark, sf):
    return dedup.dedup_text(raw_posts(spark, sf)).select("id", "user", "language", "text")


@query(
    "dedup_masked",
    f"WITH {MASKED_CTE} SELECT id, text FROM masked QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1",
)
def dedup_masked(spark, sf):
    return dedup.dedup_text(masked(spark, sf)).select("id", "text")


@query(
    "append_unseen",
    "WITH stored AS (SELECT doc_id AS id, 'stored' AS origin FROM labels), "
    "arrivals AS (SELECT doc_id AS id, 'documents' AS origin, 2 AS arrival FROM documents UNION ALL "
    "SELECT event_id, 'events', 1 FROM events), "
    "fresh AS (SELECT id, origin FROM arrivals WHERE id NOT IN (SELECT id FROM stored) "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1) "
    "SELECT id, origin FROM stored UNION ALL SELECT id, origin FROM fresh",
)
def append_unseen(spark, sf):
    stored = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("stored").alias("origin"))
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), F.lit(2).alias("arrival")
    )
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit("events").alias("origin"), F.lit(1).alias("arrival")
    )
    return dedup.append_unseen(stored, docs.unionByName(events), "id", "arrival")


@query(
    "union_corpora",
    "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL "
    "SELECT conv_id, text FROM conversations",
)
def union_corpora(spark, sf):
    return dedup.union_corpora(
        table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
        table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text"),
    )


# ----------------------------------------------------------------- sampling, splits

_POS = "md5(id::VARCHAR || ':18')"


@query(
    "downsample_balance",
    f"WITH {RAW_CTE}, a AS (SELECT id FROM raw_posts WHERE language = 'en'), b AS (SELECT id FROM raw_posts WHERE language <> 'en'), "
    "s AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb), "
    "p AS (SELECT na, nb, round(least(na, nb)::DOUBLE / greatest(na, nb), 3) AS p FROM s), "
    "f AS (SELECT na >= nb AS a_sampled, greatest(na, nb) AS n, CASE WHEN p < 0.5 THEN p ELSE 0.5 END AS share FROM p), "
    "larger AS (SELECT id FROM a WHERE (SELECT a_sampled FROM f) UNION ALL SELECT id FROM b WHERE NOT (SELECT a_sampled FROM f)), "
    "smaller AS (SELECT id FROM b WHERE (SELECT a_sampled FROM f) UNION ALL SELECT id FROM a WHERE NOT (SELECT a_sampled FROM f)), "
    f"ranked AS (SELECT id, row_number() OVER (ORDER BY {_POS}, id) AS rn FROM larger) "
    "SELECT id FROM ranked WHERE rn <= (SELECT round_even((share * n)::DOUBLE, 0) FROM f) UNION ALL SELECT id FROM smaller",
)
def downsample_balance(spark, sf):
    ids = raw_posts(spark, sf).select("id", "language")
    return splits.downsample_balance(ids.where("language = 'en'"), ids.where("language <> 'en'")).select("id")


@query("sample_n", f"SELECT doc_id AS id FROM documents ORDER BY md5(doc_id::VARCHAR || ':18'), doc_id LIMIT 100")
def sample_n(spark, sf):
    return splits.sample_n(raw_posts(spark, sf).select("id"), 100)


SPLIT_CTE = (
    "ids AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'target' ELSE 'background' END AS label FROM labels), "
    f"ranked AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_POS}, id) AS rn, "
    "count(*) OVER (PARTITION BY label) AS n FROM ids), "
    "sized AS (SELECT *, floor(round(n * 0.7::DOUBLE, 6))::BIGINT AS n_train FROM ranked), "
    "cut AS (SELECT *, n_train + floor(round((n - n_train) * 0.32::DOUBLE, 6))::BIGINT AS n_test FROM sized), "
    "split AS (SELECT id, label, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_test THEN 'test' ELSE 'validation' END AS split FROM cut)"
)


def split_table(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "target").otherwise("background").alias("label")
    )
    return splits.stratified_split(labels)


@query("stratified_split", f"WITH {SPLIT_CTE} SELECT id, label, split FROM split")
def stratified_split(spark, sf):
    return split_table(spark, sf)


@query(
    "stratified_split_fast",
    f"WITH s AS (SELECT doc_id AS id, ('0x' || substr(md5(doc_id::VARCHAR || ':18'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM labels) "
    "SELECT id, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.3::DOUBLE * 0.32::DOUBLE THEN 'test' ELSE 'validation' END AS split FROM s",
)
def stratified_split_fast(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return splits.stratified_split(labels, exact=False).select("id", "split")


@query(
    "split_report",
    f"WITH {SPLIT_CTE} SELECT split, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM split), 0)::INTEGER AS pct FROM split GROUP BY split",
)
def split_report(spark, sf):
    return splits.split_report(split_table(spark, sf))


# -------------------------------------------------------------------- corpus totals


def _totals_sql(ctes: str, source: str, n_tokens: str, n_kept: str, n_chars: str, tokens: str) -> str:
    return (
        f"WITH {ctes}, p AS (SELECT ({n_tokens})::BIGINT AS t, ({n_kept})::BIGINT AS k, ({n_chars})::BIGINT AS c FROM {source}), "
        f"d AS (SELECT count(DISTINCT token) AS d FROM (SELECT unnest({tokens}) AS token FROM {source})) "
        "SELECT count(*) AS n_posts, sum(t)::BIGINT AS total_tokens, sum(c)::BIGINT AS total_chars, "
        "round(avg(k), 3) AS mean_tokens, round(avg(c), 3) AS mean_chars, (SELECT d FROM d) AS distinct_tokens FROM p"
    )


_BLANKS = "string_split(text, ' ')"


@query("corpus_totals", _totals_sql(POSTS_CTE, "posts", f"len({_BLANKS})", f"len({_BLANKS})", "length(text)", _BLANKS))
def corpus_totals(spark, sf):
    return stats.corpus_totals(posts(spark, sf))


@query(
    "corpus_totals_norm",
    _totals_sql(
        f"{TOPIC_CTE}, both_forms AS (SELECT t.id, t.tokens, m.text FROM topic_posts t JOIN masked m ON m.id = t.id)",
        "both_forms", f"len({_BLANKS})", "len(tokens)", "length(array_to_string(tokens, ' '))", "tokens",
    ),
)
def corpus_totals_norm(spark, sf):
    return stats.corpus_totals_norm(topic_posts(spark, sf))


def classify_posts(spark, sf):
    return preprocess.preprocess_classify(masked(spark, sf))


def _clean_join():
    from quillspark.catalog.cleaning import clean_sql

    return (
        f"{CLASSIFY_CTE}, cleaned AS (SELECT c.*, {clean_sql('m.text')} AS text_clean FROM classified c JOIN masked m ON m.id = c.id)"
    )


@query(
    "corpus_totals_clean",
    _totals_sql(_clean_join(), "cleaned", "len(tokens_clean)", "len(tokens_clean)", "length(text_clean)", "tokens_clean"),
)
def corpus_totals_clean(spark, sf):
    return stats.corpus_totals_clean(classify_posts(spark, sf))


# -------------------------------------------------------- language, user, time numbers

#: One language is made missing, so that "unknown" occurs.
NULL_LANG = "SELECT doc_id AS id, source AS \"user\", nullif(lang, 'es') AS language, text, n_chars AS favs FROM documents"


def gappy(spark, sf):
    return raw_posts(spark, sf).withColumn("language", F.nullif("language", F.lit("es")))


@query("language_count", f"WITH p AS ({NULL_LANG}) SELECT count(DISTINCT language) AS n_languages FROM p")
def language_count(spark, sf):
    return stats.language_count(gappy(spark, sf))


@query(
    "top_languages",
    f"WITH p AS ({NULL_LANG}) SELECT coalesce(language, 'unknown') AS language, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
)
def top_languages(spark, sf):
    return stats.top_languages(gappy(spark, sf))


_DAYS = "SELECT event_id AS id, strftime(ts, '%d') AS language FROM events"


def _by_day(spark, sf):
    """Posts whose 'language' is a day of the month: many small groups around the threshold."""
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "dd").alias("language"))


_SHARES = (
    f"WITH p AS ({_DAYS}), c AS (SELECT language, count(*) AS frequency FROM p WHERE language IS NOT NULL GROUP BY 1), "
    "s AS (SELECT *, round(100.0::DOUBLE * frequency / (SELECT sum(frequency) FROM c), 2) AS pct FROM c) "
)


@query(
    "language_proportions",
    _SHARES + "SELECT CASE WHEN pct < 3.33 THEN 'other' ELSE language END AS language, sum(frequency)::BIGINT AS frequency, "
    "round(sum(pct), 2) AS pct FROM s GROUP BY 1",
)
def language_proportions(spark, sf):
    return stats.language_proportions(_by_day(spark, sf), 3.33)


@query("minor_languages", _SHARES + "SELECT language, frequency, pct FROM s WHERE pct < 3.33")
def minor_languages(spark, sf):
    return stats.minor_languages(_by_day(spark, sf), 3.33)


@query("top_liked_posts", "SELECT doc_id AS id, n_chars AS favs FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def top_liked_posts(spark, sf):
    return stats.top_liked_posts(raw_posts(spark, sf).select("id", "favs"))


@query("user_count", "SELECT count(DISTINCT source) AS n_users FROM documents")
def user_count(spark, sf):
    return stats.user_count(raw_posts(spark, sf))


@query("top_users", "SELECT user_id AS \"user\", count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_users(spark, sf):
    return stats.top_users(dated(spark, sf))


@query("posts_per_user", "SELECT source AS \"user\", count(text) AS n FROM documents GROUP BY 1")
def posts_per_user(spark, sf):
    return stats.posts_per_user(raw_posts(spark, sf))


@query("mean_posts_per_user", "SELECT round(avg(n), 3) AS mean_posts FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def mean_posts_per_user(spark, sf):
    return stats.mean_posts_per_user(dated(spark, sf), text_col="id")


@query(
    "languages_per_user",
    f"WITH p AS ({NULL_LANG}) SELECT round(avg(n), 3) AS mean_languages FROM "
    "(SELECT \"user\", count(DISTINCT coalesce(language, 'unknown')) AS n FROM p GROUP BY 1)",
)
def languages_per_user(spark, sf):
    return stats.languages_per_user(gappy(spark, sf))


@query(
    "users_per_language",
    f"WITH p AS ({NULL_LANG}) SELECT coalesce(language, 'unknown') AS language, count(DISTINCT \"user\") AS n_users FROM p GROUP BY 1",
)
def users_per_language(spark, sf):
    return stats.users_per_language(gappy(spark, sf))


@query(
    "mean_users_per_language",
    "SELECT round(avg(n), 3) AS mean_users FROM (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1)",
)
def mean_users_per_language(spark, sf):
    return stats.mean_users_per_language(dated(spark, sf))


@query(
    "longest_post_per_user",
    "SELECT source AS \"user\", doc_id AS id, length(text)::INTEGER AS n_chars FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1",
)
def longest_post_per_user(spark, sf):
    return stats.longest_post_per_user(raw_posts(spark, sf)).select("user", "id", F.length("text").alias("n_chars"))


@query("most_liked_users", "SELECT user_id AS \"user\", max(value) AS likes FROM events GROUP BY 1 ORDER BY likes DESC, 1 LIMIT 10")
def most_liked_users(spark, sf):
    return stats.most_liked_users(dated(spark, sf))


@query("least_liked_users", "SELECT user_id AS \"user\", min(value) AS likes FROM events GROUP BY 1 ORDER BY likes, 1 LIMIT 10")
def least_liked_users(spark, sf):
    return stats.least_liked_users(dated(spark, sf))


def _calendar_sql(ts: str, day: str, step: str) -> str:
    return (
        f"WITH e AS (SELECT {ts} AS ts FROM events), c AS (SELECT {day} AS day, count(*) AS n FROM e GROUP BY 1), "
        f"d AS (SELECT unnest(generate_series((SELECT min(day) FROM c)::TIMESTAMP, (SELECT max(day) FROM c)::TIMESTAMP, INTERVAL {step}))::DATE AS day) "
        "SELECT d.day, coalesce(c.n, 0) AS n FROM d LEFT JOIN c ON c.day = d.day"
    )


#: Every date moves by its own day of the month, so every other day is left without a post.
_SHIFTED = "ts + to_days(day(ts)::INTEGER)"


@query("posts_per_day", _calendar_sql(_SHIFTED, "ts::DATE", "1 DAY"))
def posts_per_day(spark, sf):
    shifted = F.col("date") + F.make_dt_interval(F.dayofmonth("date"))
    return stats.posts_per_day(dated(spark, sf).withColumn("date", shifted))


@query(
    "posts_per_week",
    _calendar_sql("ts", "(ts::DATE + ((8 - isodow(ts)) % 7)::INTEGER)::DATE", "7 DAY"),
)
def posts_per_week(spark, sf):
    return stats.posts_per_period(dated(spark, sf), "date", "week")


@query("parse_post_date", "SELECT event_id AS id, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def parse_post_date(spark, sf):
    events = table(spark, sf, "events")
    text = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    return events.select(F.col("event_id").alias("id"), F.unix_seconds(X.post_timestamp(text)).alias("seconds"))


# ---------------------------------------------------------------------- ranked terms


def _top_sql(ctes: str, source: str, tokens: str, k: int | None) -> str:
    limit = f" ORDER BY n DESC, term LIMIT {k}" if k else ""
    return f"WITH {ctes} SELECT term, count(*) AS n FROM (SELECT unnest({tokens}) AS term FROM {source}) GROUP BY term{limit}"


@query("top_keywords", _top_sql(TOPIC_CTE, "topic_posts", "tokens", 200))
def top_keywords(spark, sf):
    return terms.top_keywords(topic_posts(spark, sf))


@query("top_hashtags", _top_sql(TOPIC_CTE, "topic_posts", "hashtags", 200))
def top_hashtags(spark, sf):
    return terms.top_hashtags(topic_posts(spark, sf))


@query("emoji_counts", _top_sql(CLASSIFY_CTE, "classified", "emojis", None))
def emoji_counts(spark, sf):
    return terms.emoji_counts(classify_posts(spark, sf))


@query("emoticon_counts", _top_sql(CLASSIFY_CTE, "classified", "emoticons", None))
def emoticon_counts(spark, sf):
    return terms.emoticon_counts(classify_posts(spark, sf))


def _share_sql(kind: str) -> str:
    return (
        f"SELECT '{kind[:-1]}' AS kind, term, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct, 100.0::DOUBLE * n / sum(n) OVER () < 2 AS minor "
        f"FROM (SELECT term, count(*) AS n FROM (SELECT unnest({kind}) AS term FROM classified) GROUP BY term)"
    )


@query("emote_share", f"WITH {CLASSIFY_CTE} {_share_sql('emojis')} UNION ALL {_share_sql('emoticons')}")
def emote_share(spark, sf):
    classified = materialize(classify_posts(spark, sf).select("emotes"), "emotes")
    emojis = terms.emote_share(terms.emoji_counts(classified)).withColumn("kind", F.lit("emoji"))
    emoticons = terms.emote_share(terms.emoticon_counts(classified)).withColumn("kind", F.lit("emoticon"))
    return emojis.unionByName(emoticons)


@query(
    "wordcloud_weights",
    f"WITH {TOPIC_CTE}, c AS (SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM topic_posts) GROUP BY term) "
    "SELECT term, n, round(n::DOUBLE / (SELECT max(n) FROM c), 6) AS weight FROM c ORDER BY n DESC, term LIMIT 50",
)
def wordcloud_weights(spark, sf):
    return terms.wordcloud_weights(topic_posts(spark, sf), "tokens_norm")


@query(
    "users_by_sketch",
    "SELECT event_type AS language, count(*) AS n_posts, count(DISTINCT user_id) AS n_users, true AS within FROM events GROUP BY 1",
)
def users_by_sketch(spark, sf):
    """Users per language from daily sketches beside the exact number, and whether six standard errors hold."""
    rows = dated(spark, sf).withColumn("day", F.to_date("date"))
    daily = materialize(sketches.distinct_sketches(rows, ["day", "language"], "user"), "daily-users")
    found = sketches.estimated(sketches.unite_sketches(daily, ["language"]), "about")
    exact = stats.users_per_language(rows)
    near = F.abs(F.col("about") - F.col("n_users")) <= 6 * sketches.relative_error() * F.col("n_users")
    return found.join(exact, "language").select("language", F.col("n").alias("n_posts"), "n_users", near.alias("within"))
