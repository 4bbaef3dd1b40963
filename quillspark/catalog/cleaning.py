"""Queries: filters and text normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.catalog.base import (
    MASKED_CTE, NORM_SQL, POSTS_CTE, RAW_CTE, SOCIAL_SQL, STOP_SQL, hits, lit, masked, posts, query,
    raw_posts, re2, sql_list, table, unnest_cte,
)
from quillspark.functions import constants as C
from quillspark.functions import patterns as P
from quillspark.functions import text as X
from quillspark.functions import tokens as T
from quillspark.operators import blocks, filters
from quillspark.plans import preprocess
from quillspark.session import materialize


def joined(tokens):
    return F.array_join(tokens, " ")


# ------------------------------------------------------------- filters, projections


@query("language_filter", f"WITH {RAW_CTE} SELECT id, text FROM raw_posts WHERE language = 'en'")
def language_filter(spark, sf):
    return filters.language_filter(raw_posts(spark, sf), "en").select("id", "text")


@query(
    "drop_short_docs",
    f"WITH {RAW_CTE} SELECT id, len({NORM_SQL})::INTEGER AS n_tokens FROM raw_posts WHERE len({NORM_SQL}) >= 2",
)
def drop_short_docs(spark, sf):
    tokens = raw_posts(spark, sf).select("id", T.word_tokenize_norm("text").alias("tokens"))
    return filters.drop_short_docs(tokens).select("id", F.size("tokens").alias("n_tokens"))


@query(
    "label_corpus",
    f"WITH {RAW_CTE} SELECT id, 'target' AS label FROM raw_posts WHERE language = 'en' UNION ALL "
    "SELECT item_id AS id, 'background' AS label FROM benchmark",
)
def label_corpus(spark, sf):
    target = filters.label_corpus(filters.language_filter(raw_posts(spark, sf), "en"), "target")
    other = filters.label_corpus(table(spark, sf, "benchmark").withColumnRenamed("item_id", "id"), "background")
    return target.select("id", "label").unionByName(other.select("id", "label"))


@query("pseudonymise_user", "SELECT doc_id AS id, sha256('pepper' || source) AS \"user\" FROM documents")
def pseudonymise_user(spark, sf):
    return filters.pseudonymise_user(raw_posts(spark, sf), "pepper").select("id", "user")


@query("handle_to_query", "SELECT 'from:' || substr('@' || source, 2) AS query FROM documents")
def handle_to_query(spark, sf):
    handles = raw_posts(spark, sf).select(F.concat(F.lit("@"), "user").alias("handle"))
    return filters.handle_to_query(handles, "handle")


@query(
    "pattern_search",
    f"WITH {POSTS_CTE}, h AS (SELECT {hits('text', '[Nn]ews|der')} AS n FROM posts) "
    "SELECT count(*) FILTER (n > 0) AS n_posts, sum(n)::BIGINT AS n_hits, "
    "round(100.0::DOUBLE * count(*) FILTER (n > 0) / count(*), 6) AS pct_posts FROM h",
)
def pattern_search(spark, sf):
    return filters.pattern_search(posts(spark, sf), "[Nn]ews|der")


# -------------------------------------------------------------------- normalisation

_G = "'g'"
_STEPS = {
    "mask_mentions": (X.mask_mentions, f"regexp_replace(text, {re2(P.MENTION)}, '@USER', {_G})"),
    "mask_urls": (X.mask_urls, f"regexp_replace(text, {re2(P.URL)}, 'URL', {_G})"),
    "strip_emojis": (X.strip_emojis, f"regexp_replace(text, {re2(P.EMOJI)}, '', {_G})"),
    "strip_hashtags": (X.strip_hashtags, f"regexp_replace(text, {re2(P.HASHTAG)}, '', {_G})"),
    "strip_retweet_marker": (X.strip_retweet_marker, f"regexp_replace(text, {re2(P.RETWEET)}, '', {_G})"),
    "strip_emoticons": (X.strip_emoticons, f"regexp_replace(text, {re2(P.EMOTICON)}, '', {_G})"),
}


def _register_step(name, fn, sql):
    @query(name, f"WITH {POSTS_CTE} SELECT id, {sql} AS text FROM posts")
    def run(spark, sf):
        return posts(spark, sf).select("id", fn("text").alias("text"))


for _name, (_fn, _sql) in _STEPS.items():
    _register_step(_name, _fn, _sql)


@query("lowercase_mentions", f"WITH {MASKED_CTE} SELECT id, replace(text, '@USER', '@user') AS text FROM masked")
def lowercase_mentions(spark, sf):
    return masked(spark, sf).select("id", X.lowercase_mentions("text").alias("text"))


@query("strip_url_placeholder", f"WITH {MASKED_CTE} SELECT id, replace(text, 'URL', '') AS text FROM masked")
def strip_url_placeholder(spark, sf):
    return masked(spark, sf).select("id", X.strip_url_placeholder("text").alias("text"))


def clean_sql(text: str) -> str:
    out = text
    for pattern in (P.EMOJI, P.HASHTAG, P.RETWEET):
        out = f"regexp_replace({out}, {re2(pattern)}, '', 'g')"
    return f"regexp_replace(replace({out}, 'URL', ''), {re2(P.EMOTICON)}, '', 'g')"


@query("clean_text", f"WITH {MASKED_CTE} SELECT id, {clean_sql('text')} AS text_clean FROM masked")
def clean_text(spark, sf):
    return masked(spark, sf).select("id", X.clean_text("text").alias("text_clean"))


def deflood_cte(source: str) -> str:
    """Long form of the flood cut: a character goes when the three before it equal it."""
    chars = unnest_cte("chars", source, "id", "regexp_extract_all(text, '(?s).')", "c")
    return (
        f"{chars}, kept AS (SELECT id, pos, c, c <> chr(10) AND c = lag(c, 1) OVER w AND c = lag(c, 2) OVER w "
        "AND c = lag(c, 3) OVER w AS flood FROM chars WINDOW w AS (PARTITION BY id ORDER BY pos)), "
        "deflooded AS (SELECT id, string_agg(c, '' ORDER BY pos) AS text FROM kept WHERE flood IS NOT TRUE GROUP BY id)"
    )


@query("deflood", f"WITH {POSTS_CTE}, {deflood_cte('posts')} SELECT id, text FROM deflooded")
def deflood(spark, sf):
    return posts(spark, sf).select("id", X.deflood("text").alias("text"))


@query("social_tokenize", f"WITH {POSTS_CTE} SELECT id, array_to_string({SOCIAL_SQL}, ' ') AS tokens FROM posts")
def social_tokenize(spark, sf):
    return posts(spark, sf).select("id", joined(T.social_tokenize("text")).alias("tokens"))


@query("word_tokenize_norm", f"WITH {POSTS_CTE} SELECT id, array_to_string({NORM_SQL}, ' ') AS tokens FROM posts")
def word_tokenize_norm(spark, sf):
    return posts(spark, sf).select("id", joined(T.word_tokenize_norm("text")).alias("tokens"))


def list_query(ctes: str, source: str, where: str, value: str, out: str, keys: str) -> str:
    """Tokens of each post that pass a filter, joined by blanks; posts without any give ''."""
    return (
        f"WITH {ctes} SELECT k.id, coalesce(s.v, '') AS {out} FROM (SELECT id FROM {keys}) k LEFT JOIN "
        f"(SELECT id, string_agg({value}, ' ' ORDER BY pos) AS v FROM {source} WHERE {where} GROUP BY id) s ON s.id = k.id"
    )


SOCIAL_CTE = f"{MASKED_CTE}, {unnest_cte('toks', 'masked', 'id', SOCIAL_SQL, 't')}"
NORM_CTE = f"{MASKED_CTE}, {unnest_cte('toks', 'masked', 'id', NORM_SQL, 't')}"
IS_EMOJI = f"regexp_matches(t, {re2('^' + P.EMOJI)})"
IS_EMOTICON = f"t IN {sql_list(C.EMOTICONS)}"
CLEAN_WHERE = f"t NOT IN {sql_list(C.MARKER_TOKENS)} AND NOT {IS_EMOJI} AND NOT {IS_EMOTICON} AND NOT starts_with(t, '#')"
NOT_PUNCT = f"NOT contains({lit(C.ASCII_PUNCTUATION)}, lower(t))"
CONTENT_WHERE = f"regexp_matches(t, {re2(P.WORD_START)}) AND length(t) > 1 AND NOT starts_with(t, '#')"
LEMMA_SQL = "CASE lower(t) " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in C.LEMMAS) + " ELSE lower(t) END"


def social(spark, sf):
    return masked(spark, sf).select("id", T.social_tokenize("text").alias("tokens"))


def norm(spark, sf):
    return masked(spark, sf).select("id", T.word_tokenize_norm("text").alias("tokens"))


@query("extract_hashtags", list_query(SOCIAL_CTE, "toks", "starts_with(t, '#')", "lower(t)", "hashtags", "masked"))
def extract_hashtags(spark, sf):
    return social(spark, sf).select("id", joined(T.hashtags_of("tokens")).alias("hashtags"))


@query(
    "extract_emotes",
    f"WITH {SOCIAL_CTE}, e AS (SELECT id, string_agg(t, ' ' ORDER BY pos) FILTER ({IS_EMOJI}) AS a, "
    f"string_agg(t, ' ' ORDER BY pos) FILTER ({IS_EMOTICON}) AS b FROM toks GROUP BY id) "
    "SELECT m.id, coalesce(a, '') AS emojis, coalesce(b, '') AS emoticons FROM masked m LEFT JOIN e ON e.id = m.id",
)
def extract_emotes(spark, sf):
    both = social(spark, sf).select("id", T.extract_emotes("tokens").alias("e"))
    return both.select("id", joined("e.emojis").alias("emojis"), joined("e.emoticons").alias("emoticons"))


@query("clean_tokens", list_query(SOCIAL_CTE, "toks", CLEAN_WHERE, "t", "tokens_clean", "masked"))
def clean_tokens(spark, sf):
    return social(spark, sf).select("id", joined(T.clean_tokens("tokens")).alias("tokens_clean"))


@query("remove_stopwords", list_query(NORM_CTE, "toks", f"lower(t) NOT IN {STOP_SQL}", "t", "tokens", "masked"))
def remove_stopwords(spark, sf):
    return norm(spark, sf).select("id", joined(T.remove_stopwords("tokens")).alias("tokens"))


@query("remove_punct_tokens", list_query(NORM_CTE, "toks", NOT_PUNCT, "t", "tokens", "masked"))
def remove_punct_tokens(spark, sf):
    return norm(spark, sf).select("id", joined(T.remove_punct_tokens("tokens")).alias("tokens"))


@query("lemmatize", list_query(NORM_CTE, "toks", "TRUE", LEMMA_SQL, "lemmas", "masked"))
def lemmatize(spark, sf):
    return norm(spark, sf).select("id", joined(T.lemmatize("tokens")).alias("lemmas"))


_LEMMA_TABLE = (
    "words AS (SELECT DISTINCT lower(t) AS w FROM toks), "
    "known AS (SELECT p.w AS term, s.w AS lemma FROM words p JOIN words s ON p.w = s.w || 's' WHERE length(s.w) > 2)"
)


@query(
    "lemmatize_by_table",
    f"WITH {NORM_CTE}, {_LEMMA_TABLE}, l AS (SELECT id, string_agg(coalesce(lemma, lower(t)), ' ' ORDER BY pos) AS lemmas FROM toks LEFT JOIN known ON term = lower(t) GROUP BY id) "
    "SELECT m.id, coalesce(lemmas, '') AS lemmas FROM masked m LEFT JOIN l ON l.id = m.id",
)
def lemmatize_by_table(spark, sf):
    """Plurals of the corpus, found in the corpus itself: a word in s whose singular occurs too."""
    tokens = norm(spark, sf).select("id", F.transform("tokens", F.lower).alias("tokens"))
    posts = blocks.term_blocks(tokens, "tokens", ["id"])
    words = materialize(blocks.term_totals(posts).select("term"), "words")
    singular = words.where("length(term) > 2").select(F.col("term").alias("lemma"), F.concat("term", F.lit("s")).alias("term"))
    lemmas = materialize(words.join(singular, "term"), "lemmas")
    return blocks.replace_terms(posts, lemmas, "lemma").select("id", joined("terms").alias("lemmas"))


@query("keep_content_tokens", list_query(NORM_CTE, "toks", CONTENT_WHERE, "t", "tokens", "masked"))
def keep_content_tokens(spark, sf):
    return norm(spark, sf).select("id", joined(T.keep_content_tokens("tokens")).alias("tokens"))


CLASSIFY_CTE = (
    f"{SOCIAL_CTE}, classified AS (SELECT id, "
    f"list(t ORDER BY pos) FILTER ({CLEAN_WHERE}) AS tokens_clean, "
    "coalesce(list(lower(t) ORDER BY pos) FILTER (starts_with(t, '#')), []) AS hashtags, "
    f"coalesce(list(t ORDER BY pos) FILTER ({IS_EMOJI}), []) AS emojis, "
    f"coalesce(list(t ORDER BY pos) FILTER ({IS_EMOTICON}), []) AS emoticons "
    f"FROM toks GROUP BY id HAVING count(*) FILTER ({CLEAN_WHERE}) >= 2)"
)


@query(
    "preprocess_classify",
    f"WITH {CLASSIFY_CTE} SELECT m.id, {clean_sql('text')} AS text_clean, array_to_string(tokens_clean, ' ') AS tokens_clean, "
    "array_to_string(hashtags, ' ') AS hashtags, array_to_string(emojis, ' ') AS emojis, "
    "array_to_string(emoticons, ' ') AS emoticons FROM classified c JOIN masked m ON m.id = c.id",
)
def preprocess_classify(spark, sf):
    out = preprocess.preprocess_classify(masked(spark, sf))
    return out.select(
        "id", "text_clean", joined("tokens_clean").alias("tokens_clean"), joined("hashtags").alias("hashtags"),
        joined("emotes.emojis").alias("emojis"), joined("emotes.emoticons").alias("emoticons"),
    )


TOPIC_CTE = (
    f"{MASKED_CTE}, {deflood_cte('masked')}, {unnest_cte('toks', 'deflooded', 'id', NORM_SQL, 't')}, "
    f"topical AS (SELECT id, list({LEMMA_SQL} ORDER BY pos) FILTER (lower(t) NOT IN {STOP_SQL} AND {NOT_PUNCT} AND {CONTENT_WHERE}) AS tokens, "
    "coalesce(list(lower(t) ORDER BY pos) FILTER (starts_with(t, '#')), []) AS hashtags FROM toks GROUP BY id), "
    "topic_posts AS (SELECT * FROM topical WHERE len(tokens) >= 2)"
)


def topic_posts(spark, sf):
    """Posts in topic mode."""
    return preprocess.preprocess_topic(masked(spark, sf))


@query(
    "preprocess_topic",
    f"WITH {TOPIC_CTE} SELECT id, array_to_string(tokens, ' ') AS text_norm, array_to_string(hashtags, ' ') AS hashtags, "
    "len(tokens)::INTEGER AS n_tokens FROM topic_posts",
)
def preprocess_topic(spark, sf):
    out = topic_posts(spark, sf)
    return out.select("id", "text_norm", joined("hashtags").alias("hashtags"), F.size("tokens_norm").alias("n_tokens"))
