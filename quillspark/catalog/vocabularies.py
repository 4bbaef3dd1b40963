"""Queries: n-grams, vocabularies, lexicons."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillspark.catalog.base import (
    MASKED_CTE, lit, masked, query, r9, raw_posts, re2, sql_list, table, unnest_cte,
)
from quillspark.catalog.corpus import SPLIT_CTE, split_table
from quillspark.catalog.styles import ANN_CTE, CHAR_SQL
from quillspark.functions import constants as C
from quillspark.functions import patterns as P
from quillspark.functions import text as X
from quillspark.functions import tokens as T
from quillspark.functions.rows import explode_rows
from quillspark.operators import blocks, features, lexicon, ngrams, stats
from quillspark.session import materialize

# -------------------------------------------------------------------------- n-grams


def char_ngram_ctes(source: str) -> str:
    collapsed = f"regexp_replace(text, {re2(P.SPACE + '{2,}')}, ' ', 'g')"
    chars = unnest_cte("chars", source, "id", f"regexp_extract_all({collapsed}, '(?s).')", "c")
    return (
        f"{chars}, grams AS (SELECT id, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS ngram FROM chars "
        "WINDOW w AS (PARTITION BY id ORDER BY pos)), ngram_rows AS (SELECT id, ngram, count(*) AS n FROM grams WHERE ngram IS NOT NULL GROUP BY ALL)"
    )


def _per_post_sql(ctes: str) -> str:
    return (
        f"WITH {ctes} SELECT id, count(*) AS n_types, sum(n)::BIGINT AS n_total, max(n) AS n_max, min(ngram) AS first_ngram, "
        "max(ngram) AS last_ngram FROM ngram_rows GROUP BY id"
    )


def _per_post(counts):
    """One row per post about its n-gram counts."""
    return counts.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_types"), F.sum("n").alias("n_total"), F.max("n").alias("n_max"),
        F.min("ngram").alias("first_ngram"), F.max("ngram").alias("last_ngram"),
    )


@query("char_ngrams", _per_post_sql(f"{MASKED_CTE}, {char_ngram_ctes('masked')}"))
def char_ngrams(spark, sf):
    return _per_post(ngrams.ngram_counts(ngrams.with_char_ngrams(masked(spark, sf), 3)))


_WORD_ROWS = f"ngram_rows AS (SELECT id, ngram, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, {re2(P.LONG_WORD)})) AS ngram FROM masked) GROUP BY ALL)"


@query("word_ngrams", _per_post_sql(f"{MASKED_CTE}, {_WORD_ROWS}"))
def word_ngrams(spark, sf):
    return _per_post(ngrams.ngram_counts(ngrams.with_word_ngrams(masked(spark, sf), 1)))


_POS_ROWS = (
    f"{ANN_CTE}, tagseq AS (SELECT id, lower(pos_tag) AS p, row_number() OVER (PARTITION BY id ORDER BY sid, j) AS k FROM ann WHERE is_alnum AND length(pos_tag) > 1), "
    "runs AS (SELECT id, p AS a, p || ' ' || lead(p, 1) OVER w AS b, p || ' ' || lead(p, 1) OVER w || ' ' || lead(p, 2) OVER w AS c FROM tagseq WINDOW w AS (PARTITION BY id ORDER BY k)), "
    "ngram_rows AS (SELECT id, ngram, count(*) AS n FROM (SELECT id, unnest([a, b, c]) AS ngram FROM runs) WHERE ngram IS NOT NULL GROUP BY ALL)"
)


def with_pos_ngrams(spark, sf):
    return features.with_pos_ngrams(masked(spark, sf).withColumn("text", X.lowercase_mentions("text")))


@query("pos_ngrams", _per_post_sql(_POS_ROWS))
def pos_ngrams(spark, sf):
    return _per_post(ngrams.ngram_counts(with_pos_ngrams(spark, sf)))


@query("pos_ngram_frequencies", f"WITH {_POS_ROWS} SELECT ngram, sum(n)::BIGINT AS n FROM ngram_rows GROUP BY ngram")
def pos_ngram_frequencies(spark, sf):
    return ngrams.ngram_totals(with_pos_ngrams(spark, sf))


@query("ngram_totals", f"WITH {MASKED_CTE}, {char_ngram_ctes('masked')} SELECT ngram, sum(n)::BIGINT AS n FROM ngram_rows GROUP BY ngram")
def ngram_totals(spark, sf):
    return ngrams.ngram_totals(ngrams.with_char_ngrams(masked(spark, sf), 3))


_SPLIT_WORDS = (
    f"{MASKED_CTE}, {SPLIT_CTE}, s AS (SELECT m.id, m.text, s.label, s.split FROM masked m JOIN split s ON s.id = m.id), "
    f"w AS (SELECT id, label, split, unnest(regexp_extract_all(text, {re2(P.LONG_WORD)})) AS ngram FROM s), "
    "vocab AS (SELECT ngram, count(*) AS total FROM w WHERE split = 'train' GROUP BY 1)"
)


def split_posts(spark, sf):
    """Labelled posts with their split and word unigrams."""
    with_split = masked(spark, sf).join(split_table(spark, sf), "id")
    return ngrams.with_word_ngrams(with_split, 1)


@query("fit_vocabulary", f"WITH {_SPLIT_WORDS} SELECT ngram, total FROM vocab")
def fit_vocabulary(spark, sf):
    return ngrams.fit_vocabulary(split_posts(spark, sf).where("split = 'train'"))


@query("fit_vocabulary_capped", f"WITH {_SPLIT_WORDS} SELECT ngram, total FROM vocab ORDER BY total DESC, ngram LIMIT 500")
def fit_vocabulary_capped(spark, sf):
    return ngrams.fit_vocabulary(split_posts(spark, sf).where("split = 'train'"), max_vocab=500)


@query(
    "apply_vocabulary",
    f"WITH {_SPLIT_WORDS} SELECT id, ngram, count(*) AS n FROM w WHERE split = 'test' AND ngram IN (SELECT ngram FROM vocab) GROUP BY ALL",
)
def apply_vocabulary(spark, sf):
    rows = split_posts(spark, sf)
    vocabulary = materialize(ngrams.fit_vocabulary(rows.where("split = 'train'")), "vocabulary")
    return ngrams.apply_vocabulary(rows.where("split = 'test'"), vocabulary)


@query("vectorize_features")
def vectorize_features(spark, sf):
    names = features.feature_names(levels=("character_level",))
    table_ = features.extract_features(masked(spark, sf), names=names)
    fitted = ngrams.vectorize_features(table_, names)
    return fitted.transform(table_).select("id", F.size(vector_to_array("feature_vector")).alias("n_features"))


_BLOCKS = ["contains_equals", "digit_freq"]


@query(
    "assemble_blocks",
    f"WITH {MASKED_CTE}, w AS (SELECT id, unnest(regexp_extract_all(text, {re2(P.LONG_WORD)})) AS ngram FROM masked), "
    f"v AS (SELECT ngram, row_number() OVER (ORDER BY count(*) DESC, ngram) + {len(_BLOCKS) - 1} AS place FROM w GROUP BY ngram), "
    "e AS (SELECT id, ngram, count(*)::DOUBLE AS value FROM w GROUP BY ALL), "
    "a AS (SELECT id, place, 'ngram:' || ngram AS name, value FROM e JOIN v USING (ngram) "
    + " ".join(f"UNION ALL SELECT id, {k}, {lit(n)}, ({CHAR_SQL[n]})::DOUBLE FROM masked" for k, n in enumerate(_BLOCKS))
    + ") SELECT id, place::BIGINT AS place, name, round(value, 9) AS value FROM a WHERE value <> 0",
)
def assemble_blocks(spark, sf):
    """Character features and a block of all n-grams in one vector; its entries other than zero."""
    extracted = features.extract_features(masked(spark, sf), names=_BLOCKS, keep=("text",))
    words = blocks.term_blocks(ngrams.with_word_ngrams(extracted, 1), "ngrams", ["id", *_BLOCKS])
    vectors = blocks.count_vectors(words, blocks.index_terms(blocks.term_totals(words)))
    entries = ngrams.assembled_entries(vectors, _BLOCKS, "ngram:")
    return entries.select("id", "place", "name", r9("value").alias("value"))


# -------------------------------------------------------------------------- lexicons

# fixed values: a small lexicon for the checks
LEXICON = {
    "article": ["the", "der", "die", "das", "le", "la", "les", "the"],
    "morph": ["en*", "er*", "ein*", "ther*", "the"],
    "praise": ["best", "beste", "good", "better", "gut*"],
    "time": ["ever", "went", "was", "12", "now*"],
}


def lexicon_df(spark):
    rows = [(c, t.rstrip("*"), t.endswith("*")) for c, terms in LEXICON.items() for t in terms]
    return spark.createDataFrame(rows, "category string, term string, is_prefix boolean")


LEX_CTE = "lex(category, term, is_prefix) AS (VALUES " + ", ".join(
    f"('{c}', {lit(t.rstrip('*'))}, {str(t.endswith('*')).upper()})" for c, terms in LEXICON.items() for t in terms
) + ")"
MATCH_CTE = (
    f"{MASKED_CTE}, {LEX_CTE}, {unnest_cte('w', 'masked', 'id', f'regexp_extract_all(lower(text), {re2(P.PLAIN_WORD)})', 'word')}, "
    "forms AS (SELECT DISTINCT word FROM w), word_cat AS (SELECT DISTINCT word, category FROM forms JOIN lex "
    "ON (NOT is_prefix AND word = term) OR (is_prefix AND starts_with(word, term))), "
    "m AS (SELECT id, category, count(*) AS hits FROM w JOIN word_cat USING (word) GROUP BY ALL)"
)


def matches(spark, sf):
    return lexicon.lexicon_match(masked(spark, sf), lexicon_df(spark))


@query("lexicon_match", f"WITH {MATCH_CTE} SELECT id, category, hits FROM m")
def lexicon_match(spark, sf):
    return matches(spark, sf).select("id", "category", "hits")


def patterns_df(spark, sf):
    compiled = {
        c: lexicon.category_pattern([t for t in terms if not t.endswith("*")], [t[:-1] for t in terms if t.endswith("*")])
        for c, terms in LEXICON.items()
    }
    return lexicon.lexicon_match_patterns(masked(spark, sf), compiled)


_WIDE_SQL = (
    "wide AS (SELECT k.id, " + ", ".join(f"coalesce(sum(hits) FILTER (category = '{c}'), 0)::BIGINT AS \"{c}\"" for c in LEXICON)
    + " FROM masked k LEFT JOIN m ON m.id = k.id GROUP BY k.id)"
)


@query("lexicon_match_patterns", f"WITH {MATCH_CTE}, {_WIDE_SQL} SELECT * FROM wide")
def lexicon_match_patterns(spark, sf):
    return patterns_df(spark, sf)


@query("lexicon_equi_join", f"WITH {MATCH_CTE} SELECT id, word, count(*) AS n FROM w WHERE word IN (SELECT term FROM lex WHERE NOT is_prefix) GROUP BY ALL")
def lexicon_equi_join(spark, sf):
    from quillspark.operators.joins import term_join

    words = explode_rows(masked(spark, sf), ["id"], T.plain_words(F.lower("text")), "word")
    counted = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    terms = lexicon_df(spark).where("NOT is_prefix").select(F.col("term").alias("word")).distinct()
    return term_join(counted, terms, "word", "left_semi")


@query(
    "stopword_anti_join",
    f"WITH {MASKED_CTE}, w AS (SELECT id, unnest(regexp_extract_all(lower(text), {re2(P.PLAIN_WORD)})) AS word FROM masked) "
    f"SELECT word, count(*) AS n FROM w WHERE word NOT IN {sql_list(C.STOP_WORDS)} GROUP BY word",
)
def stopword_anti_join(spark, sf):
    from quillspark.operators.joins import term_join

    words = explode_rows(masked(spark, sf), ["id"], T.plain_words(F.lower("text")), "word")
    stop = spark.createDataFrame([(w,) for w in C.STOP_WORDS], "word string")
    return term_join(words, stop, "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("lexicon_totals", f"WITH {MATCH_CTE} SELECT category, sum(hits)::BIGINT AS total FROM m GROUP BY 1")
def lexicon_totals(spark, sf):
    return lexicon.lexicon_totals(matches(spark, sf))


def _share_sql(where: str) -> str:
    return (
        f"(SELECT category, total, round(100.0::DOUBLE * total / sum(total) OVER (), 2) AS cat_pct, round(total::DOUBLE / nt, 8) AS rel_freq, "
        f"round(100.0::DOUBLE * total / nt, 2) AS rel_freq_pct FROM (SELECT category, sum(hits)::BIGINT AS total FROM m JOIN masked USING (id) WHERE {where} GROUP BY 1), "
        f"(SELECT sum(len(string_split(text, ' '))) AS nt FROM masked WHERE {where}))"
    )


def shares(spark, sf, where):
    """Category shares of the posts that satisfy a condition."""
    rows = materialize(masked(spark, sf).where(where).select("id", "text"), "masked")
    totals = lexicon.lexicon_totals(lexicon.lexicon_match(rows, lexicon_df(spark)))
    n_tokens = rows.agg(F.sum(F.size(F.split("text", " ")))).scalar()
    return lexicon.lexicon_share(totals, n_tokens)


@query("lexicon_share", f"WITH {MATCH_CTE} SELECT * FROM {_share_sql('TRUE')}")
def lexicon_share(spark, sf):
    return shares(spark, sf, "true")


_LEFT, _RIGHT = "language = 'en'", "language <> 'en'"


@query(
    "lexicon_compare",
    f"WITH {MATCH_CTE} SELECT coalesce(a.category, b.category) AS category, a.rel_freq_pct AS target, b.rel_freq_pct AS background, "
    f"round(a.rel_freq_pct - b.rel_freq_pct, 2) AS diff FROM {_share_sql(_LEFT)} a FULL JOIN {_share_sql(_RIGHT)} b ON a.category = b.category",
)
def lexicon_compare(spark, sf):
    out = lexicon.lexicon_compare(shares(spark, sf, _LEFT), shares(spark, sf, _RIGHT))
    return out.withColumn("diff", F.round("diff", 2))


@query(
    "compare_side_by_side",
    "WITH a AS (SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1), "
    "b AS (SELECT d.lang AS category, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1 GROUP BY 1) "
    "SELECT coalesce(a.category, b.category) AS category, a.n AS all_posts, b.n AS toxic_posts, a.n - b.n AS diff FROM a FULL JOIN b ON a.category = b.category",
)
def compare_side_by_side(spark, sf):
    from quillspark.operators.joins import compare_side_by_side as compare

    everything = stats.count_by(raw_posts(spark, sf), "language", "category")
    toxic_ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    toxic = stats.count_by(raw_posts(spark, sf).join(toxic_ids, "id", "left_semi"), "language", "category")
    return compare(everything, toxic, "category", "n", ("all_posts", "toxic_posts"))


_SHEET_CTE = (
    f"sheet_words AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, {re2(P.PLAIN_WORD)})) AS word FROM documents), "
    "sheet AS (SELECT lang AS category, word AS term, FALSE AS is_prefix FROM sheet_words "
    "UNION ALL SELECT 'start', substr(word, 1, 2), TRUE FROM sheet_words)"
)


def wide_sheet(spark, sf):
    """A wide lexicon from the posts: all words by language, and their beginnings as prefixes."""
    words = explode_rows(raw_posts(spark, sf), ["language"], T.extract_all("text", P.PLAIN_WORD), "word").distinct()
    columns = [F.when(F.col("language") == c, F.col("word")).alias(c) for c in ("de", "en", "es", "fr")]
    start = F.concat(F.lit(" "), F.substring("word", 1, 2), F.lit("*")).alias("start")
    return words.select(*columns, start)


@query("read_lexicon", f"WITH {_SHEET_CTE} SELECT category, term, is_prefix FROM sheet")
def read_lexicon(spark, sf):
    from quillspark.session import new_path
    from quillspark.sources import readers

    path = new_path(spark, "lexicon")
    wide_sheet(spark, sf).write.option("header", True).csv(path)
    return readers.read_lexicon(spark, path)


@query("lexicon_duplicates", f"WITH {_SHEET_CTE} SELECT term, is_prefix, count(*) AS n FROM sheet GROUP BY ALL HAVING count(*) > 1")
def lexicon_duplicates(spark, sf):
    return lexicon.lexicon_duplicates(lexicon.lexicon_from_wide(wide_sheet(spark, sf)))


@query(
    "lexicon_features",
    f"WITH {MATCH_CTE}, {_WIDE_SQL} SELECT w2.*, contains(k.text, '=')::INTEGER AS contains_equals FROM wide w2 JOIN masked k ON k.id = w2.id",
)
def lexicon_features(spark, sf):
    base = features.extract_features(masked(spark, sf), names=["contains_equals"])
    return lexicon.lexicon_features(base, matches(spark, sf), list(LEXICON))


@query(
    "lexicon_chi_square",
    f"WITH {MATCH_CTE}, {_WIDE_SQL}, o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, \"{c}\"::DOUBLE AS o FROM wide" for c in LEXICON)
    + "), e AS (SELECT category, avg(o) AS e FROM o GROUP BY 1) SELECT category, count(*) - 1 AS dof, round(sum((o - e) * (o - e) / nullif(e, 0)), 6) AS chi_square FROM o JOIN e USING (category) GROUP BY 1",
)
def lexicon_chi_square(spark, sf):
    return lexicon.lexicon_chi_square(patterns_df(spark, sf), list(LEXICON))
