"""Queries: annotation, style features, feature report."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from quillspark.catalog.base import (
    MASKED_CTE, RAW_CTE, SOCIAL_SQL, hits, lit, masked, query, r9, re2, sql_list, table, unnest_cte,
)
from quillspark.functions import constants as C
from quillspark.functions import patterns as P
from quillspark.functions import style
from quillspark.functions import text as X
from quillspark.functions import tokens as T
from quillspark.functions.rows import explode_rows
from quillspark.operators import features, filters, joins
from quillspark.plans import style as style_plan

# ----------------------------------------------------------------- annotation in SQL


def sentences_sql(text: str) -> str:
    marked = f"regexp_replace({text}, {re2(P.SENTENCE_END)}, '\\1' || chr(10), 'g')"
    trimmed = f"regexp_replace(s, {re2(f'^{P.SPACE}+|{P.SPACE}+$')}, '', 'g')"
    return (
        f"list_filter(list_transform(string_split_regex({marked}, {re2(P.LINE_BREAKS)}), lambda s: {trimmed}), lambda s: s <> '')"
    )


def _pos_sql() -> str:
    parts = [f"WHEN regexp_matches(t, {re2(P.NUMBER)}) OR low IN {sql_list(C.NUMBER_WORDS)} THEN 'NUM'"]
    parts += [f"WHEN low IN {sql_list(words)} THEN '{tag}'" for tag, words in C.CLOSED_CLASSES]
    adjectives = C.POSITIVE_ADJECTIVES + C.COMPARATIVE_ADJECTIVES + C.SUPERLATIVE_ADJECTIVES
    parts.append(f"WHEN low IN {sql_list(adjectives)} THEN 'ADJ' WHEN regexp_matches(t, {re2(P.ALL_PUNCT)}) THEN 'PUNCT'")
    for tag, endings in C.SUFFIX_CLASSES:
        ends = " OR ".join(f"low LIKE '%{e}'" for e in endings)
        parts.append(f"WHEN length(low) > 4 AND ({ends}) THEN '{tag}'")
    parts.append(r"WHEN NOT regexp_matches(t, '\p{L}') THEN 'SYM' WHEN regexp_matches(t, '^\p{Lu}') THEN 'PROPN' ELSE 'NOUN'")
    return "CASE " + " ".join(parts) + " END"


_TENSE = (
    f"CASE WHEN low IN {sql_list(C.PAST_AUXILIARIES)} OR (pos_tag = 'VERB' AND low LIKE '%ed') THEN 'Past' "
    f"WHEN low IN {sql_list(C.PRESENT_AUXILIARIES)} OR pos_tag = 'VERB' THEN 'Pres' END"
)
_DEGREE = (
    f"CASE WHEN low IN {sql_list(C.COMPARATIVE_ADJECTIVES)} THEN 'Cmp' "
    f"WHEN low IN {sql_list(C.SUPERLATIVE_ADJECTIVES)} OR (pos_tag = 'ADJ' AND low LIKE '%est') THEN 'Sup' "
    "WHEN pos_tag = 'ADJ' THEN 'Pos' END"
)


def annotation_ctes(source: str) -> str:
    """``base`` (mentions in lower case), ``sents`` and ``ann`` (one row per token)."""
    return (
        f"base AS (SELECT * REPLACE (replace(text, '@USER', '@user') AS text) FROM {source}), "
        f"{unnest_cte('sents', 'base', 'id', sentences_sql('text'), 'text')}, "
        f"words AS (SELECT id, pos AS sid, unnest(l) AS t, generate_subscripts(l, 1) AS j FROM (SELECT id, pos, {SOCIAL_SQL} AS l FROM sents)), "
        f"tagged AS (SELECT *, lower(t) AS low, {_pos_sql().replace('low', 'lower(t)')} AS pos_tag FROM words), "
        "ann AS (SELECT id, (sid - 1)::INTEGER AS sid, j, t, low, pos_tag, "
        f"regexp_matches(t, {re2(P.ALL_PUNCT)}) AS is_punct, regexp_matches(t, {re2(P.ALL_SPACE)}) AS is_space, "
        f"regexp_matches(t, {re2(P.ALL_LETTERS)}) AS is_alpha, regexp_matches(t, {re2(P.ALL_ALNUM)}) AS is_alnum, "
        f"(regexp_matches(t, {re2(P.NUMBER)}) OR low IN {sql_list(C.NUMBER_WORDS)}) AS like_num, "
        f"low IN {sql_list(C.STOP_WORDS)} AS is_stop, CASE WHEN j = 1 THEN 'ROOT' ELSE 'dep' END AS dep, "
        f"{_TENSE} AS tense, {_DEGREE} AS degree FROM tagged)"
    )


ANN_CTE = f"{MASKED_CTE}, {annotation_ctes('masked')}"


def annotated(spark, sf):
    """Masked posts, mentions in lower case, with their annotation."""
    lowered = masked(spark, sf).withColumn("text", X.lowercase_mentions("text"))
    return features.annotate_tokens(lowered)


@query("split_sentences", f"WITH {MASKED_CTE} SELECT id, array_to_string({sentences_sql('text')}, ' | ') AS sentences FROM masked")
def split_sentences(spark, sf):
    return masked(spark, sf).select("id", F.array_join(T.split_sentences("text"), " | ").alias("sentences"))


@query(
    "annotate_tokens",
    f"WITH {ANN_CTE} SELECT id, string_agg(concat_ws('/', t, sid, is_punct, is_space, is_alpha, like_num, is_stop, pos_tag, dep, tense, degree), ' ' ORDER BY sid, j) AS annotation "
    "FROM ann GROUP BY id",
)
def annotate_tokens(spark, sf):
    fields = ("text", "sent_id", "is_punct", "is_space", "is_alpha", "like_num", "is_stop", "pos", "dep", "tense", "degree")
    shown = F.transform("tokens", lambda t: F.concat_ws("/", *[t[f].cast("string") for f in fields]))
    return annotated(spark, sf).select("id", F.array_join(shown, " ").alias("annotation"))


# ------------------------------------------------------------------- features in SQL

_TRIPLES = "|".join(c * 3 for c in string.ascii_letters + "äöüßàâçéèêëîïôûùñáíóúÄÖÜÉÈÊÀÇÑÁÍÓÚ")


def _div(a: str, b: str) -> str:
    return f"({a})::DOUBLE / nullif({b}, 0)::DOUBLE"


def _div0(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / nullif({b}, 0)::DOUBLE END"


_QUOTED_RE2 = lit('".+?"|' + f"(?:^|[^\\p{{L}}\\p{{N}}_])'.+?'(?:$|[^\\p{{L}}\\p{{N}}_])")
_DOUBLED = f"regexp_replace(text, {re2(f'({P.SPACE})')}, '\\1\\1', 'g')"

VOCAB_CTE = "vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM benchmark)"


def feature_ctes(source: str) -> str:
    """``f``: one row per post with everything the features need."""
    syll = f"greatest(1, {hits('low', P.VOWEL_GROUP)})"
    emoji = f"regexp_matches(t, {re2('^' + P.EMOJI)})"
    return (
        f"{annotation_ctes(source)}, {VOCAB_CTE}, "
        "counts AS (SELECT id, count(*) AS n_doc, count(*) FILTER (NOT is_punct AND NOT is_space) AS n_words, "
        "coalesce(sum(length(t)) FILTER (NOT is_punct AND NOT is_space), 0) AS word_chars, count(*) FILTER (is_alpha) AS n_alpha, "
        "count(*) FILTER (is_alpha AND t = upper(t) AND t <> lower(t)) AS n_upper, count(*) FILTER (is_alpha AND length(t) <= 3) AS n_short, "
        f"count(*) FILTER (is_alpha AND regexp_matches(t, '{_TRIPLES}')) AS n_long, count(*) FILTER (like_num) AS n_num, "
        "count(*) FILTER (is_alpha AND tense = 'Past') AS n_past, count(*) FILTER (is_alpha AND tense = 'Pres') AS n_pres, "
        "count(*) FILTER (is_alpha AND degree = 'Pos') AS n_adj, count(*) FILTER (is_alpha AND degree IN ('Cmp', 'Sup')) AS n_comp, "
        f"count(*) FILTER ({emoji}) + count(*) FILTER (t IN {sql_list(C.EMOTICONS)}) AS n_emotes, "
        f"count(DISTINCT t) FILTER (is_alpha) AS n_types, coalesce(sum({syll}) FILTER (is_alpha), 0) AS n_syll, "
        f"count(*) FILTER (is_alpha AND {syll} >= 3) AS n_complex, coalesce(sum(length(t)) FILTER (is_alpha), 0) AS n_letters, "
        f"count(*) FILTER (is_alpha AND NOT is_stop) AS n_difficult, "
        "count(DISTINCT low) FILTER (is_alpha AND low NOT IN (SELECT word FROM vocab)) AS n_unknown, "
        "count(*) FILTER (is_stop) AS n_stop, count(*) FILTER (is_punct) AS n_punct, count(*) FILTER (dep = 'ROOT') AS n_root FROM ann GROUP BY id), "
        "types AS (SELECT id, low, count(*) AS n FROM ann WHERE is_alpha GROUP BY ALL), "
        "rare AS (SELECT id, count(*) FILTER (n = 1) AS n_once, count(*) FILTER (n = 2) AS n_twice FROM types GROUP BY id), "
        "sent AS (SELECT id, count(*) AS n_sents, sum(length(text)) AS sent_chars FROM sents GROUP BY id), "
        f"quoted AS (SELECT id, len(list_filter(regexp_extract_all(array_to_string(regexp_extract_all({_DOUBLED}, {_QUOTED_RE2}), ' '), {re2(P.SOCIAL_TOKEN)}), "
        f"lambda x: regexp_matches(x, {re2(P.ALL_ALNUM)}))) AS n_quoted FROM base), "
        "f AS (SELECT b.*, c.* EXCLUDE (id), coalesce(n_once, 0) AS n_once, coalesce(n_twice, 0) AS n_twice, n_sents, sent_chars, n_quoted, length(b.text) AS n "
        "FROM base b JOIN counts c ON c.id = b.id LEFT JOIN rare r ON r.id = b.id JOIN sent s ON s.id = b.id JOIN quoted q ON q.id = b.id)"
    )


def _char_sql(text: str, n: str) -> dict[str, str]:
    flag = lambda p: f"regexp_matches({text}, {re2(p)})::INTEGER"
    return {
        "char_punc_freq": _div(hits(text, P.ASCII_PUNCT), f"(2 * {n} - 1)"),
        "digit_freq": _div(hits(text, P.DIGIT), n),
        "whitespace_freq": _div(hits(text, " "), n),
        "linebreak_freq": _div(hits(text, P.LINEBREAK), n),
        "uppercased_char_freq": _div(hits(text, P.ASCII_UPPER), n),
        "special_char_freq": _div(hits(text, P.SPECIAL_CHAR), n),
        "repeated_questionmark": flag(P.REPEATED_QUESTION),
        "repeated_periods": flag(P.REPEATED_PERIOD),
        "repeated_exclamation": flag(P.REPEATED_EXCLAMATION),
        "contains_equals": f"contains({text}, '=')::INTEGER",
    }


CHAR_SQL = _char_sql("text", "length(text)")
FEATURE_SQL = {
    **CHAR_SQL,
    "total_word_len": "n_words::BIGINT",
    "avg_word_len": _div("word_chars", "n_words"),
    "avg_sentence_len_words": _div("n_words", "n_sents"),
    "avg_sentence_len_chars": _div("sent_chars", "n_sents"),
    "uppercased_words": _div0("n_upper", "n_alpha"),
    "short_words": _div0("n_short", "n_alpha"),
    "elongated_words": _div0("n_long", "n_alpha"),
    "numberlike_tokens": _div("n_num", "n_doc"),
    "past_tense_words": _div("n_past", "n_alpha"),
    "present_tense_words": _div("n_pres", "n_alpha"),
    "positive_adjectives": _div("n_adj", "n_alpha"),
    "comp_and_sup_adjectives": _div("n_comp", "n_alpha"),
    "emotes": _div("n_emotes", "n_words"),
    "nonstandard_spelling": _div("n_unknown", "n_alpha"),
    "quoted_words": _div("n_quoted", "n_words"),
    "type_token_ratio": _div0("n_types", "n_alpha"),
    "hapax_legomena": _div0("n_once", "n_alpha"),
    "hapax_dislegomena": _div0("n_twice", "n_alpha"),
    "syllable_freqs": _div0("n_syll", "n_alpha"),
    "readability_flesch_kincaid": f"206.835::DOUBLE - 1.015::DOUBLE * {_div('n_alpha', 'n_sents')} - 84.6::DOUBLE * {_div('n_syll', 'n_alpha')}",
    "stopword_freq": _div("n_stop", "n_doc"),
    "syn_punc_freq": _div("n_punct", "n_doc"),
    "root_freq": _div("n_root", "n_doc"),
    "n_sents": "n_sents::BIGINT",
    "n_mentions": f"{hits('lower(text)', P.USER_MENTION)}::BIGINT",
}
INTEGER_FEATURES = {n for n in FEATURE_SQL if n in C.FEATURES_BY_LEVEL["document_level"]} | {
    "total_word_len", "repeated_questionmark", "repeated_periods", "repeated_exclamation", "contains_equals"
}


def _sql_value(name: str) -> str:
    return FEATURE_SQL[name] if name in INTEGER_FEATURES else f"round({FEATURE_SQL[name]}, 9)"


def rounded(df, names):
    """Ratios at 9 decimals, counts and flags as they are."""
    return df.select("id", *[F.col(n) if n in INTEGER_FEATURES else r9(n).alias(n) for n in names])


def vocabulary(spark, sf):
    """Known words: the words of the benchmark texts."""
    words = explode_rows(table(spark, sf, "benchmark"), [], T.extract_all(F.lower("text"), r"\p{L}+"), "word")
    return words.distinct()


def _register_feature(name):
    on_text = name in CHAR_SQL
    ctes = f"{MASKED_CTE}, f AS (SELECT id, replace(text, '@USER', '@user') AS text FROM masked)" if on_text else f"{MASKED_CTE}, {feature_ctes('masked')}"

    @query(name, f"WITH {ctes} SELECT id, {_sql_value(name)} AS {name} FROM f")
    def run(spark, sf):
        known = vocabulary(spark, sf) if name == "nonstandard_spelling" else None
        return rounded(features.extract_features(masked(spark, sf), vocabulary=known, names=[name]), [name])


for _name in FEATURE_SQL:
    _register_feature(_name)

_ALL = list(FEATURE_SQL)


@query(
    "extract_features",
    f"WITH {MASKED_CTE}, {feature_ctes('masked')} SELECT id, {', '.join(f'{_sql_value(n)} AS {n}' for n in _ALL)} FROM f",
)
def extract_features(spark, sf):
    return rounded(features.extract_features(masked(spark, sf), vocabulary=vocabulary(spark, sf)), _ALL)


_EXTRA_SQL = {
    "automated_readability": f"4.71::DOUBLE * {_div('n_letters', 'n_alpha')} + 0.5::DOUBLE * {_div('n_alpha', 'n_sents')} - 21.43::DOUBLE",
    "coleman_liau": f"5.88::DOUBLE * {_div('n_letters', 'n_alpha')} - 29.6::DOUBLE * {_div('n_sents', 'n_alpha')} - 15.8::DOUBLE",
    "gunning_fog": f"0.4::DOUBLE * ({_div('n_alpha', 'n_sents')} + 100 * {_div('n_complex', 'n_alpha')})",
    "dale_chall": f"0.1579::DOUBLE * 100 * {_div('n_difficult', 'n_alpha')} + 0.0496::DOUBLE * {_div('n_alpha', 'n_sents')} "
    f"+ CASE WHEN 100 * {_div('n_difficult', 'n_alpha')} > 5 THEN 3.6365::DOUBLE ELSE 0.0::DOUBLE END",
}


@query(
    "readability_extra",
    f"WITH {MASKED_CTE}, {feature_ctes('masked')} SELECT id, {', '.join(f'round({e}, 9) AS {n}' for n, e in _EXTRA_SQL.items())} FROM f",
)
def readability_extra(spark, sf):
    names = list(_EXTRA_SQL)
    out = features.extract_features(masked(spark, sf), names=names, readability=True)
    return out.select("id", *[r9(n).alias(n) for n in names])


_RICHNESS_SQL = {
    "brunet_w": f"CASE WHEN n > 0 THEN pow(n, pow(v, -{C.BRUNET_EXPONENT}::DOUBLE)) END",
    "yule_k": "10000::DOUBLE * (s2 - n) / nullif(n * n, 0)",
    "honore_r": "100::DOUBLE * ln(nullif(n, 0)) / nullif(1::DOUBLE - v1 / nullif(v, 0), 0)",
    "sichel_s": "v2 / nullif(v, 0)",
    "simpson_d": "(s2 - n) / nullif(n * (n - 1), 0)",
}


@query(
    "richness",
    f"WITH {MASKED_CTE}, {feature_ctes('masked')}, spectrum AS (SELECT id, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS v, count(*) FILTER (n = 1)::DOUBLE AS v1, "
    "count(*) FILTER (n = 2)::DOUBLE AS v2, sum(n * n)::DOUBLE AS s2 FROM types GROUP BY id) "
    f"SELECT masked.id, {', '.join(f'round({e}, 6) AS {n}' for n, e in _RICHNESS_SQL.items())} FROM masked LEFT JOIN spectrum ON spectrum.id = masked.id",
)
def richness(spark, sf):
    return features.richness(masked(spark, sf)).select("id", *[F.round(n, 6).alias(n) for n in _RICHNESS_SQL])


@query(
    "pattern_freq",
    f"WITH {RAW_CTE} SELECT id, round({_div(hits('text', '[aeiou]{2}'), 'length(text)')}, 9) AS freq, {hits('text', '[aeiou]{2}')}::BIGINT AS hits FROM raw_posts",
)
def pattern_freq(spark, sf):
    from quillspark.catalog.base import raw_posts

    freq = style.pattern_freq("text", "[aeiou]{2}")
    return raw_posts(spark, sf).select("id", r9(freq).alias("freq"), style.pattern_freq("text", "[aeiou]{2}", False).alias("hits"))


@query("pattern_flag", f"WITH {RAW_CTE} SELECT id, regexp_matches(text, 'th|sch')::INTEGER AS flag FROM raw_posts")
def pattern_flag(spark, sf):
    from quillspark.catalog.base import raw_posts

    return raw_posts(spark, sf).select("id", style.pattern_flag("text", "th|sch").alias("flag"))


_POS_FREQ_CTE = (
    f"{ANN_CTE}, tags AS (SELECT id, pos_tag AS pos FROM ann WHERE is_alnum), "
    "pf AS (SELECT id, pos, count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY id))::DOUBLE AS freq FROM tags GROUP BY id, pos)"
)


@query("pos_freq", f"WITH {_POS_FREQ_CTE} SELECT id, pos, round(freq, 9) AS freq FROM pf")
def pos_freq(spark, sf):
    return features.pos_freq(annotated(spark, sf)).select("id", "pos", r9("freq").alias("freq"))


# ------------------------------------------------------------- feature tables, report


@query(
    "select_features",
    f"WITH {MASKED_CTE}, f AS (SELECT id, replace(text, '@USER', '@user') AS text FROM masked) "
    f"SELECT id, {_sql_value('digit_freq')} AS digit_freq, {_sql_value('contains_equals')} AS contains_equals FROM f",
)
def select_features(spark, sf):
    table_ = features.extract_features(masked(spark, sf))
    return rounded(filters.select_features(table_, ["digit_freq", "pos_ngrams", "contains_equals"]), ["digit_freq", "contains_equals"])


@query(
    "join_feature_blocks",
    f"WITH {MASKED_CTE}, {feature_ctes('masked')} SELECT id, {', '.join(f'{_sql_value(n)} AS {n}' for n in ('digit_freq', 'n_sents', 'stopword_freq'))} FROM f",
)
def join_feature_blocks(spark, sf):
    base = masked(spark, sf)
    blocks = [features.extract_features(base, names=[n]) for n in ("digit_freq", "n_sents", "stopword_freq")]
    return rounded(joins.join_feature_blocks(blocks, "id"), ["digit_freq", "n_sents", "stopword_freq"])


_BINARY = ["repeated_questionmark", "repeated_periods", "repeated_exclamation", "contains_equals"]
_ABSOLUTE = ["total_word_len", "n_sents", "n_mentions"]
_FREQUENCY = [n for n in features.feature_names() if n not in _BINARY + _ABSOLUTE]


def _long_sql(names, agg, value, kind=None):
    head = f"'{kind}' AS kind, " if kind else ""
    return " UNION ALL ".join(f"SELECT {head}'{n}' AS feature, round(({agg.format(FEATURE_SQL[n])})::DOUBLE, 9) AS {value} FROM f" for n in names)


_F_CTE = f"WITH {MASKED_CTE}, {feature_ctes('masked')} "


@query(
    "split_features_by_kind",
    _F_CTE + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, " + (
            f"CASE WHEN max({FEATURE_SQL[n]}) > 1 THEN 'absolute' ELSE 'binary' END AS kind FROM f"
            if n in INTEGER_FEATURES else "'frequency' AS kind"
        )
        for n in features.feature_names()
    ),
)
def split_features_by_kind(spark, sf):
    names = features.feature_names()
    return filters.split_features_by_kind(features.extract_features(masked(spark, sf)), names)


def _r(df, value):
    return df.withColumn(value, r9(value))


@query("binary_feature_pct", _F_CTE + _long_sql(_BINARY, "100 * avg({})", "pct"))
def binary_feature_pct(spark, sf):
    return _r(features.binary_feature_pct(features.extract_features(masked(spark, sf)), _BINARY), "pct")


@query("absolute_feature_totals", _F_CTE + _long_sql(_ABSOLUTE, "sum({})", "total"))
def absolute_feature_totals(spark, sf):
    return _r(features.absolute_feature_totals(features.extract_features(masked(spark, sf)), _ABSOLUTE), "total")


@query("frequency_feature_means", _F_CTE + _long_sql(_FREQUENCY, "avg({})", "mean"))
def frequency_feature_means(spark, sf):
    return _r(features.frequency_feature_means(features.extract_features(masked(spark, sf)), _FREQUENCY), "mean")


@query("pos_freq_means", f"WITH {_POS_FREQ_CTE} SELECT pos, round(avg(freq), 9) AS mean FROM pf GROUP BY pos")
def pos_freq_means(spark, sf):
    return _r(features.pos_freq_means(features.pos_freq(annotated(spark, sf))), "mean")


@query(
    "feature_report",
    _F_CTE + " UNION ALL ".join((
        _long_sql(_BINARY, "100 * avg({})", "value", "binary"), _long_sql(_ABSOLUTE, "sum({})", "value", "absolute"),
        _long_sql(_FREQUENCY, "avg({})", "value", "frequency"),
    )),
)
def feature_report(spark, sf):
    return _r(features.feature_report(features.extract_features(masked(spark, sf)), features.feature_names()), "value")


_DIFF_SQL = (
    f"WITH {RAW_CTE}, lab AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'target' ELSE 'background' END AS label FROM labels), "
    "kept AS (SELECT r.id, r.text, l.label FROM raw_posts r JOIN lab l ON l.id = r.id WHERE r.language = 'en' "
    "QUALIFY row_number() OVER (PARTITION BY r.text ORDER BY r.id) = 1), "
    f"m AS (SELECT id, label, replace(regexp_replace(regexp_replace(text, {re2(P.MENTION)}, '@USER', 'g'), {re2(P.URL)}, 'URL', 'g'), '@USER', '@user') AS text FROM kept), "
    f"c AS (SELECT label, {', '.join(f'{e} AS {n}' for n, e in CHAR_SQL.items())} FROM m), "
    "long AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, avg({n}) FILTER (label = 'target') AS a, avg({n}) FILTER (label = 'background') AS b FROM c" for n in CHAR_SQL
    ) + ") SELECT feature, round(a, 9) AS target_mean, round(b, 9) AS background_mean, round(a - b, 9) AS diff FROM long"
)


@query("style_differences", _DIFF_SQL)
def style_differences(spark, sf):
    from quillspark.catalog.base import raw_posts

    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "target").otherwise("background").alias("label")
    )
    out = style_plan.style_differences(raw_posts(spark, sf), labels, "target", "background")
    return out.select("feature", *[r9(c).alias(c) for c in ("target_mean", "background_mean", "diff")])
