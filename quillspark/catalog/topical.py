"""Queries: phrases, dictionary, topics, word vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.catalog.base import query, r9, table, unnest_cte
from quillspark.catalog.cleaning import TOPIC_CTE, topic_posts
from quillspark.operators import phrases, topics, vectors
from quillspark.plans import topics as topic_plan
from quillspark.session import materialize

#: Thresholds of the phrase queries; the fixture corpora are far smaller than the defaults assume.
MIN_COUNT, THRESHOLD, MIN_DOCS = 5, 2.0, 5


def tokens(spark, sf):
    """(id, tokens) in topic mode, written once: several counts read it."""
    return materialize(topic_posts(spark, sf).select("id", "language", F.col("tokens_norm").alias("tokens")), "topic-tokens")


_PHRASE_CTE = (
    f"{TOPIC_CTE}, {unnest_cte('tk', 'topic_posts', 'id', 'tokens', 't')}, "
    "nb AS (SELECT id, pos, t AS a, lead(t) OVER (PARTITION BY id ORDER BY pos) AS b FROM tk), "
    "uni AS (SELECT t, count(*) AS n FROM tk GROUP BY t), bi AS (SELECT a, b, count(*) AS n FROM nb WHERE b IS NOT NULL GROUP BY ALL), "
    "v AS (SELECT ((SELECT count(*) FROM uni) + (SELECT count(*) FROM bi))::DOUBLE AS v), "
    f"ph AS (SELECT bi.a, bi.b, bi.n, (bi.n - {MIN_COUNT}) * (SELECT v FROM v) / ua.n / ub.n AS score FROM bi JOIN uni ua ON ua.t = bi.a JOIN uni ub ON ub.t = bi.b "
    f"WHERE bi.n >= {MIN_COUNT}), kept_ph AS (SELECT * FROM ph WHERE score > {THRESHOLD})"
)


@query("phrase_scores", f"WITH {_PHRASE_CTE} SELECT a, b, n, round(score, 6) AS score FROM kept_ph")
def phrase_scores(spark, sf):
    out = phrases.phrase_scores(tokens(spark, sf), "tokens", MIN_COUNT, THRESHOLD)
    return out.withColumn("score", F.round("score", 6))


# greedy choice as islands: in a run of neighbouring candidate starts every second one is taken
_APPEND_CTE = (
    f"{_PHRASE_CTE}, starts AS (SELECT nb.id, nb.pos, nb.a, nb.b FROM nb JOIN kept_ph k ON k.a = nb.a AND k.b = nb.b), "
    "isl AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM starts), "
    "taken AS (SELECT id, pos, a || '_' || b AS t FROM (SELECT *, row_number() OVER (PARTITION BY id, island ORDER BY pos) AS k FROM isl) WHERE k % 2 = 1), "
    "lonely AS (SELECT tk.id, tk.pos, tk.t FROM tk WHERE contains(t, '_') AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.id = tk.id AND x.pos IN (tk.pos, tk.pos - 1))), "
    "added AS (SELECT * FROM taken UNION ALL SELECT * FROM lonely), "
    "grown AS (SELECT id, pos, t, 0 AS part FROM tk UNION ALL SELECT id, pos, t, 1 FROM added)"
)


def grown(spark, sf):
    table_ = tokens(spark, sf)
    scores = materialize(phrases.phrase_scores(table_, "tokens", MIN_COUNT, THRESHOLD), "phrases")
    return phrases.append_phrases(table_, scores, "tokens")


@query("append_phrases", f"WITH {_APPEND_CTE} SELECT id, string_agg(t, ' ' ORDER BY part, pos) AS tokens FROM grown GROUP BY id")
def append_phrases(spark, sf):
    return grown(spark, sf).select("id", F.array_join("tokens", " ").alias("tokens"))


_DICT_CTE = (
    f"{_APPEND_CTE}, df AS (SELECT t AS term, count(DISTINCT id) AS doc_freq FROM grown GROUP BY t), "
    f"dict AS (SELECT term, doc_freq, (row_number() OVER (ORDER BY doc_freq DESC, term) - 1)::INTEGER AS term_id FROM df "
    f"WHERE doc_freq >= {MIN_DOCS} AND doc_freq <= 0.5::DOUBLE * (SELECT count(*) FROM topic_posts))"
)


@query("build_dictionary", f"WITH {_DICT_CTE} SELECT term, term_id, doc_freq FROM dict")
def build_dictionary(spark, sf):
    return topics.build_dictionary(grown(spark, sf), "tokens", MIN_DOCS)


@query("dictionary_report", f"WITH {_DICT_CTE} SELECT count(*) AS unique_tokens, (SELECT count(*) FROM topic_posts) AS documents FROM dict")
def dictionary_report(spark, sf):
    corpus = materialize(grown(spark, sf), "corpus")
    return topics.dictionary_report(corpus, topics.build_dictionary(corpus, "tokens", MIN_DOCS))


@query(
    "doc_term_matrix",
    f"WITH {_DICT_CTE} SELECT id, term_id, count(*) AS n FROM grown JOIN dict ON dict.term = grown.t GROUP BY ALL",
)
def doc_term_matrix(spark, sf):
    corpus = materialize(grown(spark, sf), "corpus")
    dictionary = materialize(topics.build_dictionary(corpus, "tokens", MIN_DOCS), "dictionary")
    return topics.doc_term_matrix(corpus, dictionary, "tokens")


# ------------------------------------------------ topic tables that stand on counts alone

_LANG_CTE = (
    f"{TOPIC_CTE}, lt AS (SELECT m.language, t.id, unnest(t.tokens) AS term FROM topic_posts t JOIN masked m ON m.id = t.id), "
    "tc AS (SELECT language, term, count(*) AS n FROM lt GROUP BY ALL), "
    "topic_ids(language, topic) AS (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)), "
    "mat AS (SELECT topic, term, n, n::DOUBLE / sum(n) OVER (PARTITION BY topic) AS weight FROM tc JOIN topic_ids USING (language)), "
    "listed AS (SELECT topic, term, weight, (row_number() OVER (PARTITION BY topic ORDER BY n DESC, term))::INTEGER AS rank FROM mat), "
    "tops AS (SELECT * FROM listed WHERE rank <= 20)"
)


def language_topics(corpus):
    """(topic, term, n, weight): the languages as topics, with relative term frequencies."""
    names = F.when(F.col("language") == "de", 0).when(F.col("language") == "en", 1).when(F.col("language") == "es", 2)
    counts = (
        corpus.select(names.otherwise(3).alias("topic"), F.explode("tokens").alias("term"))
        .groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    )
    sums = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    return counts.join(sums, "topic").select("topic", "term", "n", (F.col("n") / F.col("total")).alias("weight"))


def ranked_topics(matrix, top=20):
    order = Window.partitionBy("topic").orderBy(F.desc("n"), F.asc("term"))
    return matrix.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("n")


_UMASS_CTE = (
    f"{_LANG_CTE}, seen AS (SELECT DISTINCT lt.id, tops.topic, tops.rank FROM lt JOIN tops ON tops.term = lt.term), "
    "d AS (SELECT topic, rank, count(*) AS n FROM seen GROUP BY ALL), "
    "dd AS (SELECT x.topic, x.rank AS m, y.rank AS l, count(*) AS n FROM seen x JOIN seen y ON x.id = y.id AND x.topic = y.topic AND y.rank < x.rank GROUP BY ALL), "
    "prs AS (SELECT x.topic, x.rank AS m, y.rank AS l FROM tops x JOIN tops y ON x.topic = y.topic AND y.rank < x.rank), "
    "coh AS (SELECT p.topic, avg(ln((coalesce(dd.n, 0) + 1.0::DOUBLE) / d.n)) AS coherence FROM prs p "
    "LEFT JOIN dd ON dd.topic = p.topic AND dd.m = p.m AND dd.l = p.l LEFT JOIN d ON d.topic = p.topic AND d.rank = p.l GROUP BY p.topic)"
)


def umass(spark, sf):
    corpus = tokens(spark, sf)
    tops = materialize(ranked_topics(language_topics(corpus)), "topics")
    return tops, topics.umass_coherence(corpus, tops, "tokens")


@query("umass_coherence", f"WITH {_UMASS_CTE} SELECT topic, round(coherence, 6) AS coherence FROM coh")
def umass_coherence(spark, sf):
    return umass(spark, sf)[1].withColumn("coherence", F.round("coherence", 6))


@query("avg_coherence", f"WITH {_UMASS_CTE} SELECT round(avg(coherence), 6) AS avg_coherence FROM coh")
def avg_coherence(spark, sf):
    return topics.avg_coherence(umass(spark, sf)[1]).select(F.round("avg_coherence", 6).alias("avg_coherence"))


@query(
    "top_topics",
    f"WITH {_UMASS_CTE} SELECT topic, rank, term, round(weight, 9) AS weight, round(coherence, 6) AS coherence FROM tops JOIN coh USING (topic)",
)
def top_topics(spark, sf):
    tops, coherence = umass(spark, sf)
    out = topics.top_topics(tops, coherence)
    return out.select("topic", "rank", "term", r9("weight").alias("weight"), F.round("coherence", 6).alias("coherence"))


_CV_CTE = (
    f"{_LANG_CTE}, tok AS (SELECT id, len(tokens) AS size, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM topic_posts), "
    "win AS (SELECT DISTINCT id, topic, rank, unnest(range(greatest(pos - 109, 0), least(pos, greatest(size - 110, 0)) + 1)) AS w FROM tok JOIN tops USING (term)), "
    "sets AS (SELECT id, w, topic, list_sort(list(rank)) AS ranks FROM win GROUP BY ALL), folded AS (SELECT topic, ranks, count(*) AS n FROM sets GROUP BY ALL), "
    "first AS (SELECT topic, n, ranks, unnest(ranks) AS m FROM folded), joint AS (SELECT topic, m, l, sum(n) AS n FROM (SELECT topic, n, m, unnest(ranks) AS l FROM first) GROUP BY ALL), "
    "total AS (SELECT sum(greatest(len(tokens) - 109, 1))::DOUBLE AS t FROM topic_posts), pr AS (SELECT topic, m, l, n / t AS p FROM joint, total), "
    "grid AS (SELECT a.topic, a.rank AS m, b.rank AS l FROM tops a JOIN tops b USING (topic)), "
    "cell AS (SELECT g.topic, g.m, g.l, coalesce(ln((coalesce(j.p, 0) + 1e-12::DOUBLE) / (x.p * y.p)) / -ln(coalesce(j.p, 0) + 1e-12::DOUBLE), 0) AS v FROM grid g "
    "LEFT JOIN pr j ON j.topic = g.topic AND j.m = g.m AND j.l = g.l LEFT JOIN pr x ON x.topic = g.topic AND x.m = g.m AND x.l = g.m "
    "LEFT JOIN pr y ON y.topic = g.topic AND y.m = g.l AND y.l = g.l), "
    "whole AS (SELECT topic, l, sum(v) AS s FROM cell GROUP BY ALL), "
    "cos AS (SELECT topic, m, coalesce(sum(v * s) / nullif(sqrt(sum(v * v)) * sqrt(sum(s * s)), 0), 0) AS c FROM cell JOIN whole USING (topic, l) GROUP BY ALL)"
)


@query("topic_coherence_cv", f"WITH {_CV_CTE} SELECT topic, round(avg(c), 6) AS coherence FROM cos GROUP BY topic")
def topic_coherence_cv(spark, sf):
    corpus = tokens(spark, sf)
    tops = materialize(ranked_topics(language_topics(corpus)), "topics")
    return topics.npmi_coherence(corpus, tops, "tokens").withColumn("coherence", F.round("coherence", 6))


_DIFF_CTE = (
    f"{_LANG_CTE}, rc AS (SELECT topic, term, count(*) AS n FROM lt JOIN topic_ids USING (language) WHERE id IN (SELECT doc_id FROM labels) GROUP BY ALL), "
    "rmat AS (SELECT topic, term, n::DOUBLE / sum(n) OVER (PARTITION BY topic) AS weight FROM rc)"
)


#: Weights of both sides for every pair of topics and every term of either table.
_UNION_CTE = (
    "every AS (SELECT term FROM mat UNION SELECT term FROM rmat), sides AS (SELECT l.topic AS topic_left, r.topic AS topic_right FROM "
    "(SELECT DISTINCT topic FROM rmat) l CROSS JOIN (SELECT DISTINCT topic FROM mat) r), "
    "cells AS (SELECT topic_left, topic_right, coalesce(a.weight, 0) AS p, coalesce(b.weight, 0) AS q FROM sides CROSS JOIN every "
    "LEFT JOIN rmat a ON a.topic = topic_left AND a.term = every.term LEFT JOIN mat b ON b.topic = topic_right AND b.term = every.term)"
)


def _topic_diff(spark, sf, distance):
    """The labelled posts' topics against those of all posts, which hold every term of them."""
    corpus = tokens(spark, sf)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    part = language_topics(corpus.join(labels, "id", "left_semi"))
    out = topics.topic_diff(part, language_topics(corpus), distance)
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "topic_diff",
    f"WITH {_DIFF_CTE}, {_UNION_CTE} SELECT topic_left, topic_right, round(sum(CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN 'inf'::DOUBLE ELSE p * ln(p / q) END), 6) AS distance "
    "FROM cells GROUP BY ALL",
)
def topic_diff(spark, sf):
    return _topic_diff(spark, sf, "kullback_leibler")


@query(
    "topic_diff_hellinger",
    f"WITH {_DIFF_CTE}, {_UNION_CTE} SELECT topic_left, topic_right, round(sqrt(sum((sqrt(p) - sqrt(q)) ** 2) / 2), 6) AS distance FROM cells GROUP BY ALL",
)
def topic_diff_hellinger(spark, sf):
    return _topic_diff(spark, sf, "hellinger")


@query(
    "topic_diff_jaccard",
    f"WITH {_DIFF_CTE}, {_UNION_CTE} SELECT topic_left, topic_right, round(1 - count(*) FILTER (p > 0 AND q > 0) / count(*) FILTER (p > 0 OR q > 0)::DOUBLE, 6) AS distance "
    "FROM cells GROUP BY ALL",
)
def topic_diff_jaccard(spark, sf):
    return _topic_diff(spark, sf, "jaccard")


@query(
    "topic_relevance",
    f"WITH {_LANG_CTE}, tf AS (SELECT term, sum(n)::BIGINT AS n FROM tc GROUP BY 1), "
    "r AS (SELECT topic, term, 0.6::DOUBLE * ln(weight) + 0.4::DOUBLE * ln(weight / (tf.n / (SELECT sum(n) FROM tf)::DOUBLE)) AS relevance FROM mat JOIN tf USING (term)), "
    "o AS (SELECT topic, term, round(relevance, 6) AS relevance, (row_number() OVER (PARTITION BY topic ORDER BY round(relevance, 9) DESC, term))::INTEGER AS rank FROM r) "
    "SELECT topic, rank, term, relevance FROM o WHERE rank <= 20",
)
def topic_relevance(spark, sf):
    matrix = materialize(language_topics(tokens(spark, sf)), "matrix")
    freq = matrix.groupBy("term").agg(F.sum("n").alias("n"))
    out = topics.topic_relevance(matrix.drop("n"), freq)
    return out.withColumn("relevance", F.round("relevance", 6))


@query(
    "topic_prevalence",
    f"WITH {_LANG_CTE} SELECT topic, round(sum(n)::DOUBLE / (SELECT sum(n) FROM mat)::DOUBLE, 9) AS prevalence FROM mat GROUP BY 1",
)
def topic_prevalence(spark, sf):
    lengths = language_topics(tokens(spark, sf)).groupBy("topic").agg(F.sum("n").alias("length"))
    shares = lengths.withColumn("share", F.lit(1.0))
    return topics.topic_prevalence(shares).withColumn("prevalence", r9("prevalence"))


# ------------------------------------------------------------------------ fitted models


def _lda(spark, sf, k=4):
    corpus = tokens(spark, sf)
    bow = topics.fit_bag_of_words(corpus, "tokens", MIN_DOCS)
    bags = materialize(bow.transform(corpus), "bags")
    return bow, bags, topics.train_lda(bags, k)


@query("train_lda")
def train_lda(spark, sf):
    bow, _, model = _lda(spark, sf)
    return topics.topic_terms(spark, model, bow.vocabulary, 20)


@query("topic_model")
def topic_model(spark, sf):
    corpus = topic_posts(spark, sf)
    _, _, ranked = topic_plan.topic_model(corpus, k=4, min_docs=MIN_DOCS)
    return ranked


@query("log_perplexity")
def log_perplexity(spark, sf):
    _, bags, model = _lda(spark, sf)
    return spark.createDataFrame([(float(topics.log_perplexity(model, bags)),)], "log_perplexity double")


# -------------------------------------------------------------------------- word vectors


@query(
    "similar_words",
    "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS word, "
    "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 6) AS similarity FROM embeddings WHERE vec_id <> 0 "
    "ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) DESC, vec_id LIMIT 5",
)
def similar_words(spark, sf):
    words = table(spark, sf, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    return vectors.similar_words(words, 0).withColumn("similarity", F.round("similarity", 6))


def _words_and_asked(spark, sf):
    """The vectors, and those that are asked for: all whose id is divisible by 100."""
    words = table(spark, sf, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    return words, words.where(F.col("word") % 100 == 0)


@query(
    "nearest_words",
    "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c "
    "FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) AS rank FROM s) "
    "SELECT query, rank, neighbour, round(c, 6) AS similarity FROM r WHERE rank <= 5",
)
def nearest_words(spark, sf):
    found = vectors.nearest(*_words_and_asked(spark, sf))
    return found.withColumn("rank", F.col("rank").cast("long")).withColumn("similarity", F.round("similarity", 6))


@query("similar_words_many")
def similar_words_many(spark, sf):
    return vectors.neighbours(*_words_and_asked(spark, sf)).withColumn("similarity", F.round("similarity", 6))
