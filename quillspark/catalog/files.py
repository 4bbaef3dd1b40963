"""Queries: sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.catalog.base import MASKED_CTE, POSTS_CTE, RAW_CTE, mask, marked, masked, mask_sql, posts, query, raw_posts, table
from quillspark.catalog.cleaning import TOPIC_CTE, topic_posts
from quillspark.catalog.models import GUESS_CTE, guesses
from quillspark.catalog.styles import FEATURE_SQL, _sql_value, feature_ctes, rounded, vocabulary
from quillspark.operators import features, terms
from quillspark.session import materialize, new_path
from quillspark.sources import readers, writers
from quillspark.streaming import streams


@query("read_posts", f"WITH {POSTS_CTE} SELECT id, \"user\", language, text, favs FROM posts")
def read_posts(spark, sf):
    path = new_path(spark, "posts-csv")
    rows = posts(spark, sf).select("id", "user", "language", "text", F.lit("Fri Dec 11 00:41:21 +0000 2020").alias("date"), "favs")
    rows.write.option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_posts(spark, path).select("id", "user", "language", "text", "favs")


@query(
    "prepare_posts",
    f"WITH {POSTS_CTE}, u AS (SELECT * FROM posts WHERE language = 'en' QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1) "
    f"SELECT id, {mask_sql('text')} AS text FROM u",
)
def prepare_posts(spark, sf):
    return readers.prepare_posts(posts(spark, sf)).select("id", "text")


@query("read_accounts", "SELECT '@' || source AS handle FROM documents")
def read_accounts(spark, sf):
    path = new_path(spark, "accounts")
    rows = raw_posts(spark, sf).select("id", F.concat(F.lit("@"), "user").alias("handle"), "language")
    rows.write.option("header", True).csv(path)
    return readers.read_accounts(spark, path, 1)


@query(
    "read_id_lines",
    "SELECT source AS id, arg_max(replace(replace(text, chr(10), ' '), chr(13), ' '), doc_id) AS text, 'background' AS label FROM documents GROUP BY source",
)
def read_id_lines(spark, sf):
    """Lines ``source text``: a source repeats, so its last line is kept."""
    path = new_path(spark, "id-lines")
    text = F.regexp_replace("text", "[\n\r]", " ")
    # files in id order, so that the last line of a source is the one with its largest id
    lines = raw_posts(spark, sf).select("id", F.concat_ws(" ", "user", text).alias("value"))
    lines.repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)
    return readers.read_id_lines(spark, path, "background")


@query(
    "read_vectors",
    "SELECT 'w' || vec_id AS word, len(embedding)::INTEGER AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
)
def read_vectors(spark, sf):
    path = new_path(spark, "vectors")
    rows = table(spark, sf, "embeddings")
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    rows.select(F.concat(F.lit("w"), F.col("vec_id"), F.lit(" "), numbers).alias("value")).write.text(path)
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return readers.read_vectors(spark, path).select("word", F.size("vector").alias("size"), F.round(total, 4).alias("total"))


@query("save_load_processed", f"WITH {MASKED_CTE} SELECT id, text, language FROM masked")
def save_load_processed(spark, sf):
    path = new_path(spark, "processed")
    writers.save_processed(masked(spark, sf).select("id", "text", "language"), path, ["language"])
    return readers.load_processed(spark, path)


@query(
    "write_ranked_terms",
    f"WITH {TOPIC_CTE} SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM topic_posts) GROUP BY term ORDER BY n DESC, term LIMIT 200",
)
def write_ranked_terms(spark, sf):
    path = new_path(spark, "terms")
    writers.write_ranked_terms(terms.top_keywords(topic_posts(spark, sf)), path)
    return spark.read.schema("term string, n bigint").option("header", True).csv(path)


@query("write_predictions", f"WITH {GUESS_CTE} SELECT id, label, prediction FROM g")
def write_predictions(spark, sf):
    path = new_path(spark, "predictions")
    writers.write_predictions(guesses(spark, sf).select("id", "label", "prediction"), path)
    return spark.read.schema("id bigint, label string, prediction string").option("header", True).csv(path)


@query("write_errors", f"WITH {GUESS_CTE} SELECT id, label, prediction FROM g WHERE label <> prediction")
def write_errors(spark, sf):
    path = new_path(spark, "errors")
    writers.write_errors(guesses(spark, sf).select("id", "label", "prediction"), path)
    return spark.read.schema("id bigint, label string, prediction string").option("header", True).option("sep", "\t").csv(path)


@query("write_feature_report")
def write_feature_report(spark, sf):
    path = new_path(spark, "report")
    names = features.feature_names(levels=("character_level",))
    kinds = features.feature_kinds(names)
    table_ = features.extract_features(masked(spark, sf), names=names)
    writers.write_feature_report(
        {
            "binary": features.binary_feature_pct(table_, kinds["binary"]),
            "frequency": features.frequency_feature_means(table_, kinds["frequency"]),
        },
        path,
    )
    return spark.read.parquet(f"{path}/binary").select("feature", F.col("pct").alias("value")).unionByName(
        spark.read.parquet(f"{path}/frequency").select("feature", F.col("mean").alias("value"))
    )


# --------------------------------------------------------------------------- streams


def stream(spark, sf, name):
    """A table as a stream; it is one file of the folder, or a folder of part files."""
    whole = table(spark, sf, name)
    if whole.inputFiles()[0].rstrip("/").endswith(f"/{name}.parquet"):
        return streams.read_parquet_stream(spark, sf, whole.schema, f"{name}.parquet")
    return streams.read_parquet_stream(spark, f"{sf}/{name}.parquet", whole.schema)


@query("stream_append_unseen", "SELECT user_id AS id, min(event_type) AS event_type FROM events GROUP BY 1")
def stream_append_unseen(spark, sf):
    store = new_path(spark, "store")
    rows = stream(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type")
    streams.stream_append_unseen(rows, store).awaitTermination()
    return spark.read.schema(rows.schema).parquet(store).select("id", "event_type")


@query("stream_append_within_watermark", "SELECT DISTINCT event_id AS id FROM events")
def stream_append_within_watermark(spark, sf):
    rows = stream(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("date"))
    return streams.run_to_end(streams.append_within_watermark(rows, "id", "date", "1 day"), "unseen").select("id")


@query(
    "stream_posts_per_day",
    "SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts::DATE + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1",
)
def stream_posts_per_day(spark, sf):
    rows = stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("date"))
    return streams.run_to_end(streams.stream_posts_per_day(rows), "per-day")


# posts without a token or a sentence have no row in ``f``; their numbers are 0, those of a null text are null
_COUNTED = (
    "n_doc n_words word_chars n_alpha n_upper n_short n_long n_num n_past n_pres n_adj n_comp n_emotes n_unknown n_quoted "
    "n_types n_once n_twice n_syll n_stop n_punct n_root n_sents sent_chars"
).split()


@query(
    "stream_features",
    f"WITH {RAW_CTE}, {feature_ctes('raw_posts')}, every AS (SELECT b.id, b.text, length(b.text) AS n, "
    + ", ".join(f"coalesce(f.{c}, CASE WHEN b.text IS NOT NULL THEN 0 END) AS {c}" for c in _COUNTED)
    + f" FROM base b LEFT JOIN f ON f.id = b.id) SELECT id, {', '.join(f'{_sql_value(n)} AS {n}' for n in FEATURE_SQL)} FROM every",
)
def stream_features(spark, sf):
    """All levels of the texts as given, from a stream; every batch meets the vocabulary of the benchmark."""
    rows = stream(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    store = new_path(spark, "features")
    streams.stream_features(rows, store, materialize(vocabulary(spark, sf), "vocabulary")).awaitTermination()
    return rounded(spark.read.parquet(store), list(FEATURE_SQL))


@query(
    "stream_all_features",
    f"WITH {MASKED_CTE}, {feature_ctes('masked')} SELECT id, {', '.join(f'{_sql_value(n)} AS {n}' for n in FEATURE_SQL)} FROM f",
)
def stream_all_features(spark, sf):
    """All levels from a stream; every batch meets the vocabulary of the benchmark."""
    columns = [F.col("doc_id").alias("id"), F.col("source").alias("user"), F.col("lang").alias("language"), "text"]
    rows = mask(marked(stream(spark, sf, "documents").select(*columns))).select("id", "text")
    store = new_path(spark, "stream-features")
    streams.stream_features(rows, store, materialize(vocabulary(spark, sf), "vocabulary")).awaitTermination()
    return rounded(spark.read.parquet(store), list(FEATURE_SQL))
