from pyspark.sql import functions as F

from quillspark.operators import features
from quillspark.session import new_path
from quillspark.streaming import streams


def test_store_is_appended_over_runs(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string").write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run(progress):
        stream = streams.read_parquet_stream(spark, source, schema)
        streams.stream_append_unseen(stream, store, progress=progress).awaitTermination()
        return sorted((r.id, r.v) for r in spark.read.schema(schema).parquet(store).select("id", "v").collect())

    first = str(tmp_path / "p1")
    assert run(first) == [(1, "a"), (2, "c")]
    spark.createDataFrame([(2, "x"), (3, "d")], "id long, v string").write.mode("append").parquet(source)
    assert run(first) == [(1, "a"), (2, "c"), (3, "d")]
    # a new run over the same input finds nothing new and loses nothing
    assert run(str(tmp_path / "p2")) == [(1, "a"), (2, "c"), (3, "d")]


def test_daily_counts_equal_the_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    days = spark.range(0, 240).select((F.lit(1_600_000_000) + F.col("id") * 3600).cast("timestamp").alias("date"))
    days.write.parquet(source)
    stream = streams.read_parquet_stream(spark, source, days.schema)
    got = {r.day: r.n for r in streams.run_to_end(streams.stream_posts_per_day(stream), "days").collect()}
    want = {r.day: r["count"] for r in days.groupBy(F.to_date("date").alias("day")).count().collect()}
    assert got and all(want[d] == n for d, n in got.items()) and len(want) - len(got) <= 2


def test_features_of_all_levels_are_written_batch_by_batch(spark, tmp_path):
    source, store, progress = (str(tmp_path / n) for n in ("posts", "features", "progress"))
    vocabulary = spark.createDataFrame([("good",), ("day",)], "word string")
    texts = [(1, "Good day, gud people!"), (2, ""), (3, "A day? @User was here..."), (4, "good good")]
    for k in (0, 2):
        spark.createDataFrame(texts[k : k + 2], "id long, text string").write.mode("append").parquet(source)
        rows = streams.read_parquet_stream(spark, source, spark.read.parquet(source).schema)
        streams.stream_features(rows, store, vocabulary, progress).awaitTermination()
    names = features.feature_names(with_vocabulary=True)
    got = spark.read.parquet(store)
    assert got.select("batch").distinct().count() == 2
    want = features.extract_features(spark.read.parquet(source), vocabulary=vocabulary)
    rows_of = lambda df: sorted(map(str, df.select("id", *names).collect()))
    assert rows_of(got) == rows_of(want)


def test_paths_are_new(spark):
    assert new_path(spark, "x") != new_path(spark, "x")


def test_a_table_of_part_files_streams_like_one_file(spark, tmp_path):
    from quillspark.catalog import files

    rows = [(i, f"A post no {i}, with words and a #tag!", "en", "s1", 30) for i in range(20)]
    posts = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "with words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    posts.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert files.stream_all_features(spark, str(tmp_path)).count() == 20
    assert files.stream_features(spark, str(tmp_path)).count() == 20


def test_the_stream_query_has_the_features_of_all_levels(spark, tmp_path):
    from quillspark.catalog import files

    texts = ["Good day, gud people! He walked.", "", None, "   ", "no \"quoted bit\" 3.5 ..."]
    rows = [(i, t, "en", "s1", 30) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "good day")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["id"]: r for r in files.stream_features(spark, str(tmp_path)).collect()}
    assert set(got[0].asDict()) == {"id", *features.feature_names(with_vocabulary=True)}
    assert got[0]["n_sents"] == 2 and got[0]["nonstandard_spelling"] == round(4 / 6, 9) and got[0]["past_tense_words"] == round(1 / 6, 9)
    assert got[1]["n_sents"] == got[3]["n_sents"] == 0 and got[2]["n_sents"] is None
