"""Queries that read a worked-out column more than once work it out once."""

import pytest

from quillspark import catalog
from quillspark.functions import patterns as P
from quillspark.functions import text as X
from quillspark.functions import tokens as T


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("single-pass"))
    texts = ["the best 😀 day :) ever", "ein 😀😀 Tag :-) und 👍🏽", "www.ex.org hw https://a.b/c the the", None, "", "the best 😀 day :) ever"]
    rows = [(k, t, ("en", "de", None)[k % 3], "web", k) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["emote_share", "corpus_totals_clean", "lexicon_share"])
def test_posts_are_worked_out_once(spark, folder, name):
    out = catalog.QUERIES[name](spark, folder)
    assert out.count() and not any("documents.parquet" in f for f in out.inputFiles())


def test_emojis_and_links_as_the_plain_patterns_say(spark):
    tokens = ["a", "😀", "😀a", "a😀", "‼", "‼️", "⁉x", "“", "€", "※", "👍🏽", "🇩🇪", "🇩", "\U0002000b", "日本", "", "~", "é", None]
    df = spark.createDataFrame([(tokens,)], "t array<string>").selectExpr("t", f"filter(t, x -> x rlike r'^{P.EMOJI_GUARDED}') AS plain")
    row = df.select("plain", T.emojis_of("t").alias("emojis"), T.clean_tokens("t").alias("clean")).first()
    assert row.emojis == row.plain and "😀a" in row.emojis and not set(row.plain) & set(row.clean)
    texts = ["hhttp://a http://b www.c hww.d Http://e https:// wwww.x,y", "w", "", None]
    links = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = links.select(X.F.regexp_replace("t", P.URL, "URL").alias("u")).collect()
    assert links.select(X.mask_urls("t").alias("u")).collect() == plain
