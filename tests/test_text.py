from pyspark.sql import functions as F

from quillspark.functions import style, text as X, tokens as T
from quillspark.plans.preprocess import preprocess_classify, preprocess_topic


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "text string").select(fn("text").alias("x")).first()["x"]


def test_masks(spark):
    assert one(spark, "@Ünal_1 sees https://a.b/c?d#e and www.x.y", lambda c: X.mask_urls(X.mask_mentions(c))) == "@USER sees URL and URL"
    assert one(spark, "@USER and @USERS", X.lowercase_mentions) == "@user and @userS"


def test_placeholder_is_deleted_inside_words(spark):
    assert one(spark, "curl=URLs", X.strip_url_placeholder) == "curl=s"


def test_longest_emoticon_first(spark):
    assert one(spark, "a :-) b :'-( c :) d", X.strip_emoticons) == "a  b  c  d"


def test_clean_text_keeps_spacing(spark):
    assert one(spark, "RT hi #Tag 😀👍🏽 URL :) RTs", X.clean_text) == " hi     RTs"


def test_deflood(spark):
    assert one(spark, "sooooo!!!!!! aaa 😀😀😀😀", X.deflood) == "sooo!!! aaa 😀😀😀"


def test_social_tokens(spark):
    got = one(spark, "RT @USER: don't :-):) 8) 18) #Tag 😀👍🏽 http://x.y/z?q=1 end.", T.social_tokenize)
    assert got == ["RT", "@USER", ":", "don't", ":-)", ":)", "8)", "18", ")", "#Tag", "😀", "👍🏽", "http://x.y/z?q=1", "end", "."]


def test_norm_tokens_and_junk_is_linear(spark):
    assert one(spark, "#a-b well-known x_y -", T.word_tokenize_norm) == ["#a", "-", "b", "well-known", "x_y", "-"]
    assert len(one(spark, "a'" * 60_000, T.social_tokenize)) == 2
    assert len(one(spark, "a-" * 60_000, T.word_tokenize_norm)) == 2


def test_sentences(spark):
    assert one(spark, "!!! Is 3.5 ok? Yes.\n\n  No ", T.split_sentences) == ["!!!", "Is 3.5 ok?", "Yes.", "No"]
    assert one(spark, "", T.split_sentences) == []


def test_emotes(spark):
    got = one(spark, "😀 XD :) 😀❤️ RT", lambda c: T.extract_emotes(T.social_tokenize(c)))
    assert got["emojis"] == ["😀", "😀", "❤️"] and got["emoticons"] == ["XD", ":)"]


def test_ngram_guards(spark):
    assert one(spark, "ab", lambda c: T.char_ngrams(c, 3)) == []
    assert one(spark, "", lambda c: T.char_ngrams(c, 1)) == []
    assert one(spark, "a \n b", lambda c: T.char_ngrams(c, 3)) == ["a b"]
    assert one(spark, "a b c", lambda c: T.token_ngrams(F.split(c, " "), 2)) == ["a b", "b c"]


def test_empty_text_ratios_are_null(spark):
    rows = spark.createDataFrame([("",)], "text string")
    out = rows.select(*[c.alias(n) for n, c in style.character_features("text").items()]).first()
    assert out["digit_freq"] is None and out["contains_equals"] == 0


def test_punctuation_denominator(spark):
    assert one(spark, "a!", lambda c: style.character_features(c)["char_punc_freq"]) == 1 / 3
    assert one(spark, "a!", lambda c: style.character_features(c, "chars")["char_punc_freq"]) == 1 / 2


def test_post_date(spark):
    row = spark.createDataFrame([("Fri Dec 11 00:41:21 +0000 2020",), ("x",)], "d string").select(F.unix_seconds(X.post_timestamp("d")).alias("s")).collect()
    assert [r.s for r in row] == [1607647281, None]


def test_preprocess_modes(spark):
    rows = spark.createDataFrame([(1, "RT @USER The Votes loooooool #MAGA #maga :) 😀 URL"), (2, "one"), (3, None)], "id long, text string")
    light = preprocess_classify(rows).collect()
    assert [r.id for r in light] == [1]
    assert light[0].tokens_clean == ["@USER", "The", "Votes", "loooooool"] and light[0].hashtags == ["#maga", "#maga"]
    hard = preprocess_topic(rows).collect()
    assert [r.id for r in hard] == [1]
    assert hard[0].tokens_norm == ["user", "vote", "loool"] and hard[0].text_norm == "user vote loool"
