from pyspark.sql import functions as F

from quillspark.operators import dedup, evaluate, features, joins, lexicon, phrases, splits, stats, topics
from quillspark.sources import readers
from quillspark.functions import patterns as P
from quillspark.functions import tokens as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedup_keeps_smallest_id_whatever_the_partitions(spark):
    data = [(i, "copy" if i % 3 else f"t{i}") for i in range(60, 0, -1)]
    for n in (1, 7):
        got = rows(dedup.dedup_text(spark.createDataFrame(data, "id long, text string").repartition(n)))
        assert (1, "copy") in got and len(got) == 21


def test_append_unseen(spark):
    stored = spark.createDataFrame([(1, "a")], "id long, v string")
    new = spark.createDataFrame([(1, "z", 1), (2, "late", 5), (2, "early", 2)], "id long, v string, at long")
    assert rows(dedup.append_unseen(stored, new, "id", "at")) == [(1, "a"), (2, "early")]


def test_split_is_exact_and_stable(spark):
    data = [(i, "a" if i % 4 else "b") for i in range(1000)] + [(i, None) for i in range(1000, 1010)]
    base = spark.createDataFrame(data, "id long, label string")
    out = splits.stratified_split(base)
    sizes = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert sizes[("a", "train")] == 525 and sizes[("a", "test")] == 72 and sizes[("a", "validation")] == 153
    assert sizes[(None, "train")] == 7 and sum(sizes.values()) == 1010
    assert rows(out.where("label = 'a'")) == rows(splits.stratified_split(base.repartition(5)).where("label = 'a'"))


def test_sampling_sizes(spark):
    base = spark.range(500).withColumnRenamed("id", "id")
    assert splits.sample_n(base, 37).count() == 37 and splits.sample_n(base, 900).count() == 500
    assert splits.sample_n(base, 0).count() == 0
    assert splits.sample_fraction(base, 0.1).count() == 50
    small = spark.range(1000, 1100)
    assert splits.downsample_balance(base, small).count() == 200
    assert splits.downsample_balance(small, base).count() == 200
    assert splits.downsample_balance(small, base, sample_side="first").count() == 520


def test_term_join_forms_agree_on_a_hot_key(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("w"))
    terms = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3)], "w string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        cols = sorted(joins.term_join(big, terms, "w", how, small=True).columns)
        one = joins.term_join(big, terms, "w", how, small=True).select(*cols).fillna(-1)
        two = joins.term_join(big, terms, "w", how, small=False).select(*cols).fillna(-1)
        assert rows(one) == rows(two) and one.count() > 0
    assert joins.is_small(terms) and not joins.is_small(terms, max_rows=2)
    assert not joins.is_small(terms, max_chars=3)


def test_empty_days_count_zero(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00",), ("2020-01-04 00:00:00",)], "d string").select(F.to_timestamp("d").alias("date"))
    assert [n for _, n in rows(stats.posts_per_day(df))] == [1, 0, 0, 1]


def test_lexicon_forms_agree(spark):
    lex = spark.createDataFrame([("x", "term", False), ("x", "term", True), ("y", "te", True), ("y", "und", False)], "category string, term string, is_prefix boolean")
    posts = spark.createDataFrame([(1, "Term terms, détermine term_1 UND te"), (2, "none")], "id long, text string")
    assert rows(lexicon.lexicon_match(posts, lex)) == [(1, "x", 3), (1, "y", 5)]
    wide = lexicon.lexicon_match_patterns(posts, {"x": lexicon.category_pattern(["term"], ["term"]), "y": lexicon.category_pattern(["und"], ["te"])})
    assert rows(wide) == [(1, 3, 5), (2, 0, 0)]
    several = lexicon.lexicon_match_patterns(posts, {"z": lexicon.category_pattern(["und te", "a.b"], [])})
    assert rows(several) == [(1, 1), (2, 0)]


def test_phrases_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "a b c".split()), (2, "a b a b x_y".split()), (3, ["z"])], "id long, tokens array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a")], "a string, b string")
    got = {r.id: r.tokens for r in phrases.append_phrases(docs, pairs).collect()}
    assert got == {1: ["a", "b", "c", "a_b"], 2: ["a", "b", "a", "b", "x_y", "a_b", "a_b", "x_y"], 3: ["z"]}


def test_phrase_scores_by_hand(spark):
    docs = spark.createDataFrame([(i, ["new", "york", f"w{i}"]) for i in range(6)], "id long, tokens array<string>")
    (row,) = phrases.phrase_scores(docs, min_count=2, threshold=0.5).collect()
    assert (row.a, row.b, row.n) == ("new", "york", 6) and abs(row.score - 4 * (8 + 7) / 36) < 1e-12


def test_umass_by_brute_force(spark):
    import math

    docs = [["a", "b"], ["a"], ["a", "b", "c"], ["c"]]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, tokens array<string>")
    tops = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "topic int, rank int, term string")
    got = topics.umass_coherence(df, tops).first()["coherence"]
    d = lambda *w: sum(all(x in t for x in w) for t in docs)
    want = [math.log((d(m, l) + 1) / d(l)) for l, m in (("a", "b"), ("a", "c"), ("b", "c"))]
    assert abs(got - sum(want) / 3) < 1e-12


def test_report_with_a_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    report = {r.label: r for r in evaluate.classification_report(df).collect()}
    assert report["c"].recall == 0 and report["b"].support == 0 and report["accuracy"].f1 == round(1 / 3, 6)
    counts = {r.label: tuple(r)[1:] for r in evaluate.confusion_counts(df).collect()}
    assert counts == {"a": (1, 1, 1), "c": (0, 0, 1)}


def test_annotator_hook_and_retag(spark):
    posts = spark.createDataFrame([(1, "Good dogs ran. ok")], "id long, text string")
    ann = features.annotate_tokens(posts)
    lex = spark.createDataFrame([("dogs", "NOUN", None, None), ("ran", "VERB", "Past", None)], "word string, pos string, tense string, degree string")
    out = features.retag(ann, lex).first()["tokens"]
    assert [(t.text, t.pos, t.tense, t.sent_id) for t in out][2] == ("ran", "VERB", "Past", 0) and out[0].pos == "ADJ"

    def annotator(batches):
        for b in batches:
            fields = dict(sent_id=0, is_punct=False, is_space=False, is_alpha=True, like_num=False, is_stop=False, pos="X", dep="dep", tense=None, degree=None)
            yield b.assign(tokens=[[dict(text=w, **fields) for w in t.split()] for t in b["text"]])

    custom = features.annotate_tokens(posts, annotator=annotator).first()["tokens"]
    assert [t.pos for t in custom] == ["X"] * 4


def test_features_with_one_token_and_no_letters(spark):
    df = spark.createDataFrame([(1, "42"), (2, "Hi")], "id long, text string")
    out = {r.id: r for r in features.extract_features(df).collect()}
    assert out[1].short_words == 0.0 and out[1].past_tense_words is None and out[1].numberlike_tokens == 1.0
    assert out[2].type_token_ratio == 1.0 and out[2].n_sents == 1


def test_id_lines_last_wins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 first text\n2 x\n1 last  text\n3\n")
    got = {r.id: r.text for r in readers.read_id_lines(spark, str(tmp_path), "background").collect()}
    assert got == {"1": "last  text", "2": "x", "3": ""}


def test_merged_headers():
    assert readers.fill_headers(["a", None, None, "b", ""]) == ["a", "a#2", "a#3", "b", "b#2"]


def test_cv_coherence_prefers_words_that_meet(spark):
    docs = [["a", "b", "x", "y"]] * 5 + [["c"], ["d"]] * 5
    df = spark.createDataFrame(list(enumerate(docs)), "id long, tokens array<string>")
    tops = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "c"), (1, 2, "d")], "topic int, rank int, term string")
    got = {r.topic: r.coherence for r in topics.npmi_coherence(df, tops, window=4).collect()}
    assert got[0] > got[1]


def test_features_of_words_equal_those_of_token_lists(spark):
    texts = [
        "Hello HELLO hello, it WAS sooo good!!! The best 'quoted bit' of 3.5 @USER", None, "", "    ", "?! :) XD 😀😀 8-) http://a.b www.c",
        "One two two. Three walked\nquickly four", "wordless 12 wordless", "# ## h ww. (: </3 :'( x8) (8) ß Éa",
    ]
    posts = spark.createDataFrame([(i // 2 if i else None, t) for i, t in enumerate(texts)], "id long, text string").repartition(2)
    known = spark.createDataFrame([("two",), ("hello",)], "word string")
    lowered = posts.withColumn("text", F.replace(F.col("text"), F.lit("@USER"), F.lit("@user")))
    listed = lowered.withColumn("tokens", T.annotate("text"))
    for vocabulary in (None, known):
        a = features.extract_features(posts, vocabulary=vocabulary, readability=True, keep=("text",))
        b = features.extract_features(listed, vocabulary=vocabulary, readability=True, keep=("text",), tokens_col="tokens")
        assert a.columns == b.columns
        shown = [sorted((repr(r) for r in x.withColumn("text", F.replace(F.col("text"), F.lit("@USER"), F.lit("@user"))).collect())) for x in (a, b)]
        assert shown[0] == shown[1]


def test_fast_tokens_and_sentences_equal_the_plain_patterns(spark):
    marks = [c for c in ":;=()[]<>/-^'8XxDPpo|*3.,#@ \t\x85  hw"]
    texts = ["".join(marks[(i * 7 + j * (i % 11 + 1)) % len(marks)] for j in range(40)) for i in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.transform(F.split(F.regexp_replace("text", P.SENTENCE_END, "$1\n"), P.LINE_BREAKS), lambda s: F.regexp_replace(s, f"^{P.SPACE}+|{P.SPACE}+$", ""))
    differs = (T.social_tokenize("text") != T.extract_all("text", P.SOCIAL_TOKEN)) | (T.split_sentences("text") != F.filter(plain, lambda s: s != ""))
    assert rows.where(differs).count() == 0


def test_a_feature_asks_for_its_own_numbers_only(spark):
    posts = spark.createDataFrame([(1, "some words")], "id long, text string")
    plan = features.extract_features(posts, names=["total_word_len"])._jdf.queryExecution().optimizedPlan().toString()
    assert "mapinarrow" in plan.lower() and "_n_syllables" not in plan
