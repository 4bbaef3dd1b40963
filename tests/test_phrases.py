"""Phrases put into posts: both forms against a loop over the tokens."""

import random

from quillspark.operators import phrases


def by_loop(tokens, pairs):
    if tokens is None:
        return None
    added, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs:
            added.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
            continue
        if tokens[i] is not None and "_" in tokens[i]:
            added.append(tokens[i])
        i += 1
    return tokens + added


def corpus():
    rng = random.Random(3)
    words = ["a", "b", "c", "d_e", "_", "ä", None]
    posts = [[rng.choice(words) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    posts += [None, [], ["a"], [None], ["a"] * 50_001, ["a", "b"] * 3, ["a", "b"] * 3]
    return posts, [("a", "a"), ("a", "b"), ("b", "c"), ("d_e", "a"), ("_", "_"), ("c", "ä"), ("never", "there"), (None, "a")]


def test_both_forms_equal_the_loop(spark):
    posts, pairs = corpus()
    df = spark.createDataFrame(list(enumerate(posts)), "id long, tokens array<string>")
    table = spark.createDataFrame(pairs, "a string, b string")
    want = {i: by_loop(t, set(pairs) - {(None, "a")}) for i, t in enumerate(posts)}
    for small in (True, False, None):
        got = phrases.append_phrases(df, table, small=small)
        assert got.columns == df.columns
        assert {r.id: r.tokens for r in got.collect()} == want


def test_no_phrases_no_posts_and_another_column(spark):
    df = spark.createDataFrame([(1, ["x", "y_z"], "k")], "id long, tokens array<string>, grown string")
    none = spark.createDataFrame([], "a string, b string")
    row = phrases.append_phrases(df, none, out="grown").first()
    assert row.tokens == ["x", "y_z"] and row.grown == ["x", "y_z", "y_z"]
    assert phrases.append_phrases(df.limit(0), none).count() == 0


def test_posts_do_not_move(spark):
    df = spark.createDataFrame([(1, ["x", "y"])], "id long, tokens array<string>")
    grown = phrases.append_phrases(df, spark.createDataFrame([("x", "y")], "a string, b string"))
    assert "Exchange" not in grown._jdf.queryExecution().executedPlan().toString()
    assert grown.first().tokens == ["x", "y", "x_y"]
