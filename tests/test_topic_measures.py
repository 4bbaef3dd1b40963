"""Coherence with many listed terms and topic distances, against brute force."""

import math
import random

import pytest

from quillspark.operators import topics
from quillspark.sources import readers


def corpus(n_terms, seed=1):
    rng = random.Random(seed)
    terms = [f"t{k}" for k in range(n_terms)]
    posts = [[rng.choice(terms[: 1 + n_terms * (i % 4 + 1) // 4] + ["x", "y"]) for _ in range(rng.randint(0, 60))] for i in range(80)]
    return terms, posts


def frames(spark, terms, posts):
    df = spark.createDataFrame(list(enumerate(posts)), "id long, tokens array<string>")
    return df, spark.createDataFrame([(0, k + 1, t, 1.0) for k, t in enumerate(terms)], "topic int, rank int, term string, weight double")


@pytest.mark.parametrize("n_terms", [5, 70, 130])
def test_umass_has_no_limit_of_terms(spark, n_terms):
    terms, posts = corpus(n_terms)
    sets = [set(p) for p in posts]
    values = []
    for m in range(n_terms):
        for low in range(m):
            single = sum(terms[low] in s for s in sets)
            if single:
                values.append(math.log((sum(terms[low] in s and terms[m] in s for s in sets) + 1) / single))
    got = topics.umass_coherence(*frames(spark, terms, posts)).first()["coherence"]
    assert got == pytest.approx(sum(values) / len(values), abs=1e-9)


@pytest.mark.parametrize(("n_terms", "window"), [(5, 7), (70, 10), (130, 110)])
def test_window_measure_equals_windows_one_by_one(spark, n_terms, window):
    terms, posts = corpus(n_terms)
    windows = [set(p[k : k + window]) for p in posts for k in range(max(len(p) - window, 0) + 1)]
    n = len(windows)
    p = {(a, b): sum(a in w and b in w for w in windows) / n for a in terms for b in terms}

    def npmi(a, b):
        if not p[a, a] or not p[b, b]:
            return 0.0
        joint = p[a, b] + 1e-12
        return math.log(joint / (p[a, a] * p[b, b])) / -math.log(joint)

    rows = [[npmi(a, b) for b in terms] for a in terms]
    whole = [sum(r[k] for r in rows) for k in range(n_terms)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cos = [sum(x * y for x, y in zip(r, whole, strict=True)) / (norm(r) * norm(whole)) if norm(r) and norm(whole) else 0.0 for r in rows]
    got = topics.npmi_coherence(*frames(spark, terms, posts), window=window).first()["coherence"]
    assert got == pytest.approx(sum(cos) / n_terms, abs=1e-9)


def test_topic_distances_count_terms_of_one_side(spark):
    schema = "topic int, term string, weight double"
    left = spark.createDataFrame([(0, "x", 0.5), (0, "y", 0.5), (1, "x", 1.0), (1, "z", 0.0)], schema)
    right = spark.createDataFrame([(0, "x", 0.1), (0, "z", 0.9), (1, "w", 1.0)], schema)
    got = {d: {(r[0], r[1]): r[2] for r in topics.topic_diff(left, right, d).collect()} for d in ("hellinger", "jaccard", "kullback_leibler")}
    assert got["hellinger"][0, 0] == pytest.approx(0.8811, abs=1e-4) and got["hellinger"][0, 1] == pytest.approx(1.0)
    assert got["jaccard"][0, 0] == pytest.approx(2 / 3) and got["jaccard"][1, 1] == 1.0
    assert got["kullback_leibler"][0, 0] == math.inf and got["kullback_leibler"][1, 0] == pytest.approx(math.log(10))


def test_vectors_of_one_value_stay(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert readers.parse_vectors(lines("a 1.5", "b 2")).count() == 2
    assert {r["word"] for r in readers.parse_vectors(lines("2 3", "a 1 2 3", "b 4 5 6 ")).collect()} == {"a", "b"}


def test_window_measure_is_linear_in_a_post(spark):
    """A post of 20,000 hits; comparing each run of windows with all hits took their product."""
    posts = [[f"t{(k * k) % 7 % 4}" if k % 5 else "x" for k in range(20_000)]]
    got = topics.npmi_coherence(*frames(spark, ["t0", "t1", "t2", "t3"], posts), window=3).first()["coherence"]
    windows = [set(posts[0][k : k + 3]) for k in range(20_000 - 2)]
    terms = ["t0", "t1", "t2", "t3"]
    p = {(a, b): sum(a in w and b in w for w in windows) / len(windows) for a in terms for b in terms}
    rows = [[math.log((p[a, b] + 1e-12) / (p[a, a] * p[b, b])) / -math.log(p[a, b] + 1e-12) if p[a, a] and p[b, b] else 0.0 for b in terms] for a in terms]
    whole = [sum(r[k] for r in rows) for k in range(4)]
    cos = [sum(x * y for x, y in zip(r, whole, strict=True)) / (math.hypot(*r) * math.hypot(*whole)) if any(r) else 0.0 for r in rows]
    assert got == pytest.approx(sum(cos) / 4, abs=1e-9)


def bags(spark):
    rng = random.Random(3)
    posts = [[f"w{int(rng.paretovariate(1)) % 60}" for _ in range(rng.randint(0, 40))] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(posts)), "id long, tokens array<string>").cache()
    return posts, df, topics.fit_bag_of_words(df, "tokens", 5, 0.9)


def test_vocabulary_is_counted_without_cached_posts(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    monkeypatch.setattr(CountVectorizer, "fit", lambda *_: pytest.fail("Spark's fit caches the tokens of all posts"))
    posts, _, model = bags(spark)
    n, seen = {}, {}
    for post in posts:
        for t in post:
            n[t] = n.get(t, 0) + 1
        for t in set(post):
            seen[t] = seen.get(t, 0) + 1
    assert model.vocabulary == sorted((t for t in n if 5 <= seen[t] <= 0.9 * len(posts)), key=lambda t: (-n[t], t))


@pytest.mark.parametrize("k", [2, 5])
def test_perplexity_equals_spark_without_its_cost_per_post(spark, monkeypatch, k):
    _, df, vectorizer = bags(spark)
    bow = vectorizer.transform(df)
    model = topics.train_lda(bow, k)
    expected = -model.logPerplexity(bow)
    monkeypatch.setattr(type(model), "logPerplexity", lambda *_: pytest.fail("posts times vocabulary"))
    assert topics.log_perplexity(model, bow) == pytest.approx(expected, abs=1e-4)
