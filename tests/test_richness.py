"""Vocabulary richness and distinct counts that merge, against plain counting."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import features, sketches


def by_counting(words):
    times = Counter(words)
    n, v = len(words), len(times)
    if not n:
        return [None] * 5
    spectrum = Counter(times.values())
    s2 = sum(k * k * m for k, m in spectrum.items())
    return [
        n ** (v**-0.172), 1e4 * (s2 - n) / n**2, 100 * math.log(n) / (1 - spectrum[1] / v) if spectrum[1] < v else None,
        spectrum[2] / v, (s2 - n) / (n * (n - 1)) if n > 1 else None,
    ]


def test_richness_equals_counting(spark):
    texts = ["a b a c a b Dd dd", "", "one", "one two", "x " * 3000 + "y", "12 !! ...", None, "the cat the CAT the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: list(r)[1:] for r in features.richness(df).collect()}
    for i, text in enumerate(texts):
        words = [w.lower() for w in (text or "").split() if w.isalpha()]
        for value, want in zip(got[i], by_counting(words), strict=True):
            assert value == want if want is None else value == pytest.approx(want, rel=1e-9), text
    assert features.richness(df.limit(0)).count() == 0
    assert "Exchange" not in features.richness(df)._jdf.queryExecution().executedPlan().toString()


def test_united_sketches_count_each_value_once(spark):
    rows = spark.range(0, 60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, "a").alias("language"), (F.col("id") % 20_000).alias("user"))
    daily = sketches.distinct_sketches(rows, ["day", "language"], "user")
    bound = 6 * sketches.relative_error()
    for keys in (["language"], ["day"], []):
        exact = {tuple(r[k] for k in keys): (r.n, r.d) for r in rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("user").alias("d")).collect()}
        got = {tuple(r[k] for k in keys): (r.n, r.n_distinct) for r in sketches.estimated(sketches.unite_sketches(daily, keys)).collect()}
        assert got.keys() == exact.keys()
        for key, (n, d) in exact.items():
            assert got[key][0] == n and abs(got[key][1] - d) <= bound * d


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([("x", None), ("x", None), ("y", 1)], "k string, v long")
    got = {r.k: (r.n, r.n_distinct) for r in sketches.estimated(sketches.distinct_sketches(rows, ["k"], "v")).collect()}
    assert got == {"x": (2, 0), "y": (1, 1)}
    assert sketches.distinct_sketches(rows.limit(0), ["k"], "v").count() == 0
