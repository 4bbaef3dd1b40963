"""Many-key neighbours: exact form against a loop, bucketed form by recall."""

import numpy as np
import pytest

from quillspark.catalog import topical
from quillspark.operators import vectors

SCHEMA = "word long, vector array<float>"


def plain(words, asked, k):
    """Nearest entries by a loop over all pairs."""
    good = {w: np.array(v, float) for w, v in words if w is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in asked:
        if q in good:
            a = good[q]
            close = [(-(a @ b) / np.sqrt(a @ a) / np.sqrt(b @ b), w) for w, b in good.items() if w != q and len(b) == len(a)]
            out[q] = [(w, round(-c, 9)) for c, w in sorted((round(c, 12), w) for c, w in close)[:k]]
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["neighbour"], round(r["similarity"], 9)))
    return out


def hot(n=400):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-9, 10, 6).astype(float).tolist()) for i in range(n)]
    rows = [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 3.0]) if i % 3 == 0 else (i, v) for i, v in rows]  # a third are copies
    odd = [(None, [1.0] * 6), (1001, None), (1002, []), (1003, [0.0] * 6), (1004, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
           (1005, [float("nan")] + [1.0] * 5), (1006, [float("inf")] + [1.0] * 5), (1007, [1.0, 2.0]), (1008, [2.0, 1.0])]
    return rows + odd + rows[:20]  # repeated rows count once


def test_nearest_equals_a_loop(spark, monkeypatch):
    words = hot()
    df = spark.createDataFrame(words, SCHEMA)
    asked = df.where("word % 10 = 0 or word > 1000")
    want = plain(words, [w for w, _ in words if w is not None and (w % 10 == 0 or w > 1000)], 4)
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 100)  # several blocks
    assert lists(vectors.nearest(df, asked, 4)) == want


@pytest.mark.parametrize("small", [True, False])
def test_neighbours_with_one_bit_equal_a_loop(spark, monkeypatch, small):
    # one bit and its flip are both halves of the space, so every pair is met
    words = hot()
    df = spark.createDataFrame(words, SCHEMA)
    asked = df.where("word % 10 = 0 or word > 1000")
    want = plain(words, [w for w, _ in words if w is not None and (w % 10 == 0 or w > 1000)], 4)
    monkeypatch.setattr(vectors, "is_small", lambda *_, **__: small)
    assert lists(vectors.neighbours(df, asked, 4, bits=1)) == want


def test_empty_tables(spark):
    df, none = spark.createDataFrame(hot(), SCHEMA), spark.createDataFrame([], SCHEMA)
    for form in (vectors.nearest, vectors.neighbours):
        assert form(df, none).count() == 0 and form(none, df).count() == 0


def test_recall_on_the_given_vectors(spark):
    exact = {(r["query"], r["neighbour"]) for r in topical.nearest_words(spark, "/root/testdata/sf0.1").collect()}
    found = {(r["query"], r["neighbour"]) for r in topical.similar_words_many(spark, "/root/testdata/sf0.1").collect()}
    assert len(exact) == len(found) and len(exact & found) >= 0.9 * len(exact)


def test_recall_among_many_clusters(spark):
    """Buckets of a small share of the rows: the nearest of clustered vectors are still found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 32))
    rows = [(i, (centres[i % 400] + 0.15 * rng.normal(size=32)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.where("word % 100 = 0")
    exact = {(r["query"], r["neighbour"]) for r in vectors.nearest(df, asked).collect()}
    found = {(r["query"], r["neighbour"]) for r in vectors.neighbours(df, asked, bits=8).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_bits_follow_the_recall_of_a_sample(spark, monkeypatch):
    """Vectors that are noise: buckets as small as the row count asks for would miss most neighbours."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(2000)], SCHEMA)
    asked = df.where("word % 20 = 0")
    monkeypatch.setattr(vectors, "BUCKET_ROWS", 8)
    exact = {(r["query"], r["neighbour"]) for r in vectors.nearest(df, asked).collect()}
    share = [len(exact & {(r["query"], r["neighbour"]) for r in vectors.neighbours(df, asked, bits=b).collect()}) / len(exact) for b in (8, None)]
    assert share[0] < 0.9 <= share[1]
