import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import blocks as B
from quillspark.operators import ngrams, term_models


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["hot"] * 12 + [f"w{k}" for k in range(30)]
    rows = [(k, rng.choice(["a", "b"]), rng.choices(vocabulary, k=rng.randint(0, 15))) for k in range(n)]
    rows = [(i, c, t + ["good"] * (c == "a" and rng.random() < 0.5)) for i, c, t in rows]
    return rows + [(None, "a", ["hot", None, "é"]), (7, "b", None), (7, "b", ["hot"])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label string, tokens array<string>").repartition(3)


def test_numbers_come_back():
    for numbers in ([], [0], [1, 2**32 - 1, 5], list(range(999))):
        assert B.unpack(B.pack(np.array(numbers))).tolist() == numbers


def test_index_has_every_place_once(spark):
    terms = spark.createDataFrame([(f"t{k}", k % 7) for k in range(1000)], "term string, total long").repartition(7)
    got = [(r["total"], r["term"]) for r in B.index_terms(terms).orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 1000
    assert [r["place"] for r in B.index_terms(terms).orderBy("place").collect()] == list(range(1000))
    assert B.index_terms(terms.limit(0)).count() == 0


def test_count_vectors_equal_counters(spark, monkeypatch):
    rows = corpus()
    for size in (60, 1 << 20):
        monkeypatch.setattr(B, "BLOCK_BYTES", size)
        blocks = B.term_blocks(frame(spark, rows), "tokens", ["id", "label"])
        index = B.index_terms(B.term_totals(blocks))
        place = {r["term"]: r["place"] for r in index.collect()}
        assert {r["term"]: r["total"] for r in index.collect()} == Counter(t for r in rows for t in r[2] or () if t is not None)
        got = sorted(((r["id"], r["label"], list(zip(r["places"], r["terms"], r["values"], strict=True))) for r in B.count_vectors(blocks, index).collect()), key=str)
        want = [(i, c, sorted((place[t], t, float(n)) for t, n in Counter(x for x in ts or () if x is not None).items())) for i, c, ts in rows]
        assert got == sorted(want, key=str)
        known = index.where("place < 5")
        assert all(p < 5 for r in B.count_vectors(blocks, known).collect() for p in r["places"])
    empty = B.term_blocks(frame(spark, rows).limit(0), "tokens", ["id"])
    assert B.count_vectors(empty, B.index_terms(B.term_totals(empty))).count() == 0


def test_assembled_entries(spark):
    blocks = B.term_blocks(frame(spark, [(1, "a", ["x", "y", "x"]), (2, "b", [])]).select("*", (F.col("id") - 1).cast("double").alias("f")), "tokens", ["id", "f"])
    got = ngrams.assembled_entries(B.count_vectors(blocks, B.index_terms(B.term_totals(blocks))), ["f"], "t:")
    assert sorted(map(tuple, got.collect())) == [(1, 1, "t:x", 2.0), (1, 2, "t:y", 1.0), (2, 0, "f", 1.0)]


def test_terms_are_replaced(spark):
    rows = corpus()
    table = spark.createDataFrame([("hot", "warm"), ("w1", "w2"), ("w2", "w3"), ("absent", "x")], "term string, lemma string")
    got = B.replace_terms(B.term_blocks(frame(spark, rows), "tokens", ["id"]), table, "lemma").collect()
    new = {"hot": "warm", "w1": "w2", "w2": "w3"}
    want = [(i, [new.get(t, t) for t in ts or () if t is not None]) for i, _, ts in rows]
    assert sorted(((r["id"], r["terms"]) for r in got), key=str) == sorted(want, key=str)


def test_squared_hinge_equals_a_dense_solution(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 200)
    rows = corpus(80, 3)
    blocks = B.term_blocks(frame(spark, rows), "tokens", ["id", "label"])
    model = term_models.SquaredHinge.fit(blocks, "label", "a", c=0.5, tol=1e-7)
    joined = term_models.SquaredHinge.fit(blocks, "label", "a", c=0.5, tol=0.1, in_memory=0)
    rough = {r["term"]: r["weight"] for r in term_models.SquaredHinge.fit(blocks, "label", "a", c=0.5, tol=0.1).weights.collect()}
    assert all(abs(r["weight"] - rough[r["term"]]) < 1e-9 for r in joined.weights.collect())
    weights = {r["term"]: r["weight"] for r in model.weights.collect()}
    terms = sorted(weights)
    x = np.array([[Counter(t or ())[w] for w in terms] + [1] for _, _, t in rows], float)
    y = np.array([1.0 if c == "a" else -1.0 for _, c, _ in rows])
    w = np.zeros(x.shape[1])
    for _ in range(100):  # generalised Newton steps
        on = y * (x @ w) < 1
        grad = w - 2 * 0.5 * x[on].T @ (y[on] * (1 - y[on] * (x[on] @ w)))
        w -= np.linalg.solve(np.eye(len(w)) + x[on].T @ x[on], grad)
    assert np.abs(w - np.array([weights[t] for t in terms] + [model.intercept])).max() < 1e-4 and 5 < model.steps < 200
    scores = sorted((r["id"] or -1, round(r["score"], 3)) for r in model.predict(blocks).collect())
    assert np.allclose(scores, sorted((i or -1, round(s, 3)) for (i, _, _), s in zip(rows, x @ w, strict=True)), atol=2e-3)


def test_squared_hinge_scans_packed_blocks(spark, monkeypatch):
    """In memory every scan of a step reads numbers as bytes; they and the written arrays give the same sums."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 200)
    blocks = B.term_blocks(frame(spark, corpus(60, 5)), "tokens", ["id", "label"])
    matrix = term_models._matrix(blocks, B.index_terms(B.term_totals(blocks)), "label", "a")
    places = np.unique(np.concatenate([r["places"] for r in matrix.select("places").collect()]))
    packed = term_models._packed(matrix, places)
    assert {kind for _, kind in packed.dtypes} == {"binary"}
    w, d = (np.random.default_rng(k).normal(size=len(places)) for k in (1, 2))
    value = dict(zip(places.tolist(), zip(w, d, strict=True), strict=True))
    losses, slopes = np.zeros(2), Counter()
    for r in matrix.collect():
        for y, start, end in zip(r["y"], [0, *r["ends"]], r["ends"], strict=False):
            entries = [(r["places"][k], n) for k, n in zip(r["keys"][start:end], r["values"][start:end], strict=True)]
            z, dz = (sum(n * value[p][side] for p, n in entries) for side in (0, 1))
            losses += [max(0, 1 - y * (z + t * dz)) ** 2 for t in (0.5, 2.0)]
            for p, n in entries:
                slopes[p] -= 2 * 0.3 * y * max(0, 1 - y * (z + 0.5 * dz)) * n
    vectors = spark.sparkContext.broadcast((w, d))
    assert np.allclose(term_models._packed_losses(packed, vectors, np.array([0.5, 2.0])), losses)
    found = term_models._packed_gradient(packed, vectors, 0.5, 0.3).to_pydict()
    assert np.allclose([slopes[places[p]] for p in found["place"]], found["gx"])
    assert {places[p] for p in found["place"]} == {p for p, g in slopes.items() if g}
