import random

import numpy as np
import pyarrow as pa

from quillspark.llm import minhash as M

SCHEMA = "doc_id long, text string, class_id string, band string"


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


def brute(rows):
    bags = {i: M.bag_of(t) for i, t in rows if i is not None}
    ids, label = sorted(bags), {i: i for i in bags}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bags[a] and bags[b]:
                common, union = M.overlap(bags[a], bags[b])
                if 5 * common >= 4 * union:
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", "b") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs).collect()}
    assert got == brute(rows)


def test_nulls_empties_and_repeated_rows(spark):
    long = " ".join(f"v{k % 977}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a b"), (6, "b a"), (7, long), (8, long + " z"), (9, "q w e r t y"), (9, "q w e r t y"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, "c", "b") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, None: None}
    kept = M.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 6, 7, 9, None]
    assert M.classes(docs.limit(0)).count() == 0
    assert M.drop_near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_of_variants_is_found_whole(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            text[rng.randrange(len(text))] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "c", "b") for i, t in rows], SCHEMA)
    assert {r["doc_id"]: r["class_id"] for r in M.classes(docs).collect()} == brute(rows)


def test_signatures_are_unbiased_for_weighted_sets():
    texts = ["a b c d e " * 9 + "f g h i j", "a b c d e " * 5 + "f g h i j k l", "a b c d e " * 2]
    words = [t.encode().split() for t in texts]
    errors = []
    for salt in range(40):
        salted = [" ".join(f"{salt}{w.decode()}" for w in ws) for ws in words]
        _, _, signature = M.sign_batch(pa.array(salted))
        bags = [M.bag_of(t) for t in salted]
        for i in range(3):
            for j in range(i):
                common, union = M.overlap(bags[i], bags[j])
                errors.append((signature[i] == signature[j]).mean() - common / union)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.06
