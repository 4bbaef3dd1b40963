import hashlib
import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import exactdedup as D
from quillspark.session import materialize


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 5000):
        keys = rng.integers(0, 256, (n, 32), np.uint8)
        found = D.PerfectHash.build(keys)
        assert sorted(found.slots(keys)) == list(range(n))
        others = found.slots(rng.integers(0, 256, (1000, 32), np.uint8))
        assert ((others >= -1) & (others < max(n, 1))).all()
    # digests that agree in half of their bytes
    keys = rng.integers(0, 256, (2000, 32), np.uint8)
    keys[:, :16] = keys[0, :16]
    assert sorted(D.PerfectHash.build(keys).slots(keys)) == list(range(2000))


def plain(rows):
    """(id, keep_id, size, kept, digest) of (id, text) rows, by a dictionary."""
    groups = {}
    for k, (i, text) in enumerate(rows):
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(text or ""), i is not None, i or 0, k))
    out = []
    for digest, group in groups.items():
        best = min(group)
        out += [(rows[g[3]][0], rows[best[3]][0], len(group), g[:3] == best[:3], digest) for g in group]
    return sorted(out, key=str)


def test_dedup_equals_a_dictionary(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \t\n", " ", "é", "é"] + ["hot text"] * 300 + ["ho t\ttext "] * 3
    texts += ["".join(rng.choice(" \nab") for _ in range(rng.randint(1, 12))) for _ in range(600)] + ["long " * 200_000, "long" * 200_000]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("digest"), F.lit("x").alias("row")).repartition(5)
    want = plain(rows)
    monkeypatch.setattr(D, "SHARD_KEYS", 40)  # several shards
    for history in (F.lit(True), F.lit(False), F.crc32(F.col("doc_id").cast("string")) % 2 == 0):
        got = D.dedup(docs, history).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert D.dedup(docs.limit(0), F.lit(True)).count() == 0


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([("b", "x y"), ("b", "x y"), ("a", "xy"), ("b", "x y")], "doc_id string, text string")
    got = D.dedup(docs, F.col("doc_id") == "a").collect()
    assert sum(r["kept"] for r in got) == 1 and {(r["keep_id"], r["group_size"]) for r in got} == {("b", 4)}


def test_new_documents(spark):
    old = spark.createDataFrame([(1, "seen before"), (2, "also seen")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "seenbefore", 1), (4, "new one", 2), (5, "new  one", 3), (6, "other", 4), (None, None, 5)], "doc_id long, text string, seen int")
    index = D.build_index(materialize(D.folded(D.digest_rows(old))))
    got = D.new_documents(new, index)
    assert got.columns == new.columns and sorted(r["seen"] for r in got.collect()) == [3, 4, 5]


def test_slots_hold_whole_digests(spark):
    rows = spark.createDataFrame([(i, os.urandom(8).hex()) for i in range(500)], "doc_id long, text string")
    index = D.build_index(materialize(D.folded(D.digest_rows(rows))), keys=300_000)
    shards = index.table.collect()
    assert index.bits == 3 and 1 < len(shards) <= 8 and sum(len(s["digests"]) for s in shards) == 500 * 32
    for s in shards:
        digests = np.frombuffer(s["digests"], np.uint8).reshape(-1, 32)
        found = D.PerfectHash([np.frombuffer(b, np.uint64) for b in s["levels"]])
        assert found.slots(digests).tolist() == list(range(len(digests))) and len(s["best"]) == len(s["counts"]) == len(digests)
        assert set(digests[:, 0] >> 5) == {s["shard"]}
