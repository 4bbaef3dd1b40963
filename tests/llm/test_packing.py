import random
import zlib

import numpy as np
import pytest

from quillspark.llm import packing as P
from quillspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(tokenizer_path())


def test_parts_give_the_tokenizers_ids(encoder):
    rng = random.Random(1)
    letters = [" ", " ", "\n", "\t", "a", "b'", "'s", "1", ".", "é", " ", "\r", "!", "日", "x"]
    texts = ["", " ", "\n", " a", "a ", "a\n\n\nb", "a\r\nb", "\x1c\x1ca b", "<|endoftext|> hi", "a\x01b \x01c", "don 't"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_closest_fill_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        uses = P.closest_fill(counts, room)
        assert all(uses[n] <= counts[n] for n in uses)
        assert sum(n * u for n, u in uses.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("bucket_rows", [P.BUCKET_ROWS, 3])
def test_every_id_once_without_gaps(spark, encoder, monkeypatch, bucket_rows):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(3)
    texts = [None, "", "a", " ".join(f"word{rng.randrange(500)}" for _ in range(6000))] + [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, "a", "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    packed = P.pack(docs, tokenizer_path(), capacity=64, with_ids=True).cache()
    pieces = packed.collect()
    ends, tokens = {}, {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        tokens.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert max(ends.values()) <= 64 and sorted(ends) == list(range(len(ends)))
    assert len(ends) <= sum(ends.values()) / 64 * 1.05 + 1
    for i, text, _ in rows:
        whole = b"".join(ids for _, ids in sorted(set(tokens[i])))
        want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(whole, "<u4").tolist() == want
    assert sum(r["length"] for r in pieces) == sum(len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    for r in P.sequences(packed).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] == 4 * ends[r["sequence_id"]]
    assert P.pack(docs.limit(0), tokenizer_path()).count() == 0
