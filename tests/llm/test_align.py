import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import align as A
from quillspark.llm.queries import vocabulary


@pytest.fixture(scope="module")
def files():
    return vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair(files):
    return A.Pair(*files)


def texts(n, seed=1):
    rng = random.Random(seed)
    letters = [" ", " ", " ", "\n", "\t", "a", "in", "the", "b'", "'s", "12", ".", "\xe9", "\xf6", "\r", "!", "日本", "x", "\x1c", "\0", "\xa0", "　",
               "<s>", "<0x0A>", "<|endoftext|>", "ing", "tion", "▁", "\U0001f600", "​", "ﬁ", "́", "\x85", " "]
    weights = [1 if c in "\r▁" else 6 for c in letters]
    return ["".join(rng.choices(letters, weights, k=rng.randint(1, 25))) for _ in range(n)]


def test_groups_equal_common_ends():
    rng = random.Random(3)
    for _ in range(500):
        last = rng.randint(1, 300)
        a, b = (sorted({last, *rng.sample(range(1, last + 1), rng.randint(0, last))}) for _ in range(2))
        if rng.random() < 0.3:
            b = list(a)
        cut_a, cut_b = A.diagonal_groups(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert cut_a.tolist() == [a.index(e) + 1 for e in common] and cut_b.tolist() == [b.index(e) + 1 for e in common]
    assert len(A.diagonal_groups(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0
    same = np.cumsum(np.ones(100_000, np.int64))
    assert A.diagonal_groups(same, same)[0].tolist() == list(range(1, 100_001))


def test_parts_give_the_tokenizers_ids(pair):
    for text in [" ", "a ", " a", "  ", "\n", "a\n\nb", "\n a\r\n", *texts(4000)]:
        if A.MARK in text:
            continue
        parts = pair.parts(" " + text)
        assert "".join(parts) == " " + text
        assert sum(pair.encode_a(parts), []) == pair.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert sum(pair.encode_b(parts), []) == pair.b.encode(text), repr(text)


def brute(pair, rows):
    """Alignment by the definitions: token by token, all pairs of tokens of a group compared."""
    done, count = [], Counter()
    for i, text in rows:
        a, b = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        spans = []
        for ids, s in ((a, pair.spelt_a), (b, pair.spelt_b)):
            sizes = s.size[ids] if ids else np.zeros(0, np.int64)
            spans.append((np.cumsum(sizes) - sizes, np.cumsum(sizes), bytes(s.spell(np.array(ids, np.int64)))))
        if not text or any(s[2] != (" " + text).encode() for s in spans):
            done.append((i, [], [], [], []))
            continue
        links = [(x, y) for k, x in enumerate(a) for m, y in enumerate(b) if max(spans[0][0][k], spans[1][0][m]) < min(spans[0][1][k], spans[1][1][m])]
        ends = [set(s[1].tolist()) for s in spans]
        groups, x, y = [], 0, 0
        for e in sorted(ends[0] & ends[1]):
            u, v = int(np.searchsorted(spans[0][1], e)) + 1, int(np.searchsorted(spans[1][1], e)) + 1
            groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
            x, y = u, v
        count.update(links)
        done.append((i, a, b, groups, links))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return sorted(
        ((i, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
          hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for i, a, b, groups, links in done), key=str)


def test_alignment_equals_brute_force(spark, pair, files, monkeypatch):
    rows = [(None, "null id"), (0, None), (1, ""), (2, " "), (3, "the the the"), (3, "the the the"), (4, "a▁b")]
    rows += list(enumerate(texts(300, 7), 10)) + [(1000, "word ing\n" * 3000)]
    rows += [(2000 + k, " ".join(random.Random(k).choices(["often", "seldom", "hyperbole", "x1", "Straße", "naïve."], k=40))) for k in range(40)]
    monkeypatch.setattr(A, "REMEMBERED", 500)
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_links int, block string").repartition(4)
    small = [r for r in rows if r[0] != 1000]
    got = A.alignment(docs.where("doc_id IS NULL OR doc_id <> 1000"), *files).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(pair, small)
    assert A.alignment(docs, *files).where("doc_id = 1000").first()["n_groups"] > 3000
    assert A.alignment(docs.limit(0), *files).count() == 0
    assert A.alignment(docs.where("doc_id < 2"), *files).agg({"count_sum": "sum"}).first()[0] == 0


def test_packed_numbers_come_back():
    for values in ([], [0], [5, 2**32 - 1, 0, 77], list(range(1000))):
        assert A.unpacked(A.packed(np.array(values, np.int64))).tolist() == values
