import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import collocate as C


def plain(rows, longest, least, top):
    """All phrases by counting every window, and every longer candidate looked through."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        found = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(100 * b >= 100 * a and len(q) > len(p) and inside(q) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def test_words_and_pieces():
    texts = pa.array(["A b,c\td", "", "É. e", "\n\n", "last"])
    words, at = C.cut_words(texts)
    assert words.to_pylist() == ["a", "b", "c", "d", "É", "e", "last"]
    assert (np.diff(at) == 1).tolist() == [True, False, True, False, False, False]


def test_collocations_equal_a_full_count(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["new", "York", "city", "of", "the", "a\tb", "Ünder", "way", "x", "rare"]
    weights = [9, 9, 5, 20, 20, 2, 3, 3, 1, 1]
    rows = [(None, None), ("en", ""), ("en", " \t"), ("de", "...!?"), (None, "new york new york new york")]
    for k in range(300):
        words = rng.choices(vocabulary, weights, k=rng.randint(1, 40))
        if rng.random() < 0.4:
            words += ["in", "the", "long", "run", "indeed"]
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "  ", ". ", "\n", ","]) for w in words)))
    rows.append(("en", "ha " * 3000))  # overlaps count
    monkeypatch.setattr(C, "BLOCK", 4000)
    docs = spark.createDataFrame([(k, lang, t, "c") for k, (lang, t) in enumerate(rows)], "block long, lang string, text string, ids string").repartition(4)
    for longest, least, top, held in ((5, 5, 2000, 10**6), (5, 5, 2000, 0), (3, 40, 7, 60), (2, 3, 50, 0)):
        monkeypatch.setattr(C, "IN_MEMORY", held)
        got = C.collocations(docs, longest=longest, min_count=least, top=top).collect()
        assert sorted(map(tuple, got)) == plain(rows, longest, least, top)
    assert C.collocations(docs.limit(0)).count() == 0
    assert C.collocations(docs, min_count=10**6).count() == 0


def test_scores_beyond_64_bits(spark):
    rng = random.Random(6)
    rows = [(a, a * rng.randint(1, 10**6), a + rng.randint(0, 10**9), a + rng.randint(0, 10**12)) for a in (rng.randint(100, 10**11) for _ in range(300))]
    rows.append((10**16, 10**17, 10**16, 10**16 + 1))
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("a", "n", "l", "r", C.exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got)


def test_streams_are_in_prefix_order(spark):
    docs = spark.createDataFrame([("en", "a b c " * 50)], "lang string, text string")
    _, streams = C.count_streams(docs, min_count=10)
    assert [s.count() for s in streams] == [3, 3, 3, 3, 3]
    ids = [r["id"] for r in streams[2].orderBy("prefix", "suffix").collect()]
    assert ids == sorted(ids)
