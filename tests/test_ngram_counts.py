"""N-grams and their counts against plain loops."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from quillspark.functions import tokens as T
from quillspark.operators import blocks, ngrams


@pytest.mark.parametrize("size", [10, 1 << 20])
def test_counts_equal_counters(spark, monkeypatch, size):
    rng = random.Random(5)
    rows = [(k // 2 if k % 9 else None, [rng.choice(["a", "b", "é", "", None]) for _ in range(rng.randint(0, 9))]) for k in range(200)]
    rows += [(3, None), (None, []), (500, None), (501, [None])]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "ngrams": pa.array([r[1] for r in rows], pa.list_(pa.string()))})
    counted = pa.Table.from_batches(ngrams._counts_of_posts(iter(table.combine_chunks().to_batches())))
    got = ngrams.ngram_counts(spark.createDataFrame(rows, "id long, ngrams array<string>")).collect()
    want = Counter()
    for i, grams in rows:
        want.update((i, g) for g in grams or () if g is not None)
    assert {(r["id"], r["ngram"]): r["n"] for r in got} == want and len(got) == len(want)
    per_post = [(i, g, n) for i, grams in rows for g, n in Counter(g for g in grams or () if g is not None).items()]
    assert sorted(map(str, per_post)) == sorted(str(tuple(e.values())) for e in counted.to_pylist())


def test_repeated_ngrams_are_counted_before_the_shuffle(spark):
    plan = ngrams.ngram_counts(spark.createDataFrame([(1, ["a", "a"])], "id long, ngrams array<string>"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_char_ngrams_equal_slices(spark, monkeypatch):
    texts = ["", "a", "ab", "abc", None, "ä😀ß c", "x \n\t y", "ééé" * 50, "abcd"]
    for n in (1, 2, 3):
        got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "id long, text string").orderBy("id").select(T.char_ngrams("text", n)).collect()]
        flat = [(" ".join([t[:1], t[-1:]]) if t == "x \n\t y" else t) or "" for t in texts]
        assert got == [[t[k : k + n] for k in range(len(t) - n + 1)] for t in flat]
    sliced = pa.array(["zzz", "abcd", None, "é€"]).slice(1)
    for size in (1, 1 << 20):
        monkeypatch.setattr(T, "RUN_BYTES", size)
        assert T._char_runs(sliced, 2).to_pylist() == [["ab", "bc", "cd"], [], ["é€"]]
    assert T._char_runs(sliced.slice(0, 0), 2).to_pylist() == []


def test_lists_are_counted_where_they_are_made(spark, monkeypatch):
    """No list of n-grams is a column, and the counts are those of the lists."""
    from quillspark.operators import features

    texts = ["", "a", "abc", None, "ä😀ß  c", "The dog ran. It was 3 km, quickly!", "abcabcabc", "The dog ran. The cat ran."] * 3
    df = spark.createDataFrame([(k // 2 if k % 7 else None, t) for k, t in enumerate(texts)], "id long, text string").coalesce(1)
    monkeypatch.setattr(T, "RUN_BYTES", 20)
    for made in (ngrams.with_char_ngrams(df, 3), features.with_pos_ngrams(df)):
        counted = ngrams.ngram_counts(made)
        assert "ngrams" not in counted._jdf.queryExecution().executedPlan().toString()
        want = ngrams.ngram_counts(made.select("id", "ngrams"))  # another table: the lists are made
        assert "ngrams" in want._jdf.queryExecution().executedPlan().toString()
        rows_of = lambda x: sorted(map(str, x.collect()))
        assert rows_of(counted) == rows_of(want) and counted.count()
