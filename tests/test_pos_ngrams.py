"""Tag n-grams from the distinct words of blocks against those of the whole annotation."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import style
from quillspark.operators import features


def test_pos_ngrams_equal_those_of_the_annotation(spark):
    texts = ["The dog ran. It was 3 km, quickly! Better dogs @user :-)", "", None, "...", "one", "Who said #that? He said it.", "Who said #that? He said it."] * 3
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "id long, text string").coalesce(1)
    want = features.annotate_tokens(df).select("id", F.coalesce(style.pos_ngrams("tokens"), F.array().cast("array<string>")).alias("ngrams"))
    assert sorted(map(tuple, features.with_pos_ngrams(df).collect())) == sorted(map(tuple, want.collect()))
    assert features.with_pos_ngrams(df.limit(0)).count() == 0


def test_tag_runs():
    got = features._tag_runs(np.array([3, 0, 1]), np.array([0, 1, 2, 0]), pa.array(["noun", None, "verb"]), (1, 2))
    assert got.to_pylist() == [["noun", "verb", "noun verb"], [], ["noun"]]
