"""Phrase detection and phrase tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Observation, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.rows import explode_rows
from quillspark.functions import constants as C
from quillspark.functions.text import string_array
from quillspark.operators.joins import is_small, term_join
from quillspark.session import materialize


def _pairs(tokens_col: str):
    tokens = F.col(tokens_col)
    return F.when(
        F.size(tokens) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - 1),
            lambda i: F.struct(
                i.alias("i"), F.element_at(tokens, i).alias("a"), F.element_at(tokens, i + 1).alias("b")
            ),
        ),
    )


def phrase_scores(
    df: DataFrame,
    tokens_col: str = "tokens",
    min_count: int = C.PHRASE_MIN_COUNT,
    threshold: float = C.PHRASE_THRESHOLD,
) -> DataFrame:
    """(a, b, n, score) of neighbouring tokens that form a phrase.

    score = (n_ab - min_count) * V / (n_a * n_b), kept where n_ab >= min_count
    and score > threshold; V is the number of distinct tokens and pairs.  Both
    tokens of a kept pair are at least as frequent as the pair, so only tokens
    with ``min_count`` occurrences take part in the joins.

    Only the frequent rows of the two count tables are written; how many rows
    there are in all is observed while they are.
    """
    counted = Observation(), Observation()
    every = F.count(F.lit(1)).alias("n")
    singles = explode_rows(df, [], tokens_col, "t").groupBy("t").agg(every)
    pairs = explode_rows(df, [], _pairs(tokens_col), "p").groupBy("p.a", "p.b").agg(every)
    frequent = materialize(singles.observe(counted[0], every).where(F.col("n") >= min_count), "token-counts")
    candidates = materialize(pairs.observe(counted[1], every).where(F.col("n") >= min_count), "pair-counts")
    vocabulary = F.lit(sum(o.get["n"] for o in counted))
    first = frequent.select(F.col("t").alias("a"), F.col("n").alias("n_a"))
    second = frequent.select(F.col("t").alias("b"), F.col("n").alias("n_b"))
    joined = term_join(candidates, first, "a")
    joined = term_join(joined, second, "b")
    score = (F.col("n") - min_count) * vocabulary.cast("double") / F.col("n_a") / F.col("n_b")
    return joined.select("a", "b", "n", score.alias("score")).where(F.col("score") > threshold)


def append_phrases(
    df: DataFrame,
    phrases: DataFrame,
    tokens_col: str = "tokens",
    id_col: str = "id",
    out: str | None = None,
    *,
    small: bool | None = None,
) -> DataFrame:
    """Append ``a_b`` tokens to every post; the single tokens stay.

    Found left to right, and a token belongs to one phrase at most.  A token
    that holds ``_`` itself and is in no phrase is appended again.  A null list
    stays null, and a null token is in no phrase.

    Up to the checked size of a broadcast the phrases are carried to the posts:
    a column of token lists becomes another one and no post moves.  Beyond it
    places and phrases are joined, and then ``id_col`` must be unique.
    """
    out = out or tokens_col
    pairs = phrases.select("a", "b")
    if is_small(pairs) if small is None else small:
        rest = [c for c in df.columns if c != out]
        return df.select(*rest, _fold(pairs)(F.col(tokens_col)).alias(out))
    return _append_joined(df, pairs, tokens_col, id_col, out)


def _fold(pairs: DataFrame):
    """Function of a column of token lists that appends the phrases of a small table."""
    listed = pairs.dropna().toArrow()
    first, second = (pc.unique(listed[c].combine_chunks()) for c in ("a", "b"))
    codes = [pc.index_in(listed[c], v).to_numpy() for c, v in (("a", first), ("b", second))]
    keys = np.unique(codes[0].astype(np.int64) * max(len(second), 1) + codes[1])
    shared = pairs.sparkSession.sparkContext.broadcast((first, second, keys))

    @F.arrow_udf("array<string>")
    def appended(lists: pa.Array) -> pa.Array:
        return _append(lists, *shared.value)

    return appended


def _append(lists: pa.ListArray, first: pa.Array, second: pa.Array, keys: np.ndarray) -> pa.ListArray:
    """All lists at once: places where a phrase starts, every second of a run of them, then the new values in their order."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    tokens = lists.flatten()
    n = len(tokens)
    starts = np.zeros(n, bool)
    if n and len(keys):
        a, b = (pc.fill_null(pc.index_in(tokens, v, skip_nulls=True), -1).to_numpy(zero_copy_only=False) for v in (first, second))
        key = a[:-1].astype(np.int64) * len(second) + b[1:]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        starts[:-1] = (a[:-1] >= 0) & (b[1:] >= 0) & (keys[place] == key)
        starts[ends[(ends > 0) & (ends <= n)] - 1] = False
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(starts, -1, at)) if n else at
    chosen = starts & ((at - before) % 2 == 1)
    covered = chosen.copy()
    covered[1:] |= chosen[:-1]
    marked = pc.fill_null(pc.match_substring(tokens, "_"), False).to_numpy(zero_copy_only=False)
    added = chosen | (marked & ~covered)
    where = np.flatnonzero(added)
    joined = pc.binary_join_element_wise(tokens.take(pa.array(where)), tokens.take(pa.array(np.minimum(where + 1, max(n - 1, 0)))), "_")
    values = pc.if_else(pa.array(chosen[where]), joined, tokens.take(pa.array(where)))
    post = np.repeat(np.arange(len(lists)), sizes)
    more = np.bincount(post[where], minlength=len(lists))
    shift = np.cumsum(more) - more
    order = np.empty(n + len(where), np.int64)
    order[at + shift[post]] = at
    order[ends[post[where]] + np.arange(len(where))] = n + np.arange(len(where))
    bounds = np.concatenate(([0], ends + np.cumsum(more)))
    grown = pa.concat_arrays([tokens.cast(pa.string()), values.cast(pa.string())]).take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), grown, mask=pc.is_null(lists))


def _append_joined(df: DataFrame, pairs: DataFrame, tokens_col: str, id_col: str, out: str) -> DataFrame:
    """The same for a phrase table of any size."""
    tokens = F.col(tokens_col)
    places = explode_rows(df, [id_col], _pairs(tokens_col), "p").select(id_col, "p.i", "p.a", "p.b")
    found = term_join(places, pairs, ["a", "b"], "left_semi", small=False)
    # candidates at neighbouring places overlap; of such a run every second one is taken, from the first
    in_post = Window.partitionBy(id_col).orderBy("i")
    in_run = Window.partitionBy(id_col, "run").orderBy("i")
    chosen = found.select(id_col, "i", (F.col("i") - F.row_number().over(in_post)).alias("run")).withColumn(
        "k", F.row_number().over(in_run)
    )
    starts = chosen.where("k % 2 = 1").groupBy(id_col).agg(F.sort_array(F.collect_list("i")).alias("_at"))
    joined = df.join(starts, id_col, "left").withColumn(
        "_taken", F.coalesce("_at", F.array().cast("array<int>"))
    )
    phrase = F.transform(
        "_taken",
        lambda i: F.struct(
            i.alias("i"), F.concat(F.element_at(tokens, i), F.lit("_"), F.element_at(tokens, i + 1)).alias("t")
        ),
    )
    numbered = F.transform(tokens, lambda t, j: F.struct((j + 1).cast("int").alias("i"), t.alias("t")))
    holding = F.transform(F.filter(numbered, lambda x: x["t"].contains("_")), lambda x: x["i"])
    covered = F.concat("_taken", F.transform("_taken", lambda i: i + 1))
    lonely = F.transform(
        F.array_except(holding, covered), lambda i: F.struct(i.alias("i"), F.element_at(tokens, i).alias("t"))
    )
    ordered = F.sort_array(F.concat(phrase, lonely))
    appended = F.concat(tokens, F.coalesce(F.transform(ordered, lambda x: x["t"]), string_array(())))
    rest = [c for c in df.columns if c != out]
    return joined.select(*rest, appended.alias(out))
