"""Feature tables: annotation, feature extraction, feature report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as ST

from quillspark.functions.rows import count_where_made, explode_rows
from quillspark.functions import constants as C
from quillspark.functions import patterns as P
from quillspark.functions import style
from quillspark.functions import tokens as T
from quillspark.operators.blocks import encode, look_up, unpack
from quillspark.operators.joins import term_join
from quillspark.session import materialize

#: Readability scores on request.
READABILITY_EXTRA = ["automated_readability", "coleman_liau", "gunning_fog", "dale_chall"]
LEVELS = ("character_level", "word_level", "sentence_level", "document_level")


def annotate_tokens(
    df: DataFrame,
    text_col: str = "text",
    out: str = "tokens",
    *,
    annotator: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None,
    **rules,
) -> DataFrame:
    """Add the token annotation.  Every level below reads this one column.

    By default a column expression with the rule tagger.  ``annotator`` is the
    hook for a tagger of your own: it gets Arrow batches of the rows and yields
    them with the annotation column added.
    """
    if annotator is None:
        return df.withColumn(out, T.annotate(text_col, **rules))
    schema = ST.StructType(df.schema.fields + [ST.StructField(out, ST.ArrayType(_annotation_struct()))])
    return df.mapInPandas(annotator, schema)


def _annotation_struct() -> ST.StructType:
    flag = ("is_punct", "is_space", "is_alpha", "like_num", "is_stop")
    fields = [("text", ST.StringType()), ("sent_id", ST.IntegerType())]
    fields += [(f, ST.BooleanType()) for f in flag]
    fields += [(f, ST.StringType()) for f in ("pos", "dep", "tense", "degree")]
    return ST.StructType([ST.StructField(n, t) for n, t in fields])


def retag(df: DataFrame, tag_lexicon: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Replace ``pos``, ``tense`` and ``degree`` by those of a (word, pos, tense, degree) table where it knows the word.

    A post is taken apart into tokens and put together again under its id.
    """
    exploded = df.select(id_col, F.posexplode(tokens_col).alias("i", "tok")).withColumn("word", F.lower("tok.text"))
    lex = tag_lexicon.select("word", F.struct("pos", "tense", "degree").alias("tag"))
    tagged = term_join(exploded, lex, "word", "left")
    new = F.col("tok")
    for field in ("pos", "tense", "degree"):
        new = new.withField(
            field, F.when(F.col("tag").isNotNull(), F.col(f"tag.{field}")).otherwise(F.col(f"tok.{field}"))
        )
    rebuilt = tagged.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("i", new.alias("tok")))).alias("_t"))
    rebuilt = rebuilt.select(id_col, F.transform("_t", lambda x: x["tok"]).alias("_new"))
    out = df.join(rebuilt, id_col, "left").withColumn(tokens_col, F.coalesce("_new", tokens_col))
    return out.select(*df.columns)


def nonstandard_counts(
    df: DataFrame,
    vocabulary: DataFrame,
    id_col: str = "id",
    tokens_col: str | None = "tokens",
    text_col: str = "text",
    word_col: str = "word",
) -> DataFrame:
    """(id, nonstandard): distinct lower-cased words of a post that the vocabulary does not hold.

    Posts without any are left out.  Without ``tokens_col`` the text is split
    here, which is far cheaper than to annotate it for this branch once more.
    """
    if tokens_col is None:
        alpha = T.letter_words(text_col)
    else:
        alpha = F.transform(F.filter(F.col(tokens_col), lambda t: t["is_alpha"]), lambda t: t["text"])
    words = F.array_distinct(F.transform(alpha, F.lower))
    exploded = explode_rows(df, [id_col], words, word_col)
    unknown = term_join(exploded, vocabulary.select(word_col), word_col, "left_anti")
    return unknown.groupBy(id_col).agg(F.count(F.lit(1)).alias("nonstandard"))


def character_level(df: DataFrame, text_col: str = "text", id_col: str = "id", **options) -> DataFrame:
    return df.select(id_col, *[c.alias(n) for n, c in style.character_features(text_col, **options).items()])


def extract_features(
    df: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "text",
    tokens_col: str | None = None,
    emotes_col: str | None = None,
    vocabulary: DataFrame | None = None,
    names: list[str] | None = None,
    keep: tuple[str, ...] = (),
    readability: bool = False,
) -> DataFrame:
    """All style features of every post in one pass, or the chosen ``names``.

    The features are formulas over numbers of a post.  Of a post's tokens only what the chosen features need is worked
    out, once for each distinct word of a block of posts (``word_numbers``).  With a token list of your own (``tokens_col``,
    ``emotes_col``) its entries are read instead, post by post.  No level is computed apart and joined back.  Without a
    ``vocabulary`` there is no ``nonstandard_spelling``; with one, ids must be unique.  ``keep`` names columns to carry along.
    """
    from quillspark.functions.text import lowercase_mentions

    wanted = [n for n in names if n != "pos_ngrams"] if names else feature_names(vocabulary is not None)
    if readability and not names:
        wanted += READABILITY_EXTRA
    extra = [c for c in (tokens_col, emotes_col) if c]
    stage = df.select(id_col, *keep, *extra, lowercase_mentions(text_col).alias("_text"))
    features = style.character_features("_text", names=wanted)
    if len(features) == len(wanted):
        return stage.select(id_col, *keep, *[features[n].alias(n) for n in wanted])
    if extra:
        return _from_lists(stage, features, id_col, tokens_col, emotes_col, vocabulary, wanted, keep, readability)
    needed: set[str] = set()

    def n(name: str):
        needed.add(name)
        return F.col(f"_{name}")

    unknown = vocabulary is not None and "nonstandard_spelling" in wanted
    of_text = dict(features)
    features = {name: F.col(f"_f_{name}") for name in of_text}
    features.update(style.word_features(n, n("n_unknown") if unknown else None, names=wanted))
    features.update(style.sentence_features(n, names=wanted))
    if readability:
        features.update(style.readability_extra(n, names=wanted))
    for name, column in style.document_features("_text", n, names=wanted).items():
        if name == "n_mentions":
            of_text[name], column = column, F.col(f"_f_{name}")
        features[name] = column
    columns = [id_col, *keep, *[c.alias(f"_f_{name}") for name, c in of_text.items()]]
    numbers = word_numbers(stage, columns, needed, vocabulary if unknown else None)
    if unknown:
        # ids stand for posts: the posts of an id share its unknown words, and none belong to no id
        of_id = F.sum("_n_unknown").over(Window.partitionBy(id_col))
        numbers = numbers.withColumn("_n_unknown", F.when(F.col(id_col).isNull(), 0).otherwise(of_id))
    return numbers.select(id_col, *keep, *[features[name].alias(name) for name in wanted])


def _from_lists(stage, features, id_col, tokens_col, emotes_col, vocabulary, wanted, keep, readability) -> DataFrame:
    """The features of posts whose tokens or emotes are given."""
    counts = None
    if vocabulary is not None and "nonstandard_spelling" in wanted:
        counts = nonstandard_counts(stage, vocabulary, id_col, tokens_col, "_text")
    if tokens_col is None:
        tokens_col = "_tokens"
        stage = stage.withColumn(tokens_col, T.annotate("_text"))
    stage = stage.withColumns(style.token_sets("_text", tokens_col)).withColumns(style.token_counts())
    numbers = style.list_numbers(tokens_col, emotes_col)
    n = lambda name: numbers[name]()
    features = dict(features)
    features.update(style.word_features(n, F.lit(1) if counts is not None else None, names=wanted))
    features.update(style.sentence_features(n, names=wanted))
    features.update(style.document_features("_text", n, names=wanted))
    if readability:
        features.update(style.readability_extra(n, names=wanted))
    table = stage.select(id_col, *keep, *[features[n].alias(n) for n in wanted])
    if counts is None:
        return table
    # so far the share that one unknown word makes
    share = F.coalesce("nonstandard", F.lit(0)) * F.col("nonstandard_spelling")
    return table.join(counts, id_col, "left").withColumn("nonstandard_spelling", share).select(table.columns)


def word_numbers(stage: DataFrame, columns: list, needed: set[str], vocabulary: DataFrame | None = None) -> DataFrame:
    """The ``columns`` and a column ``_<name>`` for every needed number of the posts' ``_text``; NULL without a text.

    Posts are cut into words here and written as numbers into the dictionary of their block.  The annotation and what it adds to each number are
    column expressions over a block's distinct words; a post's numbers are sums over its codes.  No post is shuffled: with a
    ``vocabulary`` the blocks are written and their distinct words meet it.
    """
    weights = {name: w for name, w in style.word_weights().items() if name in needed}
    distinct = [name for name in ("n_doc", "n_types", "n_once", "n_twice", "n_unknown") if name in needed]
    fields = {f for reads, _ in weights.values() for f in reads} | ({"is_alpha"} if distinct else set())
    cut = stage.withColumn("_sents", T.split_sentences("_text"))
    of_text = {
        "n_sents": lambda: F.size("_sents"),
        "sent_chars": lambda: style.total(F.transform("_sents", F.length)),
        "n_quoted": lambda: F.size(style.quoted_words("_text")),
        "n_root": lambda: F.size("_sents"),  # a sentence is not blank, so it has a first token
    }
    given = [make().alias(f"_{name}") for name, make in of_text.items() if name in needed]
    words = F.flatten(F.transform("_sents", T.social_tokenize))
    narrow = cut.select(
        F.struct(*columns, *given, F.col("_text").isNotNull().alias("_known")).alias("post"),
        F.coalesce(words, F.array().cast("array<string>")).alias("terms"),
    )
    blocks = encode(narrow).drop("counts")
    if vocabulary is not None:
        blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "word-blocks")
        low = blocks.select("block", F.transform("terms", F.lower).alias("terms"))
        known = look_up(low, vocabulary.distinct().select(F.col("word").alias("term"), F.lit(True).alias("known")), "known")
        blocks = blocks.join(known.select("block", "found_keys"), "block", "left")
    else:
        blocks = blocks.withColumn("found_keys", F.lit(None).cast("array<int>"))
    annotated = blocks.withColumn("_words", T.annotate_words("terms", fields))
    sums = [F.transform("_words", w).alias(f"_{name}") for name, (_, w) in weights.items()]
    lows = [F.transform("_words", lambda t: F.when(t["is_alpha"], F.lower(t["text"]))).alias("_low")] if distinct else []
    made = [*weights, *distinct]
    ready = annotated.select("posts", "sizes", "codes", "found_keys", *lows, *sums)
    kept = [f.name for f in blocks.schema["posts"].dataType.elementType]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema["posts"].dataType.elementType)
    out = ready.mapInArrow(_sums_of_posts(kept, list(weights), distinct), kinds + "".join(f", `_{name}` bigint" for name in made))
    number = lambda name: F.when(F.col("_known"), F.col(f"_{name}")).alias(f"_{name}")
    return out.select(*[c for c in kept if c != "_known"], *[number(name) for name in made])


def _sums_of_posts(kept: list[str], weights: list[str], distinct: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                posts, sizes, codes = row["posts"].values, unpack(row["sizes"].as_py()), unpack(row["codes"].as_py())
                owner, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
                columns = [posts.field(i) for i in range(len(kept))]
                for name in weights:
                    columns.append(_longs(np.bincount(owner, row[f"_{name}"].values.to_numpy()[codes], n)))
                if distinct:
                    columns += _distinct_numbers(row, owner, codes, sizes, distinct)
                names = kept + [f"_{name}" for name in weights + distinct]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _longs(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers.astype(np.int64))


def _distinct_numbers(row: dict, owner: np.ndarray, codes: np.ndarray, sizes: np.ndarray, names: list[str]) -> list[pa.Array]:
    """Numbers of a block's posts that depend on which words of a post are equal."""
    n, low = len(sizes), row["_low"].values.dictionary_encode()
    of_word = low.indices.fill_null(-1).to_numpy()  # equal for words that differ in case only, -1 unless all letters
    alpha = of_word[codes] >= 0
    out = {"n_doc": sizes}
    if "n_types" in names:
        width = len(of_word)
        out["n_types"] = np.bincount(np.unique((owner * width + codes)[alpha]) // max(width, 1), minlength=n)
    if {"n_once", "n_twice", "n_unknown"} & set(names):
        width = max(len(low.dictionary), 1)
        pair, times = np.unique((owner * width + of_word[codes])[alpha], return_counts=True)
        out["n_once"], out["n_twice"] = (np.bincount((pair // width)[times == t], minlength=n) for t in (1, 2))
        unknown = np.ones(width, bool)
        if row["found_keys"].is_valid:
            known = of_word[row["found_keys"].values.to_numpy()]
            unknown[known[known >= 0]] = False
        out["n_unknown"] = np.bincount((pair // width)[unknown[pair % width]], minlength=n)
    return [_longs(out[name]) for name in names]


def richness(df: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Vocabulary richness of every post: Brunet's W, Yule's K, Honore's R, Sichel's S, Simpson's D.

    Words are the lower-cased tokens of letters.  Each post is sorted once and its word frequencies are the
    lengths of the runs, so nothing is shuffled.
    """
    from quillspark.functions.text import lowercase_mentions

    words = F.sort_array(F.transform(T.letter_words("_text"), F.lower))
    stage = df.select(id_col, *keep, lowercase_mentions(text_col).alias("_text")).withColumn("_low", words)
    stage = stage.withColumn("_starts", style.run_starts(F.col("_low")))
    stage = stage.withColumn("_times", style.run_lengths(F.col("_starts"), F.size("_low")))
    return stage.select(id_col, *keep, *[c.alias(n) for n, c in style.richness_features("_times").items()])


def feature_names(with_vocabulary: bool = False, levels=LEVELS) -> list[str]:
    """Names of the numeric features, level by level."""
    names = [n for level in levels for n in C.FEATURES_BY_LEVEL[level] if n != "pos_ngrams"]
    return names if with_vocabulary else [n for n in names if n != "nonstandard_spelling"]


def pos_freq(df: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """(id, pos, freq): share of each tag among the alphanumeric tokens; absent tags have no row."""
    tags = df.select(id_col, style.alnum_pos_tags(tokens_col).alias("tags"))
    exploded = explode_rows(tags, [id_col, F.size("tags").alias("n_tags")], "tags", "pos")
    counts = exploded.groupBy(id_col, "pos", "n_tags").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(id_col, "pos", (F.col("n") / F.col("n_tags")).alias("freq"))


def with_pos_ngrams(df: DataFrame, id_col: str = "id", text_col: str = "text", sizes: tuple[int, ...] = (1, 2, 3), out: str = "ngrams") -> DataFrame:
    """(id, ngrams): ``style.pos_ngrams`` of the annotated texts; empty for a null text.

    Posts are written as numbers into the distinct words of their block.  The annotation runs over those words, and the
    n-grams are put together from the numbers of their tags.
    """
    words = F.flatten(F.transform(T.split_sentences(text_col), T.social_tokenize))
    narrow = df.select(F.struct(id_col).alias("post"), F.coalesce(words, F.array().cast("array<string>")).alias("terms"))
    blocks = encode(narrow).drop("counts").withColumn("_words", T.annotate_words("terms", {"pos"}))
    tags = F.transform("_words", lambda t: F.when(t["text"].rlike(P.ALL_ALNUM) & (F.length(F.lower(t["pos"])) > 1), F.lower(t["pos"])))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for posts, cuts, codes, named in zip(*(batch.column(c) for c in ("posts", "sizes", "codes", "tags")), strict=True):
                yield pa.RecordBatch.from_arrays([posts.values.field(0), _tag_runs(unpack(cuts.as_py()), unpack(codes.as_py()), named.values, sizes)], names=[id_col, out])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for posts, cuts, codes, named in zip(*(batch.column(c) for c in ("posts", "sizes", "codes", "tags")), strict=True):
                for owner, names, n in _tag_counts(unpack(cuts.as_py()), unpack(codes.as_py()), named.values, sizes):
                    yield pa.RecordBatch.from_arrays([posts.values.field(0).take(owner), names, n], names=[id_col, "ngram", "n"])

    tagged = blocks.select("posts", "sizes", "codes", tags.alias("tags"))
    made = tagged.mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<string>")
    return count_where_made(made, out, lambda ids: tagged.mapInArrow(count, f"`{id_col}` {kind}, ngram string, n bigint") if ids == id_col else None)


def _tag_counts(words: np.ndarray, codes: np.ndarray, tag_of_word: pa.Array, sizes: tuple[int, ...]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """For every size a block's posts, their distinct runs of that size, and how often each occurs; from numbers, no run of a post is a string."""
    coded = tag_of_word.dictionary_encode()
    tags, width = pc.fill_null(coded.indices, -1).to_numpy()[codes].astype(np.int64), max(len(coded.dictionary), 1)
    owner = np.repeat(np.arange(len(words)), words)[tags >= 0]
    tags = tags[tags >= 0]
    for size in sizes:
        first = np.flatnonzero(owner[: max(len(owner) - size + 1, 0)] == owner[size - 1 :])
        key = owner[first]
        for k in range(size):
            key = key * width + tags[first + k]
        pair, n = np.unique(key, return_counts=True)
        runs, place = np.unique(pair % width**size, return_inverse=True)
        parts = [coded.dictionary.take(pa.array(runs // width ** (size - 1 - k) % width)) for k in range(size)]
        names = pc.binary_join_element_wise(*parts, " ").cast(pa.string())
        yield pa.array(pair // width**size), names.take(pa.array(place)), pa.array(n, pa.int64())


def _tag_runs(words: np.ndarray, codes: np.ndarray, tag_of_word: pa.Array, sizes: tuple[int, ...]) -> pa.ListArray:
    """The runs of every size of a block's posts, the smaller sizes first; a word without a tag is skipped."""
    coded = tag_of_word.dictionary_encode()
    tags, width = pc.fill_null(coded.indices, -1).to_numpy()[codes].astype(np.int64), max(len(coded.dictionary), 1)
    owner = np.repeat(np.arange(len(words)), words)[tags >= 0]
    tags = tags[tags >= 0]
    names, places, posts, base = [pa.array([], pa.string())], [], [], 0
    for size in sizes:
        first = np.flatnonzero(owner[: max(len(owner) - size + 1, 0)] == owner[size - 1 :])
        keys, place = np.unique(sum((tags[first + k] * width ** (size - 1 - k) for k in range(size)), np.zeros(len(first), np.int64)), return_inverse=True)
        parts = [coded.dictionary.take(pa.array(keys // width ** (size - 1 - k) % width)) for k in range(size)]
        names.append(pc.binary_join_element_wise(*parts, " ").cast(pa.string()))
        places.append(place + base)
        posts.append(owner[first])
        base += len(keys)
    posts = np.concatenate(posts)
    order = np.argsort(posts, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(posts, minlength=len(words)))))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.concat_arrays(names).take(pa.array(np.concatenate(places)[order])))


# ------------------------------------------------------------------------- report


def _aggregate_to_long(df: DataFrame, columns: dict, value: str) -> DataFrame:
    names = list(columns)
    return df.agg(*[c.cast("double").alias(n) for n, c in columns.items()]).unpivot([], names, "feature", value)


def binary_feature_pct(df: DataFrame, names: list[str]) -> DataFrame:
    """Percentage of posts that show a 0/1 feature."""
    return _aggregate_to_long(df, {n: 100 * F.avg(n) for n in names}, "pct")


def absolute_feature_totals(df: DataFrame, names: list[str]) -> DataFrame:
    return _aggregate_to_long(df, {n: F.sum(n) for n in names}, "total")


def frequency_feature_means(df: DataFrame, names: list[str]) -> DataFrame:
    """Means with NaN and NULL skipped."""
    return _aggregate_to_long(
        df, {n: F.avg(F.when(~F.isnan(F.col(n).cast("double")), F.col(n))) for n in names}, "mean"
    )


def pos_freq_means(freqs: DataFrame) -> DataFrame:
    """Mean share of a tag over the posts that contain it."""
    return freqs.groupBy("pos").agg(F.avg("freq").alias("mean"))


def feature_kinds(names: list[str]) -> dict[str, list[str]]:
    """The built-in features by kind (``split_features_by_kind`` works it out from data)."""
    binary = ["repeated_questionmark", "repeated_periods", "repeated_exclamation", "contains_equals"]
    absolute = ["total_word_len", "n_sents", "n_mentions"]
    return {
        "binary": [n for n in names if n in binary],
        "absolute": [n for n in names if n in absolute],
        "frequency": [n for n in names if n not in binary and n not in absolute],
    }


def feature_report(features: DataFrame, names: list[str]) -> DataFrame:
    """(kind, feature, value) of one corpus: percentages, totals and means in a single aggregate."""
    kinds = feature_kinds(names)
    columns = {n: 100 * F.avg(n) for n in kinds["binary"]}
    columns.update({n: F.sum(n) for n in kinds["absolute"]})
    columns.update({n: F.avg(F.when(~F.isnan(n), F.col(n))) for n in kinds["frequency"]})
    long = _aggregate_to_long(features, columns, "value")
    kind = F.when(F.col("feature").isin(*kinds["binary"]), "binary").when(
        F.col("feature").isin(*kinds["absolute"]), "absolute"
    )
    return long.select(kind.otherwise("frequency").alias("kind"), "feature", "value")


def feature_differences(features: DataFrame, names: list[str], label_col: str, target: str, background: str) -> DataFrame:
    """(feature, target, background, diff): class means of every feature, largest relative difference first.

    One shuffle of one row per class and input partition.
    """
    means = features.groupBy(label_col).agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names])
    long = means.unpivot([label_col], names, "feature", "mean")
    sides = long.groupBy("feature").agg(
        F.max(F.when(F.col(label_col) == target, F.col("mean"))).alias("target_mean"),
        F.max(F.when(F.col(label_col) == background, F.col("mean"))).alias("background_mean"),
    )
    diff = F.col("target_mean") - F.col("background_mean")
    size = F.try_divide(F.abs(diff), F.greatest(F.abs("target_mean"), F.abs("background_mean")))
    return sides.withColumn("diff", diff).orderBy(F.desc_nulls_last(size), F.asc("feature"))
