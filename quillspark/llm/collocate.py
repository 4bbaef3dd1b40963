"""Phrase collocation mining over count streams in prefix and suffix order.

Texts are cut into pieces at punctuation and line ends and pieces into words, and everything is counted per language.  The corpus is
written once as blocks of word numbers.  Level by level, phrases of m + 1 words are pairs of neighbouring frequent phrases of m
words: a block counts its distinct pairs, their totals are summed, pairs that are frequent get ids in prefix order (by the
id of their first m words, then by that of their last m), and the ids go back to the blocks that hold them.  So a phrase
is counted only where both its parts are frequent, and no key is wider than two numbers.

Each level is a count stream.  In prefix order (by the id of the first m words) it is merged in lockstep with the stream below and gets
the counts of all its left parts; in suffix order (by the id of the last m words) those of all its right parts.  The same two orders
give a phrase's largest extension by one word, which decides whether a longer phrase stands for it: counts never rise
with length, so a phrase that a longer one covers is covered by one that is a single word longer.  The joins are sort-merge joins by hint.

Nulls and odd rows: a null text is the empty one and a null language is ``und``.  A long text is one entry of its block and is
read whole; a repeated row counts again.  Equal scores are ordered by count and phrase.  An empty table gives no phrase.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.align import packed, unpacked
from quillspark.operators.joins import is_small, term_join
from quillspark.session import discard, materialize

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: Bytes of text in a block.
BLOCK = 8 << 20
#: A stream of at most so many phrases (24 bytes each), or words with so many characters in all, is held by every task; a
#: larger one is joined with the blocks.
IN_MEMORY, IN_MEMORY_CHARS = 2_000_000, 32_000_000
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP[[*b".,;:!? \t", *range(10, 14)]] = True


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, lower case in ASCII, and their positions; a position is left out where a piece ends."""
    data, bounds = W.text_bytes(pc.ascii_lower(texts))
    word = ~_GAP[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True  # a text begins a piece
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    starts = np.flatnonzero(word & (~before | first[:-1]))
    piece = np.cumsum(_BREAK[data] | first[:-1])[starts]
    offsets = np.concatenate(([0], np.cumsum(word)))[np.append(starts, len(data))].astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word]))
    return words, np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)


def word_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One written row per block and language: block, lang, codes (0: a piece ends), and its words with their counts."""
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", BLOCK):
            texts, langs = W.as_strings(batch.column("text")), batch.column("lang")
            for lang in pc.unique(langs):
                words, at = cut_words(texts.filter(pc.equal(langs, lang)))
                place, known = W.encode(words)
                if not len(place):
                    continue
                codes = np.zeros(at[-1] + 1, np.int64)
                codes[at] = place + 1
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang.as_py()]), "codes": pa.array([packed(codes)], pa.binary()),
                    "words": pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known),
                    "counts": pa.array([np.bincount(place)], pa.list_(pa.int64())),
                })

    found = narrow.mapInArrow(run, "lang string, codes binary, words array<string>, counts array<long>")
    return materialize(found.withColumn("block", F.monotonically_increasing_id()), "phrase-blocks")


def _numbered(counts: DataFrame, *order: str) -> DataFrame:
    """A written table with an id in the given order of its rows; ``counts`` is written."""
    rows = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.withColumn("id", F.monotonically_increasing_id()), "phrase-grams")


def _answers(found: DataFrame) -> DataFrame:
    """(block, keys, ids) of rows (block, key, id): a block's frequent entries, at most as many as it has words."""
    entries = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "id"))).alias("e"))
    return entries.select("block", F.col("e.key").alias("keys"), F.col("e.id").alias("ids"))


def _pair_keys(codes: np.ndarray, width: int) -> np.ndarray:
    """Key of the pair that begins at each place, -1 where none does."""
    both = (codes[:-1] > 0) & (codes[1:] > 0)
    return np.where(both, (codes[:-1] - 1) * width + codes[1:] - 1, -1)


def _coded(entry: np.ndarray, keys: np.ndarray, ids: np.ndarray, block: int) -> pa.RecordBatch:
    """A block's row of the next stream; ``keys`` are the frequent ones among ``entry``, in order, with their ids."""
    place = np.minimum(np.searchsorted(keys, entry), max(len(keys) - 1, 0))
    codes = np.where(keys[place] == entry, place + 1, 0) if len(keys) else np.zeros(0, np.int64)
    codes = codes[(codes > 0) | (np.append(codes[1:], 0) > 0)]  # one 0 between runs will do
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block]), "codes": pa.array([packed(codes)], pa.binary()), "ids": pa.array([ids], pa.list_(pa.int64())),
    })


_STREAM = "block long, codes binary, ids array<long>"


def _recode(blocks: DataFrame, answers: DataFrame, pairs: bool) -> DataFrame:
    """The next stream, written: block, codes, ids.  Codes are places in ``ids`` from 1, 0 where no frequent entry begins."""
    old = F.size("ids") if pairs else F.lit(0)
    rows = blocks.select("block", "codes", old.alias("width")).join(answers, "block").select("block", "codes", "width", "keys", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, codes, width = (batch.column(c)[k].as_py() for c in ("block", "codes", "width"))
                keys, ids = (batch.column(c)[k].values.to_numpy() for c in ("keys", "ids"))
                codes = unpacked(codes)
                yield _coded(_pair_keys(codes, width) if pairs else codes - 1, keys, ids, block)

    return materialize(rows.mapInArrow(run, _STREAM), "phrase-stream")


def _recode_words_in_place(blocks: DataFrame, grams: DataFrame) -> DataFrame:
    """As ``_recode`` for words, where the frequent words are few and short enough to be held by every task."""
    held = {}
    for lang, word, number in zip(*(c.to_pylist() for c in grams.select("lang", "word", "id").toArrow().columns), strict=True):  # at most IN_MEMORY rows
        held.setdefault(lang, ([], []))[0].append(word)
        held[lang][1].append(number)
    shared = blocks.sparkSession.sparkContext.broadcast({k: (pa.array(w, pa.string()), np.array(i, np.int64)) for k, (w, i) in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                known, numbers = shared.value.get(batch.column("lang")[k].as_py(), (pa.array([], pa.string()), np.zeros(0, np.int64)))
                place = pc.fill_null(pc.index_in(batch.column("words")[k].values, known), -1).to_numpy().astype(np.int64)
                keys = np.flatnonzero(place >= 0)
                entry = unpacked(batch.column("codes")[k].as_py()) - 1
                yield _coded(entry, keys, numbers[place[keys]], batch.column("block")[k].as_py())

    return materialize(blocks.select("block", "lang", "codes", "words").mapInArrow(run, _STREAM), "phrase-stream")


def _recode_in_place(stream: DataFrame, grams: DataFrame) -> DataFrame:
    """As ``_recode`` for pairs, where the frequent pairs are few enough to be held by every task."""
    held = grams.select("prefix", "suffix", "id").orderBy("id").toArrow()  # at most IN_MEMORY rows
    shared = stream.sparkSession.sparkContext.broadcast([held.column(c).to_numpy() for c in held.column_names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, suffix, numbers = shared.value
        ends = np.unique(suffix)
        starts, row = np.unique(prefix, return_inverse=True)
        known = row * len(ends) + np.searchsorted(ends, suffix)  # rises with the id
        for batch in batches:
            for k in range(batch.num_rows):
                ids, codes = batch.column("ids")[k].values.to_numpy(), unpacked(batch.column("codes")[k].as_py())
                entry = _pair_keys(codes, len(ids))
                keys = np.unique(entry[entry >= 0])
                first, last = ids[keys // max(len(ids), 1)], ids[keys % max(len(ids), 1)]
                x, y = (np.minimum(np.searchsorted(a, v), len(a) - 1) for a, v in ((starts, first), (ends, last)))
                at = np.minimum(np.searchsorted(known, x * len(ends) + y), len(known) - 1)
                hit = (prefix[at] == first) & (suffix[at] == last)
                yield _coded(entry, keys[hit], numbers[at[hit]], batch.column("block")[k].as_py())

    return materialize(stream.select("block", "codes", "ids").mapInArrow(run, _STREAM), "phrase-stream")


def _pairs(stream: DataFrame) -> DataFrame:
    """(block, key, prefix, suffix, n) of every block's distinct neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].values.to_numpy()
                keys = _pair_keys(unpacked(batch.column("codes")[k].as_py()), len(ids))
                keys, n = np.unique(keys[keys >= 0], return_counts=True)
                for at in range(0, len(keys), 1 << 17):
                    some, block = keys[at : at + (1 << 17)], batch.column("block")[k].as_py()
                    yield pa.RecordBatch.from_pydict({
                        "block": np.full(len(some), block), "key": some, "prefix": ids[some // len(ids)], "suffix": ids[some % len(ids)],
                        "n": n[at : at + (1 << 17)].astype(np.int64),
                    })

    return stream.select("block", "codes", "ids").mapInArrow(run, "block long, key long, prefix long, suffix long, n long")


def count_streams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT):
    """Words per language (lang, n), and the written count streams of frequent phrases of 1, 2, .. words.

    The first stream is (lang, word, a, id), the others are (prefix, suffix, a, id): ids of the first and the last words
    in the stream below.
    """
    blocks = word_blocks(docs, text_col, lang_col)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = materialize(blocks.groupBy("lang").agg(F.sum(total).alias("n")), "phrase-sizes")
    frequent = lambda n: F.sum(n).alias("a")
    words = blocks.select("lang", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("w"))
    counts = materialize(words.groupBy("lang", "w.word").agg(frequent("w.n")).where(F.col("a") >= min_count), "phrase-counts")
    grams = _numbered(counts, "lang", "word")
    streams = [grams]
    if is_small(grams, IN_MEMORY, IN_MEMORY_CHARS):
        stream = _recode_words_in_place(blocks, grams)
    else:
        places = blocks.select("block", "lang", F.posexplode("words").alias("place", "word")).withColumn("key", F.col("place").cast("long"))
        stream = _recode(blocks, _answers(places.join(grams.select("lang", "word", "id"), ["lang", "word"])), False)
    discard(blocks, counts)
    while len(streams) < longest:
        counts = materialize(_pairs(stream).groupBy("prefix", "suffix").agg(frequent("n")).where(F.col("a") >= min_count), "phrase-counts")
        grams = _numbered(counts, "prefix", "suffix")
        n_grams, before = grams.count(), stream
        if n_grams:
            streams.append(grams)
        if n_grams and len(streams) < longest:
            if n_grams <= IN_MEMORY:
                stream = _recode_in_place(stream, grams)
            else:
                found = _pairs(stream).drop("n").join(grams.select("prefix", "suffix", "id"), ["prefix", "suffix"])
                stream = _recode(stream, _answers(found), True)
        discard(before, counts)
        if not n_grams:
            break
    return sizes, streams


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in 38-digit decimals: exact for corpora of up to 10^17 words."""
    big = lambda c: c.cast("decimal(19,0)")
    above = (big(a) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * big(n).cast("decimal(18,0)")
    return F.call_function("div", above, big(left).cast("decimal(18,0)") * big(right))


def merged(streams: list[DataFrame]) -> list[DataFrame]:
    """Per level the phrases in words: lang, phrase, last, a, id, lefts and rights (counts of the parts at each cut)."""
    none = F.array().cast("array<long>")
    below = streams[0].select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", "id", none.alias("lefts"), none.alias("rights"))
    out = []
    for stream in streams[1:]:
        left = below.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("start"), F.array_append("lefts", F.col("a")).alias("lefts"))
        right = below.select(F.col("id").alias("suffix"), "last", F.array_prepend("rights", F.col("a")).alias("rights"))
        by_prefix = stream.join(left.hint("merge"), "prefix")
        by_suffix = by_prefix.join(right.hint("merge"), "suffix")
        below = materialize(by_suffix.select("lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "a", "id", "lefts", "rights"), "phrase-level")
        out.append(below)
    return out


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
                 top: int = TOP) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    sizes, streams = count_streams(docs, text_col, lang_col, longest, min_count)
    kept = []
    for level, above in zip(merged(streams), [*streams[2:], None], strict=False):
        if above is not None:
            ends = above.select(F.col("prefix").alias("id"), "a").unionByName(above.select(F.col("suffix").alias("id"), "a"))
            longer = ends.groupBy("id").agg(F.max("a").alias("longer"))
            level = level.join(longer.hint("merge"), "id", "left").where("longer IS NULL OR 100 * longer < 100 * a")
        kept.append(level.select("lang", "phrase", "a", "lefts", "rights"))
    if not kept:
        kept = [streams[0].select("lang", F.col("word").alias("phrase"), "a", F.array("a").alias("lefts"), F.array("a").alias("rights")).where("false")]
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = term_join(rows, sizes, "lang")
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("lefts")),
        lambda k: F.struct(
            exact_score(F.col("a"), F.col("n"), F.element_at("lefts", k), F.element_at("rights", k)).alias("score"), k.alias("k"),
            F.element_at("lefts", k).alias("l"), F.element_at("rights", k).alias("r"),
        ),
    )
    rows = rows.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
