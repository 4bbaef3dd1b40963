"""Language identification, words first with a backoff to character n-grams.

A known word scores its log frequency in each language.  A word that the model does not know is scored letter by
letter: the longest known n-gram that ends at a letter gives the letter's conditional log frequency, shorter n-grams
stand in where a language has not seen it.  A text's language is the one with the largest sum over its words.

All labelled texts are counted, words and n-grams alike, and every count is used.  The scores of all words and n-grams
are tables.  The ``HOT_WORDS`` most frequent words are broadcast and scored in place; the other distinct words of each
block of texts are joined with the tables.  Only a model that is asked for with ``max_words`` or ``max_grams`` leaves
rarer ones out.

Nulls and odd rows: a null text or one without a letter is ``und`` with score 0; so is every text if nothing could be
learned.  Rows without a language or text are not learned from.  Ties go to the language first in order.  Repeated
rows are counted and predicted each on its own.  Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.session import materialize

UNKNOWN = "und"
ORDER = 4
#: What of a model without limits is in memory; the rest is joined.
HOT_WORDS, HOT_GRAMS = 200_000, 100_000
BLOCK_BYTES = 8 << 20
#: Log discount of a step to a shorter n-gram.
BACKOFF = float(np.log(0.4))
#: Marks that are cut off before a word is looked at.
_MARKS = ".,;:!?|#%&$*\"'()[]{}<>-_/"
_RUN = re.compile(r"[^\W\d_]+")


def normal_words(raw: str) -> list[str]:
    """Runs of letters in a word, in lower case."""
    low = raw.lower()
    if low.isalpha():
        return [low]
    runs = (r if r.isalpha() else "".join(filter(str.isalpha, r)) for r in _RUN.findall(low))
    return [r for r in runs if r]


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For all words of letters in a batch: their text and their number in a list of distinct words, and that list."""
    words, bounds = W.split_words(texts)
    codes, dictionary = W.encode(words)
    low = pc.utf8_trim(pc.utf8_lower(dictionary), _MARKS)
    plain = pc.utf8_is_alpha(low).to_numpy(zero_copy_only=False)
    sizes = plain.astype(np.int64)
    odd = [(k, normal_words(raw)) for k, raw in zip(np.flatnonzero(~plain).tolist(), low.filter(pa.array(~plain)).to_pylist(), strict=True)]
    for k, found in odd:
        sizes[k] = len(found)
    starts = np.cumsum(sizes) - sizes
    # the words of letters of all distinct words in a row: the plain ones, then the others, put in order
    owner = np.concatenate([np.flatnonzero(plain), np.array([k for k, found in odd for _ in found], np.int64)])
    flat = pa.concat_arrays([low.filter(pa.array(plain)), pa.array([w for _, found in odd for w in found], pa.string())])
    number, known = W.encode(flat.take(pa.array(np.argsort(owner, kind="stable"))))
    counts = sizes[codes]
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(W.owners(bounds), counts), number[np.repeat(starts[codes], counts) + inside], known


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all labelled texts."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", 8 << 20):
            text, word, known = letter_words(W.as_strings(batch.column("text")))
            lang, langs = W.encode(batch.column("lang"))
            pairs, n = np.unique(word * len(langs) + lang[text], return_counts=True)
            for at in range(0, len(pairs), 1 << 16):
                part = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(part % len(langs))), known.take(pa.array(part // len(langs))), pa.array(n[at : at + (1 << 16)].astype(np.int64))],
                    names=["lang", "word", "n"],
                )

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): n-grams of the counted words, "^" and "$" marking their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, grams in seen.items():
                columns = [pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
            seen.clear()

        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                grams, marked = seen.setdefault(lang, Counter()), f"^{word}$"
                for end in range(1, len(marked) + 1):
                    for start in range(max(0, end - order), end):
                        grams[marked[start:end]] += n
            if sum(map(len, seen.values())) > 500_000:
                yield from flush()
        yield from flush()

    return counts.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _spread(counts: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """(key, total, n0, n1, ...): counts by language, in the order of ``langs``."""
    by_lang = (F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, lang in enumerate(langs))
    return counts.groupBy(key).agg(F.sum("n").alias("total"), *by_lang)


def _least(spread: DataFrame, limit: int) -> int | None:
    """The least total of the most frequent keys, at most ``limit`` of them.

    It is read from a table of totals rounded to three digits, so keys are never sorted; keys that share the first total
    beyond the limit are left out together.
    """
    step = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.col("total").cast("double"))) - 2, F.lit(0)))
    steps = spread.groupBy((F.floor(F.col("total") / step) * step).cast("long").alias("at")).agg(F.count("*").alias("n")).collect()  # 900 rows a power of ten
    least, kept = None, 0
    for row in sorted(steps, key=lambda r: -r["at"]):
        kept += row["n"]
        if kept > limit:
            break
        least = row["at"]
    return least


def _collected(rows: DataFrame, key: str, columns: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Places of the keys in order, and the columns' values."""
    wide = rows.select(key, *(F.col(c).cast("double") for c in columns)).toArrow()
    names = wide.column(key).to_pylist()
    order = np.argsort(np.array(names, object), kind="stable")
    values = np.column_stack([wide.column(c).to_numpy() for c in columns])[order]
    return {names[at]: k for k, at in enumerate(order.tolist())}, values


def _frequent(spread: DataFrame, key: str, limit: int, n_langs: int) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent keys, at most ``limit``, and their counts by language."""
    least = _least(spread, limit)
    if least is None:
        return {}, np.zeros((0, n_langs))
    return _collected(spread.where(F.col("total") >= least), key, [f"n{k}" for k in range(n_langs)])


def _log_shares(sums: list[float]) -> list[Column]:
    """Log frequencies s0, s1, ... of counts n0, n1, ... out of ``sums``; what a language lacks scores alike in all."""
    floor = float(np.log(0.1 / max(1, *sums)))
    return [F.when(F.col(f"n{k}") > 0, F.log(F.col(f"n{k}") / F.lit(float(max(n, 1))))).otherwise(F.lit(floor)).alias(f"s{k}") for k, n in enumerate(sums)]


def gram_scores(spread: DataFrame, n_langs: int, order: int = ORDER) -> DataFrame:
    """(gram, total, s0, s1, ...) of all n-grams, each length from the one before."""
    size, each = F.length("gram"), range(n_langs)
    letters = spread.where(size == 1).agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in each)).first()
    level = spread.where(size == 1).select("gram", "total", *_log_shares([float(x) for x in letters]))
    out = level
    for length in range(2, order + 1):
        shorter = level.select(F.col("gram").alias("shorter"), *(F.col(f"s{k}").alias(f"b{k}") for k in each))
        context = spread.where(size == length - 1).select(F.col("gram").alias("context"), *(F.col(f"n{k}").alias(f"c{k}") for k in each))
        here = spread.where(size == length).withColumns({"shorter": F.substring("gram", 2, order), "context": F.substring("gram", 1, length - 1)})
        scores = (
            F.when(F.col(f"n{k}") > 0, F.log(F.col(f"n{k}") / F.greatest(f"c{k}", f"n{k}"))).otherwise(F.lit(BACKOFF) + F.col(f"b{k}")).alias(f"s{k}") for k in each
        )
        # every n-gram's two parts were counted with it
        level = materialize(here.join(shorter, "shorter").join(context, "context").select("gram", "total", *scores), "langid-scores")
        out = out.union(level)
    return out


@dataclass
class Model:
    """Log frequencies by language: rows of ``word_scores`` and ``gram_scores`` belong to the entries of the two maps.

    With the tables (word, s0, s1, ...) and (gram, s0, s1, ...) of all scores, the maps hold the most frequent entries only.
    """

    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    order: int = ORDER
    word_table: DataFrame | None = None
    gram_table: DataFrame | None = None

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log frequencies (words x languages)."""
        out = np.zeros((len(words), len(self.langs)))
        rows = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[rows >= 0] = self.word_scores[rows[rows >= 0]]
        unseen = np.flatnonzero(rows < 0)
        places, sizes, grams = [], [], self.grams
        for k in unseen:
            marked = f"^{words[k]}$"
            before = len(places)
            for end in range(2, len(marked) + 1):
                for start in range(max(0, end - self.order), end):
                    row = grams.get(marked[start:end])
                    if row is not None:
                        places.append(row)
                        break
            sizes.append(len(places) - before)
        if places:
            np.add.at(out, np.repeat(unseen, sizes), self.gram_scores[places])
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int | None = None, max_grams: int | None = None) -> Model:
    """Learn from the texts whose language is given; all their words and n-grams, unless a limit is asked for."""
    counts = materialize(count_words(docs, text_col, lang_col), "langid-words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    langs = sorted(totals)
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    size = len(langs)
    all_words = materialize(_spread(counts, "word", langs), "langid-words")
    words, n = _frequent(all_words, "word", HOT_WORDS if max_words is None else max_words, size)
    total = np.array([totals[lang] for lang in langs], float)
    # what a language lacks scores below anything seen, and alike in all, whatever the languages' sizes
    word_scores = np.where(n > 0, np.log(np.maximum(n, 1) / np.maximum(total, 1)), np.log(0.1 / max(total.max(initial=1), 1)))
    all_grams = materialize(_spread(count_grams(counts), "gram", langs), "langid-grams")
    if max_words is None and max_grams is None:
        word_table = all_words.select("word", *_log_shares(total.tolist()))
        gram_table = gram_scores(all_grams, size)
        least = _least(all_grams, HOT_GRAMS)
        hot = gram_table.where(F.lit(False) if least is None else F.col("total") >= least)
        return Model(langs, words, word_scores, *_collected(hot, "gram", [f"s{k}" for k in range(size)]), word_table=word_table, gram_table=gram_table.drop("total"))
    grams, n = _frequent(all_grams, "gram", HOT_GRAMS if max_grams is None else max_grams, size)
    scores = np.zeros_like(n)
    letters = sum((n[k] for g, k in grams.items() if len(g) == 1), np.zeros(size))
    for gram in sorted(grams, key=len):
        k = grams[gram]
        if len(gram) == 1:
            scores[k] = np.where(n[k] > 0, np.log(np.maximum(n[k], 1) / np.maximum(letters, 1)), np.log(0.1 / max(letters.max(initial=1), 1)))
            continue
        shorter = next((grams[gram[s:]] for s in range(1, len(gram)) if gram[s:] in grams), k)
        context = n[grams[gram[:-1]]] if gram[:-1] in grams else n[k]
        seen = n[k] > 0
        scores[k] = np.where(seen, np.log(np.where(seen, n[k], 1) / np.maximum(context, np.where(seen, n[k], 1))), BACKOFF + scores[shorter])
    return Model(langs, words, word_scores, grams, scores)


def table_scores(words: DataFrame, model: Model) -> DataFrame:
    """(word, s0, s1, ...) of distinct words by the model's tables; words that it does not know letter by letter."""
    columns, order = [f"s{k}" for k in range(len(model.langs))], model.order
    words = materialize(words.join(model.word_table, "word", "left"), "langid-distinct")
    unknown = materialize(words.where("s0 IS NULL").select(F.monotonically_increasing_id().alias("number"), "word"), "langid-unknown")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "word", 1 << 18):
            numbers, tails, counts = [], [], []
            for number, word in zip(batch.column("number").to_pylist(), batch.column("word").to_pylist(), strict=True):
                marked = f"^{word}$"
                ends = Counter(marked[max(0, end - order) : end] for end in range(2, len(marked) + 1))
                numbers += [number] * len(ends)
                tails += ends
                counts += ends.values()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(tails, pa.string()), pa.array(counts, pa.int64())], names=["number", "tail", "n"])

    # a letter's score goes by the letters that end there
    letters = materialize(unknown.mapInArrow(run, "number long, tail string, n long"), "langid-letters")
    tails = letters.select("tail").distinct()
    ends = tails.select("tail", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda at: F.substring("tail", at, F.lit(order)))).alias("gram"))
    longest = ends.join(model.gram_table, "gram").groupBy("tail").agg(F.max_by(F.struct(*columns), F.length("gram")).alias("s"))
    sums = letters.join(longest, "tail").groupBy("number").agg(*(F.sum(F.col("n") * F.col(f"s.{c}")).alias(c) for c in columns))
    return words.where("s0 IS NOT NULL").unionByName(unknown.join(sums, "number").select("word", *columns))


def _answers(sums: np.ndarray, has: np.ndarray, langs: list[str]) -> list[pa.Array]:
    """Language and its share of the odds, from each text's sums."""
    odds = np.exp(sums - sums.max(axis=1, keepdims=True))
    names = np.where(has, np.array(langs, object)[sums.argmax(axis=1)], UNKNOWN)
    return [pa.array(names, pa.string()), pa.array(np.where(has, odds.max(axis=1) / odds.sum(axis=1), 0.0))]


def predict(docs: DataFrame, model: Model, text_col: str = "text", **keep: Column) -> DataFrame:
    """The columns ``keep`` with lang_pred and score of every whole text."""
    rows = docs.select(*(c.alias(name) for name, c in keep.items()), F.col(text_col).alias("__text"))
    kept = list(keep)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{name}` {kinds[name]}" for name in kept), "lang_pred string", "score double"])
    if model.word_table is not None and model.gram_table is not None:
        return _predict_by_tables(rows, model, kept, kinds, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in W.slices(batches, "__text", BLOCK_BYTES):
            size = batch.num_rows
            answers = [pa.array([UNKNOWN] * size, pa.string()), pa.array(np.zeros(size))]
            if learned.langs:
                text, word, known = letter_words(W.as_strings(batch.column("__text")))
                scores = learned.score_words(known.to_pylist())
                sums = np.column_stack([np.bincount(text, scores[word, k], size) for k in range(len(learned.langs))])
                answers = _answers(sums, np.bincount(text, minlength=size) > 0, learned.langs)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), *answers], names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def _predict_by_tables(rows: DataFrame, model: Model, kept: list[str], kinds: dict[str, str], schema: str) -> DataFrame:
    """Blocks of texts: frequent words are summed at once, each block's other distinct words get their scores by join."""
    langs, each = model.langs, range(len(model.langs))
    shared = rows.sparkSession.sparkContext.broadcast((model.words, model.word_scores))  # bounded by HOT_WORDS
    limit = max(1 << 20, BLOCK_BYTES * 4 // max(4, len(langs)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_scores = shared.value
        number = TaskContext.get().partitionId() << 32
        for batch in W.slices(batches, "__text", limit):
            size = batch.num_rows
            text, word, known = letter_words(W.as_strings(batch.column("__text")))
            place = np.fromiter((hot.get(w, -1) for w in known.to_pylist()), np.int64, len(known))
            rare = place < 0
            scores = np.zeros((len(known), len(langs)))
            scores[~rare] = hot_scores[place[~rare]]
            sums = np.column_stack([np.bincount(text, scores[word, k], size) for k in each])
            rest, left = known.filter(pa.array(rare)), rare[word]
            pairs, n = np.unique(text[left] * max(len(rest), 1) + (np.cumsum(rare) - 1)[word[left]], return_counts=True)
            by_text = np.bincount(pairs // max(len(rest), 1), minlength=size).astype(np.int32)
            one = lambda values: pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), *(pa.ListArray.from_arrays([0, size], batch.column(name)) for name in kept), one(sums), one(np.bincount(text, minlength=size) > 0),
                 one(by_text), one((pairs % max(len(rest), 1)).astype(np.int32)), one(n.astype(np.int32)), pa.ListArray.from_arrays([0, len(rest)], rest)],
                names=["block", *(f"k{k}" for k in range(len(kept))), "sums", "has", "by_text", "words", "n", "rest"],
            )
            number += 1

    arrays = "".join(f"k{k} array<{kinds[name]}>, " for k, name in enumerate(kept))
    blocks = materialize(rows.mapInArrow(cut, f"block long, {arrays}sums binary, has binary, by_text binary, words binary, n binary, rest array<string>"), "langid-blocks")
    rest = blocks.select("block", F.posexplode("rest").alias("k", "word"))
    scores = table_scores(rest.select("word").distinct(), model)
    # a word without any known letter has no score
    found = rest.join(scores, "word").groupBy("block").agg(F.collect_list(F.struct("k", *(f"s{k}" for k in each))).alias("c"))  # a block's own words
    columns = ["block", "c.k", *(f"c.s{k}" for k in each)]
    ready = blocks.withColumn("n_rest", F.size("rest")).drop("rest").join(found.select(*columns), "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                sums, has = np.frombuffer(at["sums"].as_py()).reshape(-1, len(langs)).copy(), np.frombuffer(at["has"].as_py(), bool)
                if at["k"].is_valid:
                    scores = np.zeros((at["n_rest"].as_py(), len(langs)))
                    scores[at["k"].values.to_numpy()] = np.column_stack([at[f"s{k}"].values.to_numpy() for k in each])
                    by_text, word, n = (np.frombuffer(at[c].as_py(), np.int32) for c in ("by_text", "words", "n"))
                    text = np.repeat(np.arange(len(sums)), by_text)
                    sums += np.column_stack([np.bincount(text, n * scores[word, k], len(sums)) for k in each])
                yield pa.RecordBatch.from_arrays([*(at[f"k{k}"].values for k in range(len(kept))), *_answers(sums, has, langs)], names=[*kept, "lang_pred", "score"])

    return ready.mapInArrow(finish, schema)
