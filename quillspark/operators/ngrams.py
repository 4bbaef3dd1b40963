"""N-gram counts and vectorisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, Imputer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.rows import count_where_made, counts_where_made, explode_rows
from quillspark.functions import patterns as P
from quillspark.functions import tokens as T
from quillspark.functions.text import as_col
from quillspark.operators.blocks import runs
from quillspark.operators.joins import term_join

#: Size of a vocabulary that is not bounded: the vectorizer takes the smaller of this and the number of terms.
ALL_TERMS = 2**31 - 1


def with_char_ngrams(df: DataFrame, n: int = 3, text_col: str = "text", out: str = "ngrams") -> DataFrame:
    def counts(id_col: str) -> DataFrame | None:
        if out in (id_col, text_col):
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.columns
                for start, end in T.text_runs(texts):
                    yield _counted(batch.schema.names[0], ids.slice(start, end - start), T.runs_of_texts(texts.slice(start, end - start), n))

        kind = df.schema[id_col].dataType.simpleString()
        return df.select(id_col, T.collapsed(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ngram string, n bigint")

    return count_where_made(df.withColumn(out, T.char_ngrams(text_col, n)), out, counts)


def with_word_ngrams(df: DataFrame, n: int = 1, text_col: str = "text", out: str = "ngrams") -> DataFrame:
    return df.withColumn(out, T.token_ngrams(T.extract_all(text_col, P.LONG_WORD), n))


def ngram_counts(df: DataFrame, ngrams: Column | str = "ngrams", id_col: str = "id") -> DataFrame:
    """(id, ngram, n): a post's n-grams are counted where it lies, a run of posts at once, so only its distinct ones become rows.

    Posts that share an id are added up.  Null n-grams are left out, and a post without any has no row.  Lists that the table can count where it
    makes them (``count_where_made``) are not made as a column.
    """
    counted = counts_where_made(df, ngrams, id_col)
    if counted is None:
        kind = df.schema[id_col].dataType.simpleString()
        lists = df.select(id_col, as_col(ngrams).alias("ngrams"))
        counted = lists.mapInArrow(_counts_of_posts, f"`{id_col}` {kind}, ngram string, n bigint")
    return counted.groupBy(id_col, "ngram").agg(F.sum("n").alias("n"))


def _counts_of_posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in runs(batch.column("ngrams")):
            yield _counted(batch.schema.names[0], *(column.slice(start, end - start) for column in batch.columns))


def _counted(id_col: str, ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
    coded = lists.flatten().dictionary_encode()
    codes, width = pc.fill_null(coded.indices, -1).to_numpy(), max(len(coded.dictionary), 1)
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    pair, n = np.unique((owner * width + codes)[codes >= 0], return_counts=True)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(pair // width)), coded.dictionary.take(pa.array(pair % width)), pa.array(n, pa.int64())], names=[id_col, "ngram", "n"])


def ngram_totals(df: DataFrame, ngrams: Column | str = "ngrams") -> DataFrame:
    """Corpus total of each n-gram, most frequent first."""
    exploded = explode_rows(df, [], ngrams, "ngram")
    return exploded.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("ngram"))


def fit_vocabulary(train: DataFrame, ngrams: Column | str = "ngrams", max_vocab: int | None = None) -> DataFrame:
    """(ngram, total) of the training rows; ``max_vocab`` keeps the most frequent."""
    totals = explode_rows(train, [], ngrams, "ngram").groupBy("ngram").agg(F.count(F.lit(1)).alias("total"))
    return totals if max_vocab is None else totals.orderBy(F.desc("total"), F.asc("ngram")).limit(max_vocab)


def apply_vocabulary(
    df: DataFrame, vocabulary: DataFrame, ngrams: Column | str = "ngrams", id_col: str = "id"
) -> DataFrame:
    """(id, ngram, n) restricted to the vocabulary; n-grams not in it are ignored.

    The vocabulary is read for a size check and for the join, so give a written table.
    """
    counts = ngram_counts(df, ngrams, id_col)
    return term_join(counts, vocabulary.select("ngram"), "ngram", "left_semi")


def fit_count_vectorizer(
    train: DataFrame, ngrams_col: str = "ngrams", out: str = "ngram_vector", max_vocab: int | None = None
) -> CountVectorizerModel:
    """Sparse count vectors of all n-grams of the training rows, or of the ``max_vocab`` most frequent."""
    return CountVectorizer(inputCol=ngrams_col, outputCol=out, vocabSize=ALL_TERMS if max_vocab is None else max_vocab, minDF=1.0).fit(train)


def feature_assembler(names: list[str], out: str = "feature_vector", vectors: list[str] | None = None) -> VectorAssembler:
    """One vector of the named numeric columns, in sorted order, then the given vector blocks."""
    return VectorAssembler(inputCols=sorted(names) + list(vectors or []), outputCol=out, handleInvalid="keep")


def vector_entries(df: DataFrame, names: list[str], vector_col: str, id_col: str = "id") -> DataFrame:
    """(id, name, value) of a vector's entries other than zero; ``names`` are those of all its places, in order."""
    places = pa.table({"place": pa.array(range(len(names)), pa.int32()), "name": pa.array(names, pa.string())})
    vector = F.unwrap_udt(vector_col)
    # a dense vector (type 1) has no list of places
    at = F.when(vector["type"] == 0, vector["indices"]).otherwise(F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    entries = explode_rows(df, [id_col], F.arrays_zip(at.alias("place"), vector["values"].alias("value")), "entry")
    entries = entries.select(id_col, "entry.place", "entry.value").where("value <> 0")
    return term_join(entries, df.sparkSession.createDataFrame(places), "place").select(id_col, "name", "value")


def assembled_entries(vectors: DataFrame, names: list[str], prefix: str = "", id_col: str = "id") -> DataFrame:
    """(id, place, name, value) of the entries other than zero: the named columns in sorted order, then the term block.

    ``vectors`` has the named columns beside the places, terms and values of ``blocks.count_vectors``.
    """
    names = sorted(names)
    kind = "struct<place: bigint, name: string, value: double>"
    ahead = [F.struct(F.lit(k).alias("place"), F.lit(n).alias("name"), F.col(n).alias("value")).cast(kind) for k, n in enumerate(names)]
    block = F.transform(
        F.arrays_zip("places", "terms", "values"),
        lambda e: F.struct((e["places"] + len(names)).alias("place"), F.concat(F.lit(prefix), e["terms"]).alias("name"), e["values"].alias("value")).cast(kind),
    )
    entries = explode_rows(vectors, [id_col], F.concat(F.array(*ahead), block) if ahead else block, "entry")
    return entries.select(id_col, "entry.*").where("value <> 0")


def vectorize_features(train: DataFrame, names: list[str], out: str = "feature_vector", vectors=None):
    """Fitted layout (mean imputation, then assembly) to be reused on other rows."""
    names = sorted(names)
    imputed = [f"{n}_imputed" for n in names]
    imputer = Imputer(strategy="mean", inputCols=names, outputCols=imputed)
    return Pipeline(stages=[imputer, feature_assembler(imputed, out, vectors)]).fit(train)
