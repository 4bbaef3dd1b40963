"""From raw documents to packed training sequences, one operator per stage.

Every stage reads all that the one before kept, as a written table, so a lost executor costs at most one stage.
Stages other than the last return the columns of ``documents``.  Null or empty texts are rejected by the quality rules;
an empty table goes through all stages and gives no sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import linededup, minhash, mixing, packing, quality
from quillspark.llm.queries import tokenizer_path
from quillspark.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.keep_good(docs, quality.POLICIES["full-1"])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; what loses all its lines goes."""
    return linededup.drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' target weights, repeats as rows of their own."""
    return mixing.mixed(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL has no byte-level tokenizer.  Tests check each stage's invariants; there is no brute-force version of the whole yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
