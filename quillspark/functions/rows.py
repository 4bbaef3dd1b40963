"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import as_col


def count_where_made(df: DataFrame, column: str, counts: Callable[[str], DataFrame | None]) -> DataFrame:
    """Let ``ngram_counts`` of this very table count the lists of ``column`` where they are made.

    ``counts`` takes the name of the id column and gives (id, ngram, n), a row or more for each post and n-gram, or None if it cannot.  So the lists, many
    times as large as the texts, go to no other process and only a run of posts has them at a time.
    """
    df._counts_where_made = (column, counts)
    return df


def counts_where_made(df: DataFrame, column: Column | str, id_col: str) -> DataFrame | None:
    known, counts = vars(df).get("_counts_where_made", (None, None))
    return counts(id_col) if isinstance(column, str) and column == known else None


def explode_rows(df: DataFrame, keep: list, array: Column | str, name: str) -> DataFrame:
    """One row per (non-null) entry of an array.

    The plain explode lets the optimiser put "array is not empty" below it,
    which works out a computed array two times more.  The outer form, with the
    empty rows dropped above, computes it once.
    """
    out = df.select(*keep, F.explode_outer(as_col(array)).alias(name))
    return out.where(F.col(name).isNotNull())
