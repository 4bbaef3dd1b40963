"""Deduplication and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_row_per_key(df: DataFrame, key: Column, order_by: list[str]) -> DataFrame:
    """One row per key, the first by ``order_by``.

    An aggregate, not a window: copies fold together before the shuffle, so a
    key that holds a third of all rows costs no task more than one row per
    input partition.
    """
    order = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def dedup_text(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """One row per exact text, the smallest id kept.

    Grouped by the SHA-256 of the text, so a long text travels and is sorted once.
    """
    return first_row_per_key(df, F.sha2(F.col(text_col), 256), [id_col])


def append_unseen(stored: DataFrame, incoming: DataFrame, id_col: str = "id", arrival_col: str | None = None) -> DataFrame:
    """``stored`` plus the incoming rows whose id is new; the first arrival per id is kept."""
    order = [arrival_col] if arrival_col else [c for c in incoming.columns if c != id_col]
    # folded first: the join then meets every id once, also one that arrives in a third of all rows
    once = first_row_per_key(incoming, F.col(id_col), order)
    unseen = once.join(stored.select(id_col), id_col, "left_anti")
    return stored.unionByName(unseen.select(*stored.columns))


def union_corpora(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
