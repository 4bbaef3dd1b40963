"""Joins of a large table with a table of terms, safe for hot terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term table is broadcast only up to this many rows and characters of all columns.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 16_000_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows with at most ``max_chars`` characters in all columns together.

    Starts a job that reads no more than ``max_rows`` + 1 rows and brings two
    numbers to the driver, so give a written table or a cheap plan.
    """
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    found = (
        df.limit(max_rows + 1).select(width.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("chars"))
        .first()
    )
    return found["n"] <= max_rows and found["chars"] <= max_chars


def term_join(
    big: DataFrame, terms: DataFrame, on: str | list[str], how: str = "inner", *, small: bool | None = None
) -> DataFrame:
    """Equi-join of a large ``big`` with ``terms`` (one row per key at most).

    Up to the checked size of the whole rows ``terms`` is broadcast, which
    leaves ``big`` in place.  Beyond it both sides are shuffled; a hot key of
    ``big`` is then split over tasks by adaptive execution, which may cut the
    left side of all four kinds of join.  ``how`` is ``inner``, ``left``,
    ``left_semi`` or ``left_anti``; results are whole in both forms.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if small is None:
        small = is_small(terms)
    return big.join(F.broadcast(terms) if small else terms, keys, how)


def compare_side_by_side(
    left: DataFrame, right: DataFrame, on: str, value: str, names: tuple[str, str], diff: str = "diff"
) -> DataFrame:
    """Full outer join of two category tables with the difference of one value."""
    a = left.select(on, F.col(value).alias(names[0]))
    b = right.select(on, F.col(value).alias(names[1]))
    return a.join(b, on, "full_outer").withColumn(diff, F.col(names[0]) - F.col(names[1]))


def join_feature_blocks(blocks: list[DataFrame], on: str = "doc_id") -> DataFrame:
    """Inner equi-join of feature tables on the document key.

    Needed only for tables that come from different places; features of one
    table are better taken in one projection.
    """
    out = blocks[0]
    for block in blocks[1:]:
        out = out.join(block, on, "inner")
    return out
