"""Distinct counts that merge: HyperLogLog sketches, stored per group and united later.

A day's sketches are written once; any span of days, languages or both is then counted from the stored
sketches without the posts.  A sketch has at most 2^lg_k bytes whatever it has counted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14


def distinct_sketches(df: DataFrame, keys: list[str], value_col: str, lg_k: int = LG_K) -> DataFrame:
    """(keys, n, sketch): rows and a sketch of the distinct values per group.  A null value is a row but no value, a null key a group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(value_col).cast("string"), F.lit(lg_k)).alias("sketch")
    )


def unite_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups; they count what the groups' values together hold, each value once."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, out: str = "n_distinct") -> DataFrame:
    """The sketch replaced by its estimate."""
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")


def relative_error(lg_k: int = LG_K) -> float:
    """Standard error of an estimate as a share of the true count."""
    return 1.04 / math.sqrt(2**lg_k)
