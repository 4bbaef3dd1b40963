"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` has columns a and b; gives (node, component), component being the smallest node reachable.

    Large-star and small-star steps alternate until every node points at its component's smallest node.  Each step
    folds a node's neighbours to their minimum before it moves them, every round is written to the shared folder, and
    nothing but a checksum reaches the driver.  Loops and null ends are ignored; an empty table gives an empty one.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = materialize(current, name), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        current = materialize(small.distinct(), name)
        after = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest of n places that each place reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new
