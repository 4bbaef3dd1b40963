"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

Each unit vector is rotated by a random orthogonal matrix and kept as one sign per direction, together with the
inner product between the vector and its own code.  Divided by that factor, the inner product of a code with another
vector is an unbiased estimate of the cosine, with an error that a confidence bound limits.  A pair is computed
exactly only where the bound reaches the threshold; every link is decided by the exact cosine in double precision.

Vectors are compared within equal labels.  Equal vectors are folded to one with a count first.  The rest of a label
is dealt into blocks by hash, and each pair of blocks is a task row of its own, so a label that holds a third of all
rows is spread over all cores and no group is larger than a block.  A pair of blocks gives link counts and, instead of the
links, one edge per vector to the smallest vector that it reaches there; components follow from those.

Nulls and odd rows: a vector that is null, zero, or holds a null or non-finite component, or has no label or id,
links with nothing.  Vectors of different lengths are not compared.  Repeated rows count as other vectors.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import connected_components, roots
from quillspark.session import materialize

COSINE = 0.93
BLOCK = 1024
#: Code bits per dimension, and width of the confidence bound in standard errors.
BITS_PER_DIMENSION, WIDTH = 2, 6.0
SEED = 7


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """The first ``dimension`` rows of a random orthogonal matrix of the code's length."""
    size = BITS_PER_DIMENSION * dimension
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dimension]


class Codes:
    """Binary codes of unit vectors, one bit per rotated direction, with their correction factors."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        self.rotated = (unit @ turn).astype(np.float32)
        self.bits = np.packbits(self.rotated > 0, axis=1)
        self.size = turn.shape[1]
        self.factor = np.abs(self.rotated).sum(axis=1, dtype=np.float64) / np.sqrt(self.size)

    def signs(self) -> np.ndarray:
        return (np.unpackbits(self.bits, axis=1, count=self.size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.size))

    def estimates(self, others: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of these codes with other vectors, and each code's confidence bound."""
        raw = self.signs() @ others.rotated.T
        bound = np.sqrt(np.maximum(1 / self.factor**2 - 1, 0)) * WIDTH / np.sqrt(self.size - 1)
        return raw / self.factor[:, None].astype(np.float32), bound


def units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of unit vectors with a cosine of at least ``cosine``; within one block each pair once."""
    turn = rotation(a.shape[1])
    estimate, bound = Codes(a, turn).estimates(Codes(b, turn))
    near = estimate >= (cosine - bound - 1e-5)[:, None]
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        keep[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= cosine
    return i[keep], j[keep]


def _block(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    items = column[row].values
    count, vectors = items.field("n").to_numpy(), items.field("vector")
    return units(vectors.flatten().to_numpy().reshape(len(count), -1)), count, items.field("first").to_numpy()


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    names = ["first", "block", "place", "links", "root_first", "root_block", "root_place"]
    for batch in batches:
        for row in range(batch.num_rows):
            g, h = batch.column("block_a")[row].as_py(), batch.column("block_b")[row].as_py()
            a, count_a, first_a = _block(batch.column("items_a"), row)
            b, count_b, first_b = (a, count_a, first_a) if g == h else _block(batch.column("items_b"), row)
            i, j = linked(a, b, g == h, cosine)
            if not len(i):
                continue
            base = 0 if g == h else len(a)
            n = base + len(b)
            links = (np.bincount(i, count_b[j], n) + np.bincount(j + base, count_a[i], n)).astype(np.int64)
            root = roots(n, i, j + base)
            first = first_b if g == h else np.concatenate([first_a, first_b])
            block = np.full(n, h)
            block[:base] = g
            place = np.arange(n) - np.where(np.arange(n) >= base, base, 0)
            hit = np.flatnonzero(links)
            columns = [first[hit], block[hit], place[hit], links[hit], first[root[hit]], block[root[hit]], place[root[hit]]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
                 block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    usable = usable & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(usable, F.col("vector"))).withColumn("label", F.when(usable, F.col("label")))

    distinct = rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").cast("long").alias("first"), F.count("*").alias("n"))
    distinct = materialize(distinct.withColumn("dimension", F.size("vector")), "vectors-distinct")
    sizes = distinct.groupBy("label", "dimension").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks"))
    dealt = distinct.join(sizes, ["label", "dimension"]).withColumn("nth", F.pmod(F.xxhash64("first", "vector"), F.col("blocks")))
    blocks = dealt.groupBy("label", "dimension", "blocks", "nth").agg(F.collect_list(F.struct("first", "n", "vector")).alias("items"))
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "vectors-blocks")

    pair = ["label", "dimension", "i", "j"]
    left = blocks.select("label", "dimension", F.col("nth").alias("i"), F.explode(F.sequence("nth", F.col("blocks") - 1)).alias("j"),
                         F.col("block").alias("block_a"), F.col("items").alias("items_a"))
    right = blocks.select("label", "dimension", F.explode(F.sequence(F.lit(0).cast("long"), "nth")).alias("i"), F.col("nth").alias("j"),
                          F.col("block").alias("block_b"), F.col("items").alias("items_b"))
    schema = "first long, block long, place long, links long, root_first long, root_block long, root_place long"
    tiles = left.join(right, pair).drop(*pair).mapInArrow(lambda batches: _compare(batches, cosine), schema)
    tiles = materialize(tiles, "vectors-tiles")

    node, root = F.struct("first", "block", "place"), F.struct(F.col("root_first").alias("first"), F.col("root_block").alias("block"), F.col("root_place").alias("place"))
    found = connected_components(tiles.select(node.alias("a"), root.alias("b")), "vectors-components")
    degrees = tiles.groupBy("block", "place").agg(F.sum("links").alias("links"))
    known = blocks.select("block", F.posexplode("items").alias("place", "item")).select("block", "place", "item.*")
    # the label is read from the distinct vectors again, as equal vectors of two labels are two entries
    known = known.join(blocks.select("block", "label"), "block")
    known = known.join(degrees, ["block", "place"], "left").join(
        found.select(F.col("node.block").alias("block"), F.col("node.place").alias("place"), F.col("component.first").alias("component")), ["block", "place"], "left"
    )
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    out = rows.join(known, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col("vec_id").cast("long")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
