"""Word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.joins import is_small
from quillspark.session import materialize

#: Query vectors that travel to the table at once, in numbers (8 bytes each).
BLOCK_NUMBERS = 4_000_000
#: Rows that a bucket of the random projections holds on average.
BUCKET_ROWS = 256
#: Tables of random projections.
TABLES = 8
#: The number of bits is lowered until so large a share of the true neighbours of so many sampled queries is met.
RECALL, SAMPLED = 0.95, 200
#: Query rows are broadcast up to this size as text.
PROBE_CHARS = 64_000_000


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar_words(df: DataFrame, key, k: int = 5, key_col: str = "word", vector_col: str = "vector") -> DataFrame:
    """The ``k`` nearest entries to one key by cosine.

    The key's vector is a scalar subquery, so the table is scored where it lies
    and only ``k`` rows per partition move.
    """
    query = df.where(F.col(key_col) == key).agg(F.first(vector_col)).scalar()
    scored = df.where(F.col(key_col) != key).select(key_col, F.col(vector_col).alias("_v"), query.alias("_q"))
    ranked = scored.select(key_col, cosine(F.col("_v"), F.col("_q")).alias("similarity"))
    return ranked.orderBy(F.desc_nulls_last("similarity"), F.asc(key_col)).limit(k)


def _entries(df: DataFrame, key_col: str, vector_col: str) -> DataFrame:
    """Distinct (key, vector, norm) rows whose vector has a direction."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(key_col).alias("key"), vector.alias("vector")).where("key is not null and vector is not null")
    rows = rows.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    # a null or NaN component makes the norm null or NaN, which no comparison lets through
    return rows.where((F.col("norm") > 0) & (F.col("norm") < float("inf"))).distinct()


def _first_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of entries with equal vectors the ``k + 1`` smallest keys: no other can be among anyone's ``k`` nearest."""
    copies = Window.partitionBy("vector").orderBy("key")
    return rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best pairs of each query; a partition passes on no more than ``k`` of a query."""
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", F.col("key").alias("neighbour"), "similarity")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, key_col: str = "word", vector_col: str = "vector") -> DataFrame:
    """The ``k`` nearest entries of ``df`` to every row of ``queries`` by cosine, exactly: query, rank, neighbour, similarity.

    The queries go to the table in blocks of a fixed number of components, and every Arrow batch of the table meets a
    block in one matrix product, of which the ``k`` best of each query go on (all that tie with the last one); no row
    of the table moves for it.  Entries with equal vectors are folded as in ``neighbours``.  Cost is queries times rows, so this is for a bounded set of queries, and for the recall of ``neighbours``.

    Keys are unique or their rows count apart, repeated rows count once; a key is never its own neighbour.  Vectors that are
    null, zero or hold a null or non-finite component neither have nor are neighbours; nor do vectors of different lengths meet.
    """
    spark = df.sparkSession
    rows, asked = _entries(df, key_col, vector_col), _entries(queries, key_col, vector_col)
    kind = rows.schema["key"].dataType.simpleString()
    asked = asked.withColumn("size", F.size("vector"))
    sizes = {r["size"]: (r["n"] * r["size"] + BLOCK_NUMBERS - 1) // BLOCK_NUMBERS for r in asked.groupBy("size").agg(F.count("*").alias("n")).collect()}
    number = F.lit(0)
    for size, blocks in sizes.items():  # one entry per vector length
        number = F.when(F.col("size") == size, F.pmod(F.xxhash64("key", "vector"), F.lit(blocks))).otherwise(number)
    asked = materialize(asked.withColumn("block", number.cast("long")), "nearest-queries")
    rows = materialize(_first_copies(rows, k).drop("copy"), "nearest-rows")
    out = None
    for size, blocks in sorted(sizes.items()):
        for block in range(blocks):
            here = asked.where((F.col("size") == size) & (F.col("block") == block)).select("key", "vector", "norm").toArrow()
            if not here.num_rows:
                continue
            sent = spark.sparkContext.broadcast((here.column("key").combine_chunks(), _matrix(here.column("vector").combine_chunks())
                                                 / here.column("norm").to_numpy()[:, None]))
            found = rows.where(F.size("vector") == size).mapInArrow(_meet(sent, k), f"query {kind}, key {kind}, similarity double")
            found = materialize(_best(found.where("query <> key"), k), "nearest-block")
            sent.unpersist()
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query {kind}, rank int, neighbour {kind}, similarity double")


def _meet(sent, k: int):
    """Meets each batch of (key, vector, norm) with the broadcast queries; every pair not below a query's k + 1st of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, units = sent.value
        step = max(1, (1 << 22) // max(len(keys), 1))  # 32 MB of products at once
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vectors = _matrix(part.column("vector")) / part.column("norm").to_numpy()[:, None]
                products = units @ vectors.T
                if products.shape[1] > k + 1:  # one place more: the query itself may be among them
                    least = np.partition(products, -k - 1, axis=1)[:, -k - 1]
                    left, right = np.nonzero(products >= least[:, None] - 1e-12)
                else:
                    left, right = (x.ravel() for x in np.indices(products.shape))
                # the sum of a pair's own products, which does not depend on the batch
                exact = np.einsum("ij,ij->i", units[left], vectors[right])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(left)), part.column("key").take(pa.array(right)), pa.array(exact)], names=["query", "key", "similarity"])

    return run


def _signs(vectors: np.ndarray, tables: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and table the signs of its projections as a number, and the bit with the smallest projection."""
    size = vectors.shape[1]
    planes = np.random.default_rng((seed, size)).normal(size=(size, tables * bits))
    z = (vectors @ planes).reshape(len(vectors), tables, bits)
    return (z > 0) @ (1 << np.arange(bits)), 1 << np.argmin(np.abs(z), axis=2)


def projection_codes(rows: DataFrame, tables: int, bits: int, seed: int = 0) -> DataFrame:
    """Adds ``codes``, a number of ``bits`` signs of random projections for each of the ``tables``, and ``weak``, in each of
    them the bit with the smallest projection.  The projections follow from the seed and the vector's length alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            codes, weak = np.zeros((batch.num_rows, tables), np.int64), np.zeros((batch.num_rows, tables), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                codes[at], weak[at] = _signs(_matrix(batch.column("vector").take(pa.array(at))), tables, bits, seed)
            offsets = pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (codes, weak)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "codes", "weak"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, codes array<bigint>, weak array<bigint>")


def _fitting_bits(rows: DataFrame, asked: DataFrame, k: int, tables: int, most: int, seed: int) -> int:
    """The largest number of bits, ``most`` at most, whose buckets hold ``RECALL`` of the true neighbours of ``SAMPLED`` queries."""
    sample = materialize(asked.orderBy(F.xxhash64("key", "vector")).limit(SAMPLED).drop("norm"), "near-sample")
    pairs = nearest(rows.drop("norm", "copy"), sample, k, "key", "vector")
    pairs = pairs.join(rows.select(F.col("key").alias("neighbour"), F.col("vector").alias("b")), "neighbour")
    pairs = pairs.join(F.broadcast(sample.select(F.col("key").alias("query"), F.col("vector").alias("a"))), "query")
    groups: dict[int, list] = {}
    for r in pairs.where(F.size("a") == F.size("b")).select("a", "b").collect():  # at most ``SAMPLED`` x ``k`` pairs where keys are unique
        groups.setdefault(len(r["a"]), []).append((r["a"], r["b"]))
    sides = [np.array(group).transpose(1, 0, 2) for group in groups.values()]
    for bits in range(most, 1, -1):
        met = []
        for a, b in sides:
            (of_a, weak), (of_b, _) = _signs(a, tables, bits, seed), _signs(b, tables, bits, seed)
            met.append(((of_a == of_b) | (of_a ^ weak == of_b)).any(axis=1))
        if not met or np.concatenate(met).mean() >= RECALL:
            return bits
    return 1


def neighbours(df: DataFrame, queries: DataFrame, k: int = 5, key_col: str = "word", vector_col: str = "vector",
               tables: int = TABLES, bits: int | None = None, seed: int = 0) -> DataFrame:
    """Nearly the ``k`` nearest entries of ``df`` to every row of ``queries``, found through buckets of random projections and
    ranked by exact cosine: query, rank, neighbour, similarity.

    A vector lies in one bucket of each table, a query looks into its own and into the one behind its nearest plane.  The number of
    bits follows the number of distinct vectors, so that a bucket holds ``BUCKET_ROWS`` on average, unless a sample of ``SAMPLED`` queries,
    answered exactly, shows that fewer bits are needed to meet ``RECALL`` of the neighbours (vectors close to noise have large buckets).  A pair that meets in several
    tables is scored in the first of them only, so no pair is shuffled to be made distinct.  While the queries are small (counted) they are broadcast
    and the table stays in place.  Of entries with equal vectors only the ``k + 1`` smallest keys are
    kept (no other can be among anyone's nearest), so a vector that makes up a third of the table does not fill its buckets.

    Keys, nulls, repeated rows and odd vectors are treated as in ``nearest``.
    """
    rows, asked = _entries(df, key_col, vector_col), _entries(queries, key_col, vector_col)
    rows = materialize(_first_copies(rows, k), "near-rows")
    if bits is None:
        most = max(1, min(62, (rows.where("copy = 1").count() // BUCKET_ROWS).bit_length()))
        bits = _fitting_bits(rows, asked, k, tables, most, seed)
    base = projection_codes(rows.drop("copy"), tables, bits, seed)
    base = base.select("key", "vector", "norm", "codes", F.posexplode("codes").alias("t", "bucket"))
    probes = projection_codes(asked, tables, bits, seed).withColumn(
        "others", F.zip_with("codes", "weak", lambda c, w: c.bitwiseXOR(w)))
    probes = probes.select(
        F.col("key").alias("query"), F.col("vector").alias("q_vector"), F.col("norm").alias("q_norm"), F.col("codes").alias("q_codes"),
        "others", F.posexplode(F.arrays_zip("codes", "others")).alias("t", "both"))
    probes = probes.select("query", "q_vector", "q_norm", "q_codes", "others", "t", F.explode(F.array("both.codes", "both.others")).alias("bucket"))
    probes = materialize(probes, "near-probes")
    if is_small(probes, max_chars=PROBE_CHARS):
        probes = F.broadcast(probes)
    met = base.join(probes, ["t", "bucket"]).where((F.col("query") != F.col("key")) & (F.size("vector") == F.size("q_vector")))
    hit = F.zip_with("codes", F.arrays_zip("q_codes", "others"), lambda c, q: (c == q["q_codes"]) | (c == q["others"]))
    met = met.where(F.array_position(hit, F.lit(True)) == F.col("t") + 1)
    similarity = dot(F.col("vector"), F.col("q_vector")) / (F.col("norm") * F.col("q_norm"))
    return _best(met.select("query", "key", similarity.alias("similarity")), k)
