"""Terms of posts by block, for tables of terms that no single machine holds.

A block is a run of posts with a dictionary of its own: its distinct terms once, and each post as numbers into them.  Only a
block's distinct terms are shuffled to meet a table of terms (a vocabulary, a lemma list); what the table says comes back to
the block as one array, and the posts are worked out from numbers.  A term that makes up a third of all tokens is one row per block.

A null list of terms is an empty one and null entries are left out.  Repeated posts stay, and an empty table has no block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.joins import term_join
from quillspark.session import materialize

#: Bytes of terms in a block (a post is never cut).
BLOCK_BYTES = 8 << 20


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed with their low bytes first."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(numbers) else b"")


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def runs(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Runs of posts with about BLOCK_BYTES of terms each."""
    offsets, terms = lists.offsets.to_numpy(), lists.values
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(terms), 0).to_numpy(), dtype=np.int64)))[offsets[1:]]
    run = (ends - (ends[0] if len(ends) else 0)) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(lists)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def term_blocks(df: DataFrame, terms_col: str, keep: list[str]) -> DataFrame:
    """One written row per block: block, posts (structs of the kept columns), sizes and codes (packed), terms and their counts."""
    terms = F.filter(F.coalesce(terms_col, F.array().cast("array<string>")), lambda t: t.isNotNull())
    rows = encode(df.select(F.struct(*keep).alias("post"), terms.alias("terms")))
    return materialize(rows.withColumn("block", F.monotonically_increasing_id()), "term-blocks")


def encode(narrow: DataFrame) -> DataFrame:
    """The blocks of rows (post, terms), not written and without a number; no list of terms and no term is null."""
    kind = narrow.schema["post"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in runs(batch.column("terms")):
                lists, posts = batch.column("terms").slice(start, end - start), batch.column("post").slice(start, end - start)
                coded = lists.flatten().dictionary_encode()
                codes = coded.indices.to_numpy()
                whole = pa.array([0, len(posts)], pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "posts": pa.ListArray.from_arrays(whole, pa.concat_arrays([posts])), "sizes": pa.array([pack(np.diff(lists.offsets.to_numpy()))], pa.binary()),
                    "codes": pa.array([pack(codes)], pa.binary()),
                    "terms": pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
                    "counts": pa.array([np.bincount(codes, minlength=len(coded.dictionary))], pa.list_(pa.int64())),
                })

    return narrow.mapInArrow(run, f"posts array<{kind}>, sizes binary, codes binary, terms array<string>, counts array<bigint>")


def term_totals(blocks: DataFrame) -> DataFrame:
    """(term, total) over all blocks."""
    entries = blocks.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))).alias("e"))
    return entries.groupBy("e.term").agg(F.sum("e.n").alias("total"))


def index_terms(totals: DataFrame) -> DataFrame:
    """A written table with a ``place`` for every term: 0, 1, .. without gaps, by falling total, then by term.

    The terms are range-partitioned and numbered inside each partition; a partition's first place is the number of terms
    before it.  No more than a count per partition leaves the executors.
    """
    order = (F.desc("total"), F.asc("term"))
    ranked = totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    ranked = materialize(ranked.select("*", F.shiftright("_row", 33).alias("_part")), "term-ranks")
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    firsts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranked.join(F.broadcast(firsts), "_part").withColumn("place", F.col("_first") + inside)
    return materialize(placed.drop("_row", "_part", "_first"), "term-index")


def look_up(blocks: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The blocks with ``found_keys`` and ``found``: which of their terms the table holds, and its value for them.

    ``table`` is written and has one row per term; it is broadcast only if small.
    """
    terms = blocks.select("block", F.posexplode("terms").alias("key", "term"))
    hits = term_join(terms, table.select("term", F.col(value).alias("value")), "term")
    answers = hits.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("a"))
    answers = answers.select("block", F.col("a.key").alias("found_keys"), F.col("a.value").alias("found"))
    return blocks.join(answers, "block", "left")


def _post_columns(posts: pa.StructArray, keep: list[str], rows: np.ndarray | None = None) -> list[pa.Array]:
    return [posts.field(k) if rows is None else posts.field(k).take(pa.array(rows)) for k in range(len(keep))]


def count_vectors(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Sparse count vectors of the posts: the kept columns, places (rising), terms and values.

    Terms without a place are left out; a post without any has empty arrays.
    """
    fields = blocks.schema["posts"].dataType.elementType
    keep = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                posts, terms = row["posts"].values, row["terms"].values
                at, places = (row[c].values.to_numpy() if row[c].is_valid else np.zeros(0, np.int64) for c in ("found_keys", "found"))
                by_place = np.argsort(places)
                rank = np.full(len(terms), -1, np.int64)
                rank[at[by_place]] = np.arange(len(at))
                codes = rank[unpack(row["codes"].as_py())] if len(terms) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(posts)), unpack(row["sizes"].as_py()))
                entry, n = np.unique((owner * max(len(at), 1) + codes)[codes >= 0], return_counts=True)
                owner, code = entry // max(len(at), 1), entry % max(len(at), 1)
                bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(posts))))), pa.int32())
                arrays = [places[by_place][code], terms.take(pa.array(at[by_place][code])), n.astype(float)]
                yield pa.RecordBatch.from_arrays(
                    [*_post_columns(posts, keep), *(pa.ListArray.from_arrays(bounds, pa.array(a) if isinstance(a, np.ndarray) else a) for a in arrays)],
                    names=[*keep, "places", "terms", "values"],
                )

    rows = look_up(blocks.select("block", "posts", "sizes", "codes", "terms"), index, "place").select("posts", "sizes", "codes", "terms", "found_keys", "found")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{kinds}, places array<bigint>, terms array<string>, values array<double>")


def replace_terms(blocks: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The posts with every term that the table holds replaced by its value: the kept columns and ``terms``."""
    fields = blocks.schema["posts"].dataType.elementType
    keep = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                terms = row["terms"].values
                if row["found"].is_valid:
                    hit = np.full(len(terms), -1, np.int64)
                    hit[row["found_keys"].values.to_numpy()] = np.arange(len(row["found_keys"].values))
                    new = row["found"].values.take(pa.array(np.maximum(hit, 0)))
                    terms = pc.if_else(pa.array(hit >= 0), new, terms)
                bounds = pa.array(np.concatenate(([0], np.cumsum(unpack(row["sizes"].as_py())))), pa.int32())
                out = pa.ListArray.from_arrays(bounds, terms.take(pa.array(unpack(row["codes"].as_py()))))
                yield pa.RecordBatch.from_arrays([*_post_columns(row["posts"].values, keep), out], names=[*keep, "terms"])

    rows = look_up(blocks.select("block", "posts", "sizes", "codes", "terms"), table, value).select("posts", "sizes", "codes", "terms", "found_keys", "found")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{kinds}, terms array<string>")


def lemmatize_posts(df: DataFrame, lemmas: DataFrame, tokens_col: str, keep: list[str]) -> DataFrame:
    """The posts' tokens in lower case, those in the (term, lemma) table of any size replaced by their lemma: kept columns and ``terms``."""
    lower = df.select(*keep, F.transform(tokens_col, F.lower).alias(tokens_col))
    return replace_terms(term_blocks(lower, tokens_col, keep), lemmas, "lemma")
