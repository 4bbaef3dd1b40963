"""Near-duplicate documents by BagMinHash signatures of their shingle multisets.

A document is the multiset of its five-word shingles.  Every shingle owns a Poisson process of points over
(time, component, weight level), the same in all documents.  Weight is discretised into units and the levels are
grouped into dyadic intervals (0,1], (1,2], (2,4], ...; a point of an interval counts if the level that its bits pick lies
below the shingle's weight, so a process is refined only where a weight cuts its interval.  A component's value is
the first counting point, and two documents agree in a component with probability sum(min) / sum(max) of their
weights, the weighted Jaccard similarity.  Points are drawn in order of time and only until all components of a document
are filled, so the work follows the length of the text plus a constant.

Candidates share a band.  Every bucket first compares its members with one centre by the exact multiset overlap of
the texts.  Members of an overlap of ``NEAR`` or more form a neighbourhood; where it holds more than one class after
that, all its members are compared, block against block, and a pair of blocks gives one edge per document to
the smallest one it reaches.  Two members of a bucket outside its centre's neighbourhood are compared pair by pair.
As 1 - similarity is a metric, a pair of 0.8 in a bucket is either inside one neighbourhood or has both ends
farther than ``FAR`` from the centre, so no candidate is lost, while a bucket of copies costs one comparison per copy.

Nulls and odd rows: a text of one to four words is one shingle; a null text or one without words has none and
links with nothing.  Exact copies are joined by a content key before banding.  Rows that share an id are one document,
linked if any of its texts is; a null id is never linked.  An empty table gives an empty result.  Other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.components import connected_components, roots
from quillspark.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: Similarity to a bucket's centre from which a document belongs to its neighbourhood, and below which it counts as far:
#: of two documents within 0.2 of each other, one outside (above 1 - NEAR) means that both are above 1 - NEAR - 0.2.
NEAR, FAR = 0.3, 0.5
#: Documents of one block when a neighbourhood is compared.
BLOCK = 128


def shingle_hashes(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts and where each text's begin; short texts are one shingle."""
    hashes, inside = W.window_hashes(codes, bounds, SHINGLE)
    sizes = np.diff(bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if not len(short):
        return hashes, inside
    extra = np.zeros(len(short), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE - 1):
            has = sizes[short] > k
            extra[has] = W.mix(extra[has] + codes[bounds[:-1][short[has]] + k])
        extra = W.mix(extra + sizes[short].astype(np.uint64))
    text = np.concatenate([W.owners(inside), short])
    order = np.argsort(text, kind="stable")
    counts = np.bincount(text, minlength=len(sizes))
    return np.concatenate([hashes, extra])[order], np.concatenate(([0], np.cumsum(counts)))


def bags(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: their text, hash and weight."""
    text = W.owners(bounds)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    places = np.flatnonzero(new)
    return text[places], hashes[places], np.diff(np.append(places, len(text)))


def bag_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n_texts x size) of bags; infinity where a text has no element."""
    out = np.full((n_texts, size), np.inf)
    total = np.bincount(text, weight, n_texts)
    todo, slack = total > 0, 4.0
    while todo.any():
        until = np.where(todo, size / np.maximum(total, 1) * (np.log(size) + slack), 0.0)
        signature = np.full(n_texts * size, np.inf)
        use = todo[text]
        t, e, w = text[use], element[use], weight[use]
        level, longest = 0, int(w.max())
        while level == 0 or 1 << (level - 1) < longest:  # intervals (0,1], (1,2], (2,4], ...
            low = 0 if level == 0 else 1 << (level - 1)
            rate = float(max(low, 1))
            inside = w > low
            a, seed, cut = t[inside], W.mix(e[inside] + np.uint64(level + 1)), w[inside] - low
            at, k = np.zeros(len(a)), 0
            while len(a):
                with np.errstate(over="ignore"):
                    bits = W.mix(seed + np.uint64(2 * k))
                    more = W.mix(seed + np.uint64(2 * k + 1))
                at = at - np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
                alive = at <= until[a]
                a, seed, cut, at, more = a[alive], seed[alive], cut[alive], at[alive], more[alive]
                counts = (more >> np.uint64(32)).astype(np.int64) % max(low, 1) < cut
                slot = a * size + (more & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
                np.minimum.at(signature, slot[counts], at[counts])
                k += 1
            level += 1
        signature = signature.reshape(n_texts, size)
        filled = todo & np.isfinite(signature).all(axis=1)
        out[filled] = signature[filled]
        todo, slack = todo & ~filled, slack * 2
    return out


def sign_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle count, content key (two 64-bit halves) and signature of each text."""
    words, bounds = W.split_words(W.as_strings(texts))
    codes, dictionary = W.encode(words)
    hashes, inside = shingle_hashes(W.hash_words(dictionary)[codes], bounds)
    text, element, weight = bags(hashes, inside)
    key = np.zeros((len(texts), 2), np.uint64)
    with np.errstate(over="ignore"):
        for half in range(2):
            np.add.at(key[:, half], text, W.mix(element ^ W.mix(weight.astype(np.uint64) + np.uint64(7 * half))))
    return np.diff(inside), key, bag_minhash(text, element, weight, len(texts))


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(signatures), 1))
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = W.mix(keys * np.uint64(31) + bits[:, :, r])
    return keys


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, key1, key2 and the array ``bands``, for texts with a word."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", W.SLICE):
            counts, key, signatures = sign_batch(batch.column("text"))
            keep = counts > 0
            bands = band_keys(signatures[keep])
            lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.view(np.int64).ravel()))
            key = key[keep].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(pa.array(keep)), pa.array(counts[keep]), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), lists],
                names=["doc_id", "n_shingles", "key1", "key2", "bands"],
            )

    return narrow.mapInArrow(run, f"doc_id {kind}, n_shingles long, key1 long, key2 long, bands array<long>")


def bag_of(text: str | None) -> Counter:
    words = (text or "").encode().split()
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def overlap(a: Counter, b: Counter) -> tuple[int, int]:
    """Sum of the smaller and of the larger weights."""
    if len(a) > len(b):
        a, b = b, a
    common = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return common, a.total() + b.total() - common


def compare(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) with the weighted Jaccard similarity of their texts; the largest where an id has several texts."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    kind = both.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = lru_cache(maxsize=64)(bag_of)  # pairs come with their centre, time and again
        for batch in batches:
            found = [overlap(bag_of(x), bag(y)) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
            found = np.array([common / union if union else 0.0 for common, union in found])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bags as sets: (text, element), the n-th occurrence of a shingle being an element of its own."""
    words, bounds = W.split_words(W.as_strings(texts))
    codes, dictionary = W.encode(words)
    hashes, inside = shingle_hashes(W.hash_words(dictionary)[codes], bounds)
    text, element, weight = bags(hashes, inside)
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return np.repeat(text, weight), W.mix(np.repeat(element, weight) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n_a: int, n_b: int) -> np.ndarray:
    """Common elements of every text of a and every text of b."""
    shared = np.intersect1d(a[1], b[1])
    out, width = np.zeros((n_a, n_b), np.float32), 4096
    for at in range(0, len(shared), width):
        part, sides = shared[at : at + width], []
        for (text, element), n in ((a, n_a), (b, n_b)):
            place = np.minimum(np.searchsorted(part, element), len(part) - 1)
            hit = part[place] == element
            side = np.zeros((n, len(part)), np.float32)
            side[text[hit], place[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _tiles(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            left, right = batch.column("left")[row].values, batch.column("right")[row].values
            same = batch.column("same")[row].as_py()
            a, n_a = elements(left.field("text")), len(left)
            b, n_b = (a, n_a) if same else (elements(right.field("text")), len(right))
            common = overlaps(a, b, n_a, n_b)
            size_a, size_b = np.bincount(a[0], minlength=n_a), np.bincount(b[0], minlength=n_b)
            i, j = np.nonzero((common > 0) & (common >= similarity * (size_a[:, None] + size_b[None, :] - common) - 1e-4))
            base = 0 if same else n_a
            root = roots(base + n_b, i, j + base)
            hit = pa.array(np.flatnonzero(root != np.arange(len(root))))
            ids = right.field("doc_id") if same else pa.concat_arrays([left.field("doc_id"), right.field("doc_id")])
            yield pa.RecordBatch.from_arrays([ids.take(hit), ids.take(pa.array(root).take(hit))], names=["a", "b"])


def link_inside(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Edges that join the linked ones among all members (doc_id, cluster) of each cluster."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks"))
    rows = members.join(sizes, "cluster").withColumn("nth", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rows = rows.join(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    blocks = rows.groupBy("cluster", "blocks", "nth").agg(F.collect_list(F.struct("doc_id", "text")).alias("items"))
    blocks = materialize(blocks, "minhash-blocks")
    left = blocks.select("cluster", F.col("nth").alias("i"), F.explode(F.sequence("nth", F.col("blocks") - 1)).alias("j"), F.col("items").alias("left"))
    right = blocks.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), "nth")).alias("i"), F.col("nth").alias("j"), F.col("items").alias("right"))
    kind = members.schema["doc_id"].dataType.simpleString()
    tiles = left.join(right, ["cluster", "i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "left", "right")
    return tiles.mapInArrow(lambda batches: _tiles(batches, similarity), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Classes of more than one document: (node, component), component being the class's smallest id."""
    signed = materialize(sign(docs, id_col, text_col), "minhash-signed")
    firsts = signed.groupBy("key1", "key2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1"), "minhash-copies")
    marked = signed.join(firsts, ["key1", "key2"], "left")
    copies = marked.where("first <> doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    single = marked.where("first IS NULL OR first = doc_id")
    members = single.select(F.col("doc_id").alias("member"), F.explode(F.array_distinct("bands")).alias("band")).distinct()
    members = materialize(members, "minhash-bands")
    buckets = members.groupBy("band").agg(F.min("member").alias("centre"), F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(buckets.select("band", "centre"), "band"), "minhash-buckets")

    stars = members.where("member <> centre").select(F.col("member").alias("a"), F.col("centre").alias("b")).distinct()
    scored = materialize(compare(materialize(stars, "minhash-pairs"), docs, id_col, text_col), "minhash-scored")
    links = materialize(scored.where(F.col("similarity") >= similarity - 1e-9).select("a", "b").unionByName(copies), "minhash-links")
    found = materialize(connected_components(links, "minhash-components"), "minhash-found")
    near = connected_components(scored.where(F.col("similarity") >= NEAR).select("a", "b"), "minhash-components")
    near = materialize(near.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "minhash-near")

    # neighbourhoods that still hold more than one class
    placed = near.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("class")), "doc_id", "left")
    split = placed.groupBy("cluster").agg(F.count_distinct(F.coalesce("class", "doc_id")).alias("n")).where("n > 1").select("cluster")
    inside = link_inside(near.join(split, "cluster"), docs, id_col, text_col, similarity)
    # members of a bucket far from its centre, and not of one neighbourhood
    far = members.join(scored.where(F.col("similarity") < FAR).select(F.col("a").alias("member"), F.col("b").alias("centre")), ["member", "centre"])
    far = materialize(far.join(near.withColumnRenamed("doc_id", "member"), "member", "left").select("band", "member", F.coalesce("cluster", "member").alias("cluster")), "minhash-far")
    pairs = far.toDF("band", "a", "cluster_a").join(far.toDF("band", "b", "cluster_b"), "band").where("a < b AND cluster_a <> cluster_b")
    outside = compare(materialize(pairs.select("a", "b").distinct(), "minhash-rest"), docs, id_col, text_col)
    outside = outside.where(F.col("similarity") >= similarity - 1e-9).select("a", "b")
    return connected_components(links.unionByName(inside).unionByName(outside), "minhash-components")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: its id, class_id (the smallest id of its class) and whether it is the one to keep."""
    found = near_duplicates(docs, id_col, text_col, similarity)
    ids = docs.select(F.col(id_col).alias("doc_id"))
    rows = ids.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, all columns as they were; of rows that share an id one stays."""
    found = near_duplicates(docs, id_col, text_col, similarity)
    gone = found.where("node <> component").select(F.col("node").alias(id_col))
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    again = materialize(docs.groupBy(id_col).count().where(F.col("count") > 1).where(F.col(id_col).isNotNull()).select(id_col), "minhash-again")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(repeated)
