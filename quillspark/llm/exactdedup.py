"""Exact de-duplication against a history, looked up through a minimal perfect hash over the history's distinct digests.

A text is known by the SHA-256 of what is left of it without the six white-space characters.  The history's distinct
digests are dealt to shards by their first bits, and each shard gets a minimal perfect hash: every digest has a slot
of its own, without gaps.  A slot holds the full digest, how often it occurred and the locator of the row that stays.
A new row's digest is hashed to one slot and compared with the 32 bytes there: equal means a repeat of the history,
anything else a digest that the history lacks; such digests are grouped among themselves.  Rows are folded to one
per digest and partition before they move, so a text that makes up a third of a table costs one row per partition.

Of equal texts the row with the most code points stays, then the one with the smallest id; of rows that agree in both,
one.  Nulls and odd rows: a null text is the empty one, and all texts without a visible character are equal.  A null id
is smaller than any other.  Texts of any length are read whole.  An empty history has no member, an empty table no
row.  Columns other than the id and the text are not read, so their names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Digests that a shard should hold.
SHARD_KEYS = 1 << 16
#: Places per key of a level; two leave about four tenths of the keys to the next level.
SPARE = 2
#: Rows of a digest with more than this share of all rows are joined by broadcast: at most 1 / HOT_SHARE digests.
HOT_SHARE = 0.001


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests.

    Each level is a bit map.  A key that is alone at its place takes it, all others go to the next level.  A key's slot
    is the number of bits before its own, over all levels, so the slots of n keys are 0 .. n-1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = [np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64))) for bits in levels]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        words = keys.view(np.uint64).reshape(-1, 4)
        first = words[:, 0] ^ W.mix(words[:, 2])
        second = words[:, 1] ^ W.mix(words[:, 3])
        return (W.mix(first ^ W.mix(second + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct digests, one per row of 32 bytes."""
        levels, left = [], np.ascontiguousarray(keys)
        while len(left):
            size = -(-len(left) * SPARE // 64) * 64
            places = cls._places(left, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = np.ascontiguousarray(left[~alone[places]])
            if len(levels) > 500:
                raise ValueError("digests of a history must be distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; what is not a member gets any slot, or -1."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        keys = np.ascontiguousarray(keys)
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            places = self._places(np.ascontiguousarray(keys[open_]), level, 64 * len(bits))
            word, bit = bits[places >> 6], (places & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (base + before[places >> 6] + lower)[hit]
            base, open_ = base + int(before[-1]), open_[~hit]
        return out


@dataclass(frozen=True)
class Index:
    """Perfect hash and slots of a history: a written table with a row per shard, and the number of shard bits."""

    table: DataFrame
    bits: int


def _digests(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _shard(bits: int) -> Column:
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.shiftright(first, 32 - bits).cast("int")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: Column | None = None) -> DataFrame:
    """One written row per document: doc_id, digest, chars, row (a number of its own) and old (is it history)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("digest"),
        F.char_length(text).alias("chars"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(history, F.lit(False)).alias("old") if history is not None else F.lit(False).alias("old"),
    )
    return materialize(rows, "exact-rows")


def folded(rows: DataFrame) -> DataFrame:
    """One row per digest: digest, n, best (the locator of the row that stays)."""
    locator = F.struct((-F.col("chars")).alias("rank"), "doc_id", "row")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(locator).alias("best"))


def build_index(history: DataFrame, keys: int | None = None) -> Index:
    """Index over a history of folded rows (a written table); ``keys`` also counts what will be looked up at once."""
    count = max(keys or 0, history.count())
    bits = min(31, max(0, (-(-count // SHARD_KEYS) - 1).bit_length()))
    best = history.schema["best"].dataType.simpleString()

    def slots(rows: pa.Table) -> pa.Table:
        digests = _digests(rows.column("digest"))
        found = PerfectHash.build(digests)
        order = np.argsort(found.slots(digests))
        in_order, everything = rows.take(pa.array(order)), pa.array([0, len(order)], pa.int32())
        return pa.table({
            "shard": rows.column("shard").slice(0, 1),
            "levels": pa.array([[bits.tobytes() for bits in found.levels]], pa.list_(pa.binary())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "counts": pa.ListArray.from_arrays(everything, in_order.column("n").combine_chunks()),
            "best": pa.ListArray.from_arrays(everything, in_order.column("best").combine_chunks()),
        })

    sharded = history.select(_shard(bits).alias("shard"), "digest", "n", "best")
    schema = f"shard int, levels array<binary>, digests binary, counts array<bigint>, best array<{best}>"
    return Index(materialize(sharded.groupBy("shard").applyInArrow(slots, schema), "exact-index"), bits)


def lookup(index: Index, batch: DataFrame) -> DataFrame:
    """What a batch of folded rows makes of the history: digest, seen, new, old_best, new_best.

    A row for every digest that is now there at least twice: slots that the batch hits (the digest there equals the
    row's in all bytes), slots that it leaves alone, and digests that are no members (``seen`` 0).
    """
    best = batch.schema["best"].dataType.simpleString()

    def look(slots: pa.Table, rows: pa.Table) -> pa.Table:
        n_slots, levels, held, counts, olds = 0, [], np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), None
        if slots.num_rows:
            one = {name: slots.column(name)[0] for name in ("levels", "digests", "counts", "best")}
            levels = [np.frombuffer(bits, np.uint64) for bits in one["levels"].as_py()]
            held = np.frombuffer(one["digests"].as_py(), np.uint8).reshape(-1, 32)
            counts, olds, n_slots = one["counts"].values.to_numpy(), one["best"].values, len(held)
        digests = _digests(rows.column("digest"))
        slot = PerfectHash(levels).slots(digests)
        member = slot >= 0
        member[member] = (held[slot[member]] == digests[member]).all(axis=1)
        new = rows.column("n").to_numpy()
        added = np.full(n_slots, -1, np.int64)
        added[slot[member]] = np.flatnonzero(member)  # digests of a batch are distinct, and so are their slots
        kept_slots = np.flatnonzero((added >= 0) | (counts > 1))
        others = np.flatnonzero(~member & (new > 1))
        place = np.concatenate((added[kept_slots], others))
        at = pa.array(np.maximum(place, 0), mask=place < 0)
        news = rows.column("best").combine_chunks().take(at)
        from_slots = pa.array(np.concatenate((kept_slots, np.zeros(len(others), np.int64))),
                              mask=np.arange(len(place)) >= len(kept_slots))
        keys = np.concatenate((held[kept_slots], digests[others]))
        return pa.table({
            "digest": pa.array([k.tobytes() for k in keys], pa.binary()),
            "seen": pa.array(np.concatenate((counts[kept_slots], np.zeros(len(others), np.int64)))),
            "new": pa.array(np.where(place < 0, 0, new[np.maximum(place, 0)] if len(new) else 0)),
            "old_best": olds.take(from_slots) if olds is not None else pa.nulls(len(place), news.type),
            "new_best": news,
        })

    probes = batch.select(_shard(index.bits).alias("shard"), "digest", "n", "best")
    schema = f"digest binary, seen long, new long, old_best {best}, new_best {best}"
    return index.table.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(look, schema)


def verdicts(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Every row with its group: doc_id, digest, old, keep_id, group_size, kept.

    Few digests can hold more than their HOT_SHARE of the rows; these are broadcast and all others are joined by shuffle.
    """
    groups = repeats.select("digest", (F.col("seen") + F.col("new")).alias("group_size"), F.least("old_best", "new_best").alias("best"))
    groups = materialize(groups, "exact-groups")
    hot = F.col("group_size") > F.lit(HOT_SHARE * rows.count())
    common = F.broadcast(groups.where(hot))
    joined = rows.join(common, "digest").unionByName(
        rows.join(common.select("digest"), "digest", "left_anti").join(groups.where(~hot), "digest", "left")
    )
    alone = F.col("best").isNull()
    return joined.select(
        "doc_id", "digest", "old", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
    )


def dedup(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict on every row of a table whose rows are history where ``history`` holds and a new batch elsewhere."""
    rows = digest_rows(docs, id_col, text_col, history)
    old = materialize(folded(rows.where("old")), "exact-history")
    batch = materialize(folded(rows.where("NOT old")), "exact-batch")
    return verdicts(rows, lookup(build_index(old, batch.count()), batch))


def new_documents(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of a new batch whose digest the history lacks, one of each group; their columns as they were.

    Rows that agree in id, digest and length are told apart by nothing else, so all of them stay where one does.
    """
    batch = materialize(folded(digest_rows(docs, id_col, text_col)), "exact-batch")
    known = lookup(index, batch).where("seen > 0 AND new > 0").select("digest")
    stays = batch.join(known, "digest", "left_anti").select("digest", F.col("best.doc_id").alias("id"), (-F.col("best.rank")).alias("chars"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.char_length(text).alias("chars"),
                       F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("digest")).alias("r")
    same = (F.col("r.digest") == F.col("s.digest")) & F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.chars") == F.col("s.chars"))
    return rows.join(stays.alias("s"), same, "left_semi").select(*(F.col(f"doc.`{c}`") for c in docs.columns))
