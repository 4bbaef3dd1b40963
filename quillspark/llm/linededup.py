"""Line de-duplication by an exact set-similarity join.

A line is the set of its words.  Words are put in one global order, rarest first.  Two sets with Jaccard
similarity t or more share a word within a short prefix of that order, at places that leave room for the overlap
needed (positional filter), and their sizes differ by a factor of at most t (length filter).  A bit map of each set
bounds the symmetric difference from below.  What passes is verified on the words themselves.  A line goes if an
earlier line, by (id, row hash, line number), is that similar.

Rarity comes from one count over all words, kept by hash in a table of fixed size (2^24 bytes); any order gives the
same result, so shared entries cost time only.  The lines to verify are picked from the texts by a bit map of fixed size.
Nothing else is broadcast.  Equal sets are folded before the
join, so a line that fills a third of the corpus is one set.  A set only needs one earlier match: each prefix word
proposes the nearest ``TRIES`` earlier candidates, and the one proposed most often is verified first.  Sets for which it
fails and that have others are compared with all candidates where their postings meet, with the lines at hand, until one
holds.  So a group of thousands of variants gives a few rows per variant and word, not all pairs.  The map has bits enough for long lines,
so that few sets are left for this round, in which lines travel with their postings.

Nulls and odd rows: a null text, an empty one, and lines without a word are left as they are.  A document without an
id is left whole.  Rows that share id and text are one document; both lose the same lines.  An empty table gives an
empty result.  Other columns are not read by the join; ``drop_repeated_lines`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.session import discard, materialize, shuffles_dropped

SIMILARITY = 0.8
#: Entries of the rarity table, and of one part of it as it travels.
RARITY_BITS, PART = 24, 1 << 16
#: Bits of the map that lines to verify are picked by.
PICK_BITS = 26
#: Candidates that a set tries at a prefix word before the exhaustive second round.
TRIES = 1
#: Columns of a set's map, 64 bits each.
MAPS = ["m0", "m1"]


def needed(total: np.ndarray, t: float) -> np.ndarray:
    """Smallest overlap of two sets with ``total`` words together and similarity t."""
    return np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL")


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """For each hash bucket, 8 log2 of the number of words in it (0: one word or none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << RARITY_BITS, np.int32)
        for batch in W.slices(batches, "text", W.SLICE):
            hashes = W.hashed_words(W.as_strings(batch.column("text")))[0]
            bucket, n = np.unique(hashes >> np.uint64(64 - RARITY_BITS), return_counts=True)
            seen[bucket.astype(np.int64)] += n.astype(np.int32)
        hit = np.flatnonzero(seen)
        for at in range(0, len(hit), 1 << 16):
            part = hit[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part].astype(np.int64))], names=["bucket", "n"])

    def pack(table: pa.Table) -> pa.Table:
        out = np.zeros(PART, np.uint8)
        level = np.minimum(8 * np.log2(table.column("n").to_numpy()), 255).astype(np.uint8)
        bucket = table.column("bucket").to_numpy()
        out[bucket % PART] = level
        return pa.table({"part": pa.array([int(bucket[0] // PART)], pa.int64()), "levels": pa.array([out.tobytes()])})

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    with shuffles_dropped(docs.sparkSession):
        parts = counts.groupBy(F.floor(F.col("bucket") / PART)).applyInArrow(pack, "part long, levels binary").collect()  # at most 2^24 bytes whatever the input
    levels = np.zeros(1 << RARITY_BITS, np.uint8)
    for row in parts:
        levels[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(row["levels"], np.uint8)
    return levels


class LineSets:
    """Word sets of the lines of a batch: distinct words of each line in the global order."""

    def __init__(self, texts: pa.Array, levels: np.ndarray | None = None):
        hashes, starts, data, bounds, others = W.hashed_words(texts, both=True)
        feeds = np.flatnonzero(data == 10)
        text = np.searchsorted(bounds, starts, side="right") - 1
        # lines are counted through the batch; a text begins one as a line feed does
        line = np.searchsorted(feeds, starts) + text
        self.first_line = np.searchsorted(feeds, bounds[:-1]) + np.arange(len(bounds) - 1)
        keys = hashes
        if levels is not None:
            keys = (levels[(hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes & np.uint64((1 << 56) - 1))
        if len(line) and line[-1] < 1 << 22:  # one sort by line and the upper bits of the order
            order = np.argsort((line.astype(np.uint64) << np.uint64(42)) | (keys >> np.uint64(22)))
        else:
            order = np.lexsort((keys, line))
        line, keys, token, other = line[order], keys[order], hashes[order], others[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1]) | (other[1:] != other[:-1])
        self.line, self.key, token, other = line[new], keys[new], token[new], other[new]
        self.full, self.start, self.size = np.unique(self.line, return_index=True, return_counts=True)
        with np.errstate(over="ignore"):
            self.ids = [np.add.reduceat(W.mix(t), self.start) if len(t) else t for t in (token, other)]  # two independent hashes: 128 bits
        mixed = W.mix(token)
        bit, part = np.uint64(1) << (mixed & np.uint64(63)), (mixed >> np.uint64(6)) % np.uint64(len(MAPS))
        self.maps = [np.bitwise_or.reduceat(np.where(part == k, bit, np.uint64(0)), self.start) if len(token) else token for k in range(len(MAPS))]

    def owner(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line with a word, its text's place in the batch and its number in the text."""
        text = np.searchsorted(self.first_line, self.full, side="right") - 1
        return text, self.full - self.first_line[text]

    def prefixes(self, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix words that occur more than once: bounds per line, keys and places."""
        size = np.repeat(self.size, self.size)
        place = np.arange(len(self.line)) - np.repeat(self.start, self.size)
        use = (place <= size - np.ceil(t * size - 1e-9)) & (self.key >> np.uint64(56) > 0)
        counts = np.add.reduceat(use, self.start) if len(use) else np.zeros(0, np.int64)
        short = (self.key[use] & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # 32 bits to meet by; what meets by chance fails later
        return np.concatenate(([0], np.cumsum(counts))).astype(np.int32), short, place[use]


def line_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per line with a word: its place, its set's identity, size, map and prefix."""
    levels = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col))
    narrow = _narrow(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row", "line_no", "s1", "s2", "n", "prefix", "places", *MAPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", W.SLICE):
            sets = LineSets(W.as_strings(batch.column("text")), levels.value)
            text, number = sets.owner()
            bounds, keys, places = sets.prefixes(similarity)
            take = pa.array(text)
            longs = [pa.array(x.view(np.int64)) for x in (*sets.ids, *sets.maps)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(number.astype(np.int32)), longs[0], longs[1],
                 pa.array(sets.size.astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(keys.view(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(places.astype(np.int32))), *longs[2:]],
                names=names,
            )

    return narrow.mapInArrow(run, f"doc_id {kind}, row long, line_no int, s1 long, s2 long, n int, prefix array<int>, places array<int>, " + ", ".join(f"{c} long" for c in MAPS))


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Postings sorted by (key, set), cut between keys only."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        key = table.column("key").to_numpy()
        other = key[::-1] != key[-1]
        cut = len(key) - int(np.argmax(other)) if other.any() else 0  # the last key may go on in the next batch
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


class Postings:
    """Postings of whole keys, sorted by (key, set), and which of their pairs the filters let pass."""

    def __init__(self, table: pa.Table, t: float):
        get = lambda c: table.column(c).to_numpy()
        key, packed = get("key"), get("packed")
        self.t, self.sets, self.maps = t, get("set"), [get(c).view(np.uint64) for c in MAPS]
        self.n, self.place = packed >> 32, packed & 0xFFFFFFFF
        everyone = np.arange(len(key))
        self.first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), everyone, 0))
        self.probes = np.flatnonzero(get("probe") & (self.first < everyone))

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, place, t = self.n, self.place, self.t
        need = needed(n[x] + n[y], t)
        ok = (np.minimum(n[x] - place[x], n[y] - place[y]) >= need) & (np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y]) - 1e-9)
        apart = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int64) for m in self.maps)
        return ok & (apart <= n[x] + n[y] - 2 * need) & (self.sets[x] != self.sets[y])  # repeated rows meet themselves


def propose(batches: Iterator[pa.RecordBatch], t: float, tries: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Candidates (x later, y earlier) among postings sorted by (key, set): the nearest ``tries`` of each probe.

    ``more`` tells that the probe has further candidates at this word.  If ``exact``, the postings bring their lines:
    every candidate is verified here, in order, until one holds, and only that one is given.
    """

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = Postings(table, t)
        sets, active, back, hits = rows.sets, rows.probes, 1, np.zeros(table.num_rows, np.int64)
        lines = table.column("line") if exact else None
        words = lru_cache(maxsize=50_000)(lambda at: frozenset(lines[at].as_py().encode().split()))
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(sets[x]), pa.array(sets[y]), pa.array(np.zeros(len(x), bool))], names=["x", "y", "more"])

        while len(active):
            x, y = active, active - back
            ok = rows.alike(x, y)
            if exact:
                for k in np.flatnonzero(ok):
                    ok[k] = similar(words(int(x[k])), words(int(y[k])), t)
            hits[x[ok]] += 1
            ok &= hits[x] <= tries
            active = active[hits[active] < tries + (not exact)]
            found.append((x[ok], y[ok]))
            back += 1
            active = active[active - back >= rows.first[active]]
            if sum(len(f[0]) for f in found) > 1 << 18:
                yield batch()
                found = []
        if found:
            yield batch()
        over = pa.array(sets[hits > tries])
        yield pa.RecordBatch.from_arrays([over, over, pa.array(np.ones(len(over), bool))], names=["x", "y", "more"])

    for table in whole_keys(batches):
        yield from pairs(table)


#: Candidates of a probe at a word beyond which all earlier postings of the word are taken to be some.
MANY = 64


def with_candidates(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by (key, set) the probes that have a candidate at their word, and these candidates."""
    for table in whole_keys(batches):
        rows = Postings(table, t)
        active, back, hits, keep = rows.probes, 1, np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, bool)
        while len(active):
            x, y = active, active - back
            ok = rows.alike(x, y)
            keep[x[ok]] = keep[y[ok]] = True
            hits[x[ok]] += 1
            back += 1
            active = active[(hits[active] < MANY) & (active - back >= rows.first[active])]
        many = np.flatnonzero(hits >= MANY)
        step = np.bincount(rows.first[many], minlength=len(keep)) - np.bincount(many, minlength=len(keep))
        yield from table.filter(pa.array(keep | (np.cumsum(step) > 0))).to_batches()


def similar(a: frozenset, b: frozenset, t: float) -> bool:
    common = len(a & b)
    return common >= t * (len(a) + len(b) - common) - 1e-9


def candidates(postings: DataFrame, similarity: float, tries: int, exact: bool = False) -> DataFrame:
    """Candidates (x, y, more) of sets that share a prefix word, a row for each such word."""
    ordered = postings.repartition("key").sortWithinPartitions("key", "set").select("key", "set", "packed", *MAPS, "probe", *(["line"] if exact else []))
    return ordered.mapInArrow(lambda b: propose(b, similarity, tries, exact), "x long, y long, more boolean")


def _slot(*columns: str):
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << PICK_BITS) - 1))


def bit_map(rows: DataFrame, *columns: str) -> np.ndarray:
    """A map of 2^PICK_BITS bits with those of the rows' hashes set."""
    part = 1 << 15

    def pack(table: pa.Table) -> pa.Table:
        out = np.zeros(part, np.uint64)
        at = table.column("word").to_numpy()
        out[at % part] = table.column("bits").to_numpy().view(np.uint64)
        return pa.table({"part": pa.array([int(at[0] // part)], pa.int64()), "bits": pa.array([out.tobytes()])})

    slot = rows.select(_slot(*columns).alias("slot"))
    bits = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (PICK_BITS - 6), np.uint64)
    with shuffles_dropped(rows.sparkSession):
        parts = bits.groupBy(F.floor(F.col("word") / part)).applyInArrow(pack, "part long, bits binary").collect()  # 2^PICK_BITS bits at most
    for row in parts:
        out[row["part"] * part : (row["part"] + 1) * part] = np.frombuffer(row["bits"], np.uint64)
    return out


def lines_of(wanted: DataFrame, firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set, line) of the wanted sets.  Lines are picked where their text's bit is set, so the texts are read but not moved."""
    wanted = materialize(firsts.select("set", "doc_id", "row", "line_no").join(wanted, "set"), "lines-wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, "doc_id", "row"))
    narrow = _narrow(docs, id_col, text_col).withColumn("slot", _slot("doc_id", "row"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            hit = pa.array((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0)
            for part in W.slices([batch.filter(hit)], "text", W.SLICE):
                lines, bounds = W.split_lines(W.as_strings(part.column("text")))
                text = W.owners(bounds)
                number = np.arange(len(text)) - bounds[text]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(text)), part.column("row").take(pa.array(text)), pa.array(number.astype(np.int32)), lines],
                    names=["doc_id", "row", "line_no", "line"],
                )

    lines = narrow.mapInArrow(pick, f"doc_id {kind}, row long, line_no int, line string").join(wanted, ["doc_id", "row", "line_no"])
    # a place has one set, so repeated documents are folded where the place's rows have met
    texts = materialize(lines.dropDuplicates(["doc_id", "row", "line_no"]).select("set", "line"), "lines-texts")
    discard(wanted)
    return texts


def verify(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """The sets x among the pairs (x, y) whose lines' words really are that similar."""
    wanted = pairs.select(F.col("x").alias("set")).unionByName(pairs.select(F.col("y").alias("set"))).distinct()
    lines = lines_of(wanted, firsts, docs, id_col, text_col)
    both = pairs.select("x", "y").join(lines.toDF("x", "line_x"), "x").join(lines.toDF("y", "line_y"), "y").select("x", "line_x", "line_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("line_x").to_pylist(), batch.column("line_y").to_pylist(), strict=True):
                keep.append(similar(frozenset(x.encode().split()), frozenset(y.encode().split()), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep, pa.bool_()))], names=["x"])

    return both.mapInArrow(run, "x long").distinct()


#: Columns that tell where a line stands.
PLACE = ["doc_id", "row", "line_no"]


def settle(postings: DataFrame, firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sets x whose likeliest candidate holds, and the sets for which it fails though they have others."""
    tried = materialize(candidates(postings, similarity, TRIES), "lines-tried")
    # of a set's candidates the one with the most words in common comes first
    ranked = tried.groupBy("x", "y").agg(F.count_if(~F.col("more")).alias("n"), F.bool_or("more").alias("more")).groupBy("x")
    # what is ``more`` names the set itself
    best = ranked.agg(F.max_by(F.when(F.col("n") > 0, F.col("y")), F.struct("n", "y")).alias("y"), F.count_if(F.col("n") > 0).alias("given"), F.bool_or("more").alias("more"))
    best = materialize(best, "lines-best")
    good = materialize(verify(best.where("y IS NOT NULL"), firsts, docs, id_col, text_col, similarity), "lines-good")
    others = best.where("given > 1 OR more").join(good, "x", "left_anti")
    open_sets = materialize(others.select(F.col("x").alias("set")), "lines-open")
    discard(tried, best)
    return good, open_sets


def _postings_of(postings: DataFrame, open_sets: DataFrame, similarity: float) -> DataFrame:
    """The postings at which open sets meet their candidates; those of the open sets are the probes."""
    met = postings.join(open_sets.withColumn("probe", F.lit(True)), "set", "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
    names = ["key", "set", "packed", *MAPS, "probe"]
    ordered = met.repartition("key").sortWithinPartitions("key", "set").select(*names)
    return ordered.mapInArrow(lambda b: with_candidates(b, similarity), ordered.schema)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per document with a word: doc_id, row (hash of the text), n_lines, and ``removed``, the numbers of its lines that go."""
    lines = materialize(line_sets(docs, id_col, text_col, similarity), "lines")
    here = F.struct(*PLACE)
    firsts = lines.groupBy("s1", "s2").agg(F.min(here).alias("first"), F.count("*").alias("n_lines")).select("s1", "s2", "first.*", "n_lines")
    # sets get numbers in the order of their first lines
    firsts = firsts.repartitionByRange("doc_id", "row", "line_no").sortWithinPartitions("doc_id", "row", "line_no")
    firsts = materialize(firsts.withColumn("set", F.monotonically_increasing_id()), "lines-firsts")
    rows = lines.join(firsts.select("set", "doc_id", "row", "line_no"), ["doc_id", "row", "line_no"]).where("size(prefix) > 0")
    postings = rows.select("set", "n", *MAPS, F.explode(F.arrays_zip("prefix", "places")).alias("w"))
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("w.places").cast("long"))
    postings = materialize(postings.select(F.col("w.prefix").alias("key"), "set", packed.alias("packed"), *MAPS), "lines-postings")
    wide, lines = lines, materialize(lines.select("s1", "s2", *PLACE), "lines-places")
    discard(wide)

    good, open_sets = settle(postings.withColumn("probe", F.lit(True)), firsts, docs, id_col, text_col, similarity)
    if not open_sets.isEmpty():
        again = materialize(_postings_of(postings, open_sets, similarity), "lines-again")
        discard(postings)
        again = again.join(lines_of(again.select("set").distinct(), firsts, docs, id_col, text_col), "set")
        good = good.unionByName(materialize(candidates(again, similarity, 1, exact=True).select("x").distinct(), "lines-good"))

    gone = firsts.join(good.select(F.col("x").alias("set"), F.lit(True).alias("similar")), "set", "left").where("similar OR n_lines > 1")
    gone = gone.select("s1", "s2", F.struct("doc_id", "row", "line_no").alias("first"), F.coalesce("similar", F.lit(False)).alias("similar"))
    marked = lines.join(gone, ["s1", "s2"], "left")
    goes = F.col("first").isNotNull() & (F.col("similar") | (F.col("first") != here))
    return marked.groupBy("doc_id", "row").agg(
        F.count_distinct("line_no").alias("n_lines"), F.sort_array(F.collect_set(F.when(goes, F.col("line_no")))).alias("removed")
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their repeated lines, other columns as they were; a document that loses every word goes."""
    found = repeated_lines(docs, id_col, text_col, similarity).where("size(removed) > 0")
    found = found.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "removed", "n_lines")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__row"), F.col(text_col).alias("__text"))
    rows = rows.join(found, ["__id", "__row"], "left").where("removed IS NULL OR size(removed) < n_lines")
    text = F.expr("if(removed IS NULL, __text, array_join(filter(split(__text, '\\n', -1), (x, i) -> NOT array_contains(removed, i)), '\\n'))")
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns))
