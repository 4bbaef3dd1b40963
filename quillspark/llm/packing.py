"""Packing tokenised documents into sequences of a fixed capacity with minimum bin slack.

A document's ids are cut into full windows and one rest.  How the rests fill sequences depends only on how many
there are of each length, a table of at most ``capacity`` numbers.  On that table the largest remaining length
opens a sequence, a subset-sum over bits finds the multiset of remaining lengths that comes closest to the room
left, backtracking gives its counts, and the same filling is repeated as often as the counts allow.  The fillings
are then dealt to the pieces by each piece's rank within its length.  Ranks come from counts per (length, hash bucket)
and a numbering inside each bucket.  A length has as many buckets as its count asks for, so no task sees all pieces of a
length, however many full windows there are.

Nulls and odd rows: a null text is the empty one and gives one piece, the closing id.  Documents of any length are
encoded whole.  Repeated rows are packed each on its own.  An empty table gives no piece.  Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import words as W
from quillspark.session import materialize

CAPACITY = 1024
END_ID = 0
#: Pieces that a hash bucket of a length holds on average; ranks are counted in buckets.
BUCKET_ROWS = 100_000
#: Entries that an encoder remembers before it starts anew.
REMEMBERED = 600_000


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary spells each byte: printing Latin-1 itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The vocabulary's splitter never joins characters across a single white-space character between two words, and of a
    run of white space it keeps all but the last character together.  So a text is cut there and each distinct part
    is encoded once.  A part that begins with ``VERBATIM`` is encoded as it is, any other with a space before it.
    """

    VERBATIM = "\1"
    MARKS = ".,;:!?|#%&$*"
    RUN = re.compile(r"(\s\s+)")
    #: Characters that the cuts do not cover: texts with one are encoded whole.
    ODD = re.compile("[\0\1\x1c-\x1f]")

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 10_000):
            for one in self.tokenizer.encode_batch_fast(texts[at : at + 10_000], add_special_tokens=False):
                yield array("I", one.ids).tobytes()

    def parts(self, text: str) -> list[str]:
        verbatim = self.VERBATIM
        out, lead, pieces = [], verbatim, self.RUN.split(text)
        for number, piece in enumerate(pieces):
            if not number % 2:
                for line in piece.split("\n") if piece else ():
                    if lead is None:
                        out.append(verbatim + "\n")
                    first, *rest = line.split(" ")
                    out.append(first if lead == "" else verbatim + first)
                    out += rest
                    lead = None
            elif number == len(pieces) - 2 and not pieces[-1]:
                out.append(verbatim + piece)
            else:
                out.append(verbatim + piece[:-1])
                lead = "" if piece[-1] == " " else verbatim
                if lead:
                    out.append(verbatim + piece[-1])
        return out

    def _learn(self, new: set[str]) -> None:
        """Encode new parts; marks after a letter are always tokens of their own, so they are split off first."""
        ends: dict[str, tuple[str, str]] = {}
        for part in new:
            core = part.rstrip(self.MARKS)
            if core != part and core[-1:].isalpha():
                ends[part] = core, self.VERBATIM + part[len(core) :]
        todo = (new - ends.keys()).union(*ends.values()) - self.known.keys()
        # letters, with or without a space before them, are one token of the splitter and go straight to the model
        words = [p for p in todo if p.isalpha() or p[:1] == self.VERBATIM and p[1:].isalpha()]
        for word in words:
            spelt = (word[1:] if word[0] == self.VERBATIM else f" {word}").encode().decode("latin-1").translate(self.letters)
            self.known[word] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        todo, verbatim = list(todo.difference(words)), self.VERBATIM
        self.known.update(zip(todo, self._ids([p[1:] if p[:1] == verbatim else " " + p for p in todo]), strict=True))
        for part, (core, end) in ends.items():
            self.known[part] = self.known[core] + self.known[end]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        cut = [None if self.ODD.search(text) else self.parts(text) for text in texts]
        new = set().union(*filter(None, cut)) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*filter(None, cut))
        self._learn(new)
        known = self.known.__getitem__
        for text, parts in zip(texts, cut, strict=True):
            yield next(self._ids([text])) if parts is None else b"".join(map(known, parts))


@lru_cache(maxsize=1)
def encoder_of(tokenizer_path: str) -> Encoder:
    """The Python worker's encoder: its next task finds the words known that its last one met."""
    return Encoder(tokenizer_path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """Documents encoded and cut: doc_id, start, length, ids_crc32, doc_tokens (and ``ids`` as 32-bit bytes)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", 2 << 20):
            encoder = encoder_of(tokenizer_path)
            row, starts, lengths, sums, totals, kept = [], [], [], [], [], []
            for number, ids in enumerate(encoder.encode(W.as_strings(batch.column("text")).to_pylist())):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    row.append(number)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(ids) // 4)
                    if with_ids:
                        kept.append(piece)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return narrow.mapInArrow(run, schema)


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum of at most ``room``, long lengths first."""
    reach, mask, layers = 1, (1 << room + 1) - 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        layers.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= reach << step * length & mask
            left, step = left - step, 2 * step
        if reach >> room & 1:
            break
    total, uses = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not before >> total & 1:
            total -= length
            uses[length] = uses.get(length, 0) + 1
    return uses


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings of one sequence, each with its number of repeats, that together use every length exactly."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        uses = closest_fill(left, capacity - largest)
        left[largest] += 1
        uses[largest] = uses.get(largest, 0) + 1
        repeats = min(left[n] // u for n, u in uses.items())
        for n, u in uses.items():
            left[n] -= u * repeats
            if not left[n]:
                del left[n]
        out.append((uses, repeats))
    return out


def assignments(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, uses, first_sequence, first_offset): which ranks of a length go where."""
    used, sequence, rows = dict.fromkeys(counts, 0), 0, []
    for uses, repeats in fillings(counts, capacity):
        offset = 0
        for length in sorted(uses, reverse=True):
            upto = used[length] + uses[length] * repeats
            rows.append((length, used[length], upto, uses[length], sequence, offset))
            used[length], offset = upto, offset + length * uses[length]
        sequence += repeats
    return rows


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table) with their sequence_id and offset."""
    spark, columns = cut.sparkSession, cut.columns
    totals = materialize(cut.groupBy("length").agg(F.count("*").alias("n")), "pack-totals")  # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in totals.collect()}
    buckets = totals.select("length", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    cut = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets"))).drop("buckets")
    per_bucket = materialize(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    firsts = per_bucket.select("length", "bucket", earlier.alias("first"))  # a row per ``BUCKET_ROWS`` pieces and one per length
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(firsts), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("first", "bucket")
    table = spark.createDataFrame(
        assignments(counts, capacity),
        "size long, from_rank long, to_rank long, uses long, first_sequence long, first_offset long",
    )  # a few rows per length: bounded by the capacity, not by the corpus
    hit = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    nth = F.col("rank") - F.col("from_rank")
    return ranked.join(F.broadcast(table), hit).select(
        *columns,
        (F.col("first_sequence") + F.floor(nth / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("uses") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their place in the packed sequences."""
    return place(materialize(pieces(docs, tokenizer_path, id_col, text_col, capacity, with_ids), "pack-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens and the ids of its pieces in order (needs ``with_ids``)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))  # <= capacity pieces
    total = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return rows.select("sequence_id", total.alias("n_tokens"), F.expr("aggregate(p, cast('' as binary), (b, x) -> concat(b, x.ids))").alias("ids"))
