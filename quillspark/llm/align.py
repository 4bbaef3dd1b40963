"""Alignment of two tokenizers' tokens of the same text, and how often their ids meet over the corpus.

Tokenizer A is a byte-level one, B works on pieces with byte fallback and puts a space before the text; A gets that
space too, so both spell the same bytes.  The two arrays of token ends are aligned along their diagonals: while ends at the current
index shift agree, exponential probing jumps over the whole one-to-one stretch; where they differ, the one that is
behind moves on until both end together, which closes an irregular group and sets the new shift.

Neither tokenizer joins characters before a run of white space with that run (``Pair.crossing`` finds the exceptions of a vocabulary;
texts with one are taken whole), so a text is cut there, each distinct part of a block is encoded and aligned once,
and parts are remembered from block to block.  A block of texts becomes one row: its documents, their parts by number, the
parts' links by number, and its id pairs with their counts.  Pairs are summed over the corpus, joined back to the blocks
that hold them, and only numbers move.

Nulls and odd rows: a null or empty text has no tokens, nor has a text that one tokenizer does not spell byte by byte
(one with U+2581, say): all counts are 0 and the digest is ''.  Texts of any length are taken whole.  Repeated rows are aligned each on
its own and count each.  An empty table gives none.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import words as W
from quillspark.llm.packing import byte_letters
from quillspark.operators.joins import term_join
from quillspark.session import materialize

# fixed values: the characters with Unicode's White_Space property
SPACES = "\t\n\v\f\r \x85\xa0                　"
PART = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
MARK = "▁"
#: Parts and bytes of group lists that a task remembers before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 300_000, 32 << 20


def diagonal_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places behind each group's last A and last B token, of two rising arrays with the same last end."""
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = (np.ascontiguousarray(x, "<i8").tobytes() for x in (ends_a, ends_b))
    runs: list[tuple[int, int, int]] = []
    i = j = 0
    while i < len(a):
        if a[i] == b[j]:
            most, length, step = min(len(a) - i, len(b) - j), 1, 1
            rising = True
            while step:
                step = min(step, most - length)
                x, y = 8 * (i + length), 8 * (j + length)
                if step and raw_a[x : x + 8 * step] == raw_b[y : y + 8 * step]:
                    length += step
                    step = 2 * step if rising else step // 2
                else:
                    rising, step = False, step // 2
            runs.append((i + 1, j + 1, length))
            i, j = i + length, j + length
        else:
            while a[i] != b[j]:
                if a[i] < b[j]:
                    i += 1
                else:
                    j += 1
            i, j = i + 1, j + 1
            runs.append((i, j, 1))
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first_a, first_b, length = np.array(runs, np.int64).T
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(first_a, length) + inside, np.repeat(first_b, length) + inside


class Spelling:
    """Bytes of a vocabulary's tokens, by id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.numbers = [str(i) for i in range(len(tokens))]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.data[np.repeat(self.start[ids], size) + inside]


class Pair:
    """The two tokenizers, from the bytes of their files."""

    def __init__(self, json_a: bytes, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_a.decode())
        self.a.encode_special_tokens = True
        self.letters = byte_letters()
        byte = {letter: number for number, letter in self.letters.items()}
        tokens = sorted((i, t) for t, i in self.a.get_vocab().items())
        by_id = [b""] * (tokens[-1][0] + 1)
        for i, token in tokens:
            by_id[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.spelt_a = Spelling(by_id)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelt_b = Spelling([
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ])
        self.space = self.b.piece_to_id(MARK)
        #: white space that a piece joins to what comes before it
        self.crossing = {c for p in pieces for k, c in enumerate(p) if k and c in SPACES} | {
            " " for p in pieces if re.search(f"[^{SPACES}{MARK}]{MARK}", p)
        }
        self.odd = re.compile("[" + "".join(self.crossing | {MARK}) + "]")

    def parts(self, text: str) -> list[str]:
        return [text] if self.odd.search(text, 1) else PART.findall(text)

    def encode_a(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(parts)
        rest = []
        for k, part in enumerate(parts):
            if part[0] == " " and part[1:].isalpha():  # one token of the splitter, straight to the model
                out[k] = [t.id for t in self.a.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
            else:
                rest.append(k)
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            for k, one in zip(some, self.a.encode_batch_fast([parts[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = one.ids
        return out

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        ids = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [[self.space] if p == " " else i if p[0] == " " else i[1:] for p, i in zip(parts, ids, strict=True)]


class Parts:
    """Aligned parts by number: counts, links and group lists."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: not spelt alike
        self.bytes = 0
        self.counts = np.zeros((3, 0), np.int64)  # A tokens, B tokens, groups
        self.bounds, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)  # links: A id << 32 | B id

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Number of every part; parts not seen before are encoded and aligned, all in one go."""
        new = list(set(parts) - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.clear()
            new = list(set(parts))
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _learn(self, new: list[str]) -> None:
        pair, n = self.pair, len(new)
        data = [p.encode() for p in new]
        size = np.array([len(d) for d in data], np.int64)
        good, flat = np.ones(n, bool), []
        for ids, spelt in ((pair.encode_a(new), pair.spelt_a), (pair.encode_b(new), pair.spelt_b)):
            count = np.array([len(i) for i in ids], np.int64)
            codes = np.fromiter((c for i in ids for c in i), np.int64, int(count.sum()))
            owner = np.repeat(np.arange(n), count)
            same = np.bincount(owner, spelt.size[codes], n) == size
            kept = same[owner]
            text = np.frombuffer(b"".join(d for d, s in zip(data, same, strict=True) if s), np.uint8)
            wrong = np.flatnonzero(spelt.spell(codes[kept]) != text)
            same[np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), wrong, side="right")]] = False
            good &= same
            flat.append((codes, owner, spelt))
        ids, ends, owners = [], [], []
        for codes, owner, spelt in flat:
            kept = good[owner]
            ids.append(codes[kept])
            owners.append(owner[kept])
            ends.append(np.cumsum(spelt.size[codes[kept]]))
        cut_a, cut_b = diagonal_groups(*ends)
        # one link for every stretch between neighbouring ends of either tokenizer
        every = np.union1d(*ends)
        at_a, at_b = (np.searchsorted(e, every) for e in ends)
        links, link_owner = ids[0][at_a] << 32 | ids[1][at_b], owners[0][at_a]
        group_owner = owners[0][cut_a - 1]
        counts = np.stack([np.bincount(x, minlength=n) for x in (*owners, group_owner)])
        names = [list(map(s.numbers.__getitem__, i.tolist())) for i, s in zip(ids, (pair.spelt_a, pair.spelt_b), strict=True)]
        texts, x, y = [], 0, 0
        for u, v in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            texts.append(f"{','.join(names[0][x:u])}|{','.join(names[1][y:v])}")
            x, y = u, v
        bounds, start = np.cumsum(counts[2]).tolist(), 0
        for k, (part, fine) in enumerate(zip(new, good.tolist(), strict=True)):
            self.known[part] = len(self.groups)
            self.groups.append(";".join(texts[start : bounds[k]]) if fine else None)
            self.bytes += len(self.groups[-1] or "")
            start = bounds[k]
        self.counts = np.concatenate((self.counts, counts), axis=1)
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(np.bincount(link_owner, minlength=n))))
        self.links = np.concatenate((self.links, links))


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed bytes, lowest bytes first, so that small numbers cost little."""
    planes = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def _block(batch: pa.RecordBatch, parts: Parts) -> pa.RecordBatch:
    texts = W.as_strings(batch.column("text")).to_pylist()
    cut = [parts.pair.parts(f" {text}") if text else [] for text in texts]
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
    number = parts.numbers([part for c in cut for part in c])
    lists = list(map(parts.groups.__getitem__, number.tolist()))
    digests, keep = [], np.ones(len(texts), bool)
    for k, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
        groups = lists[x:y]
        keep[k] = bool(groups) and None not in groups
        digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if keep[k] else "")
    of_doc = W.owners(bounds)
    number, of_doc = number[keep[of_doc]], of_doc[keep[of_doc]]
    counts = [np.bincount(of_doc, c[number], len(texts)).astype(np.int64) for c in parts.counts]
    used, place, uses = np.unique(number, return_inverse=True, return_counts=True)
    size = parts.bounds[used + 1] - parts.bounds[used]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    links = parts.links[np.repeat(parts.bounds[used], size) + inside]
    pairs, link_place = np.unique(links, return_inverse=True)
    total = np.bincount(link_place, np.repeat(uses, size), len(pairs)).astype(np.int64)
    one = lambda values, kind: pa.array([values], kind)
    long = pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column("doc_id")),
        "n_a": one(counts[0], long), "n_b": one(counts[1], long), "n_groups": one(counts[2], long), "digest": one(digests, pa.list_(pa.string())),
        "n_parts": one(packed(np.bincount(of_doc, minlength=len(texts))), pa.binary()), "part": one(packed(place), pa.binary()),
        "n_links": one(packed(size), pa.binary()), "link": one(packed(link_place), pa.binary()),
        "a": one((pairs >> 32).astype(np.int32), pa.list_(pa.int32())), "b": one((pairs & 0xFFFFFFFF).astype(np.int32), pa.list_(pa.int32())),
        "n": one(total, long),
    })


def blocks(docs: DataFrame, json_a: bytes, model_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per block of texts: the documents' counts, and their parts, links and id pairs by number."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    files = docs.sparkSession.sparkContext.broadcast((json_a, model_b))  # two vocabulary files, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = None
        for batch in W.slices(batches, "text"):
            parts = parts or Parts(Pair(*files.value))
            yield _block(batch, parts)

    schema = (f"doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, digest array<string>, "
              "n_parts binary, part binary, n_links binary, link binary, a array<int>, b array<int>, n array<long>")
    return materialize(narrow.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "align-blocks")


def pair_counts(cut: DataFrame) -> DataFrame:
    """(a, b, n, best) of every id pair: its links over the corpus, and whether no other pair of the B id has more.

    A B id's pairs, at most as many as A has ids, meet in a window.
    """
    pairs = cut.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def document_links(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    kind = cut.schema["doc_id"].dataType.elementType.simpleString()
    places = cut.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("block", "place", "p.a", "p.b")
    found = term_join(places, counts, ["a", "b"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("f"))
    answers = found.select("block", F.col("f.n").alias("counts"), F.col("f.best").alias("bests"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "digest", "n_parts", "part", "n_links", "link", "counts", "bests"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in names}
                n_parts, part, n_links, link = (unpacked(row[c].as_py()) for c in ("n_parts", "part", "n_links", "link"))
                docs, bounds = row["doc_id"].values, np.concatenate(([0], np.cumsum(n_parts)))
                link_bounds = np.concatenate(([0], np.cumsum(n_links)))
                sums = [n_links]
                for c in ("counts", "bests"):
                    of_pair = row[c].values.to_numpy(zero_copy_only=False).astype(np.int64) if row[c].is_valid else np.zeros(0, np.int64)
                    sums.append(W.segment_sums(of_pair[link], link_bounds))
                links, total, best = (W.segment_sums(s[part], bounds) for s in sums)
                columns = [docs, *(row[c].values for c in ("n_a", "n_b", "n_groups")), *map(pa.array, (links, best, total)), row["digest"].values]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = cut.drop("a", "b", "n").join(answers, "block", "left").select(*names)
    return joined.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, json_a: bytes, model_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's alignment, from the two vocabulary files' bytes."""
    cut = blocks(docs, json_a, model_b, id_col, text_col)
    return document_links(cut, materialize(pair_counts(cut), "align-pairs"))
