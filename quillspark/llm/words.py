"""Columnar helpers shared by the operators that run over Arrow batches.

A *word* is a run of characters other than the six ASCII white-space characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def as_strings(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, and the place where each text's words begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not full.all():
        bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
        words = words.filter(pa.array(full))
    return words, bounds


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines (between line feeds) of all texts in a row, and where each text's lines begin."""
    lists = pc.split_pattern(texts, "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), bounds - bounds[0]


def has_word(lines: pa.Array) -> np.ndarray:
    """Which lines hold a word."""
    return pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each word in the batch's own dictionary, and that dictionary."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each entry of a flat list, the number of the text that it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    totals = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return totals[bounds[1:]] - totals[bounds[:-1]]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each text begins."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection), so that any bits of the result may serve as a hash."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """64-bit hash of each word, the same in every task and run."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(dictionary))


def window_hashes(codes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words inside a text, in order, and where each text's windows begin."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    inside = np.concatenate(([0], np.cumsum(counts)))
    n = len(codes) - width + 1
    if n <= 0 or not inside[-1]:
        return np.zeros(0, np.uint64), inside
    step, power = np.uint64(0xD6E8FEB86659FD93), np.uint64(1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += codes[k : k + n].astype(np.uint64) * power
            power = power * step
    starts = np.repeat(bounds[:-1] - inside[:-1], counts) + np.arange(inside[-1])
    return mix(total[starts]), inside


#: Bytes of text that a task works on at once where what it makes of them is many times as large.
SLICE = 1 << 20


def slices(batches, column: str, limit: int = 4 << 20):
    """The batches cut into runs of rows with about ``limit`` bytes of text each, so that long texts do not add up."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes.astype(np.int64) + 64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: An odd factor.
_FACTOR = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: int, n: int) -> np.ndarray:
    """factor^0 .. factor^(n-1) modulo 2^64; kept for the next batch."""
    known = _POWERS.get(factor)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 20), factor, np.uint64)
        known[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[factor] = known = np.multiply.accumulate(known)
    return known[:n]


#: Words of so many bytes are hashed by xxHash: for long words a polynomial modulo 2^64 can be made to collide by design.
_LONG = 256
#: For the second hash: a value of its own for every byte, and another odd factor.
_VALUES = mix(np.arange(256, dtype=np.uint64) << np.uint64(32))
_FACTOR_2 = 0xBF58476D1CE4E5B9


def hashed_words(texts: pa.Array, both: bool = False) -> tuple[np.ndarray, ...]:
    """Hash of every word, where it begins, and the texts' bytes and bounds; without making the words themselves.

    A word's hash is its polynomial in the bytes, taken from running sums over all bytes, so the cost is a few passes.
    If ``both``, a second hash by other values and another factor comes last, so that the two identify a word by 128 bits.
    """
    import xxhash

    data, bounds = text_bytes(texts)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[:-1][bounds[:-1] < len(data)]] = True  # a text's first byte begins a word
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False])) if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    long = np.flatnonzero(ends - starts >= _LONG)

    def hashes(values: np.ndarray, factor: int, seed: int) -> np.ndarray:
        inverse = pow(factor, -1, 1 << 64)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values * _powers(factor, len(data)), out=sums[1:])
            out = mix((sums[ends] - sums[starts]) * _powers(inverse, len(data) + 1)[starts])
        for k in long:
            out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
        return out

    found = (hashes(data.astype(np.uint64) + np.uint64(1), _FACTOR, 0), starts, data, bounds)
    return (*found, hashes(_VALUES[data], _FACTOR_2, 1)) if both else found
