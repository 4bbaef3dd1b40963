"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps one bit per failed rule and the measurements behind
it.  A policy is a versioned set of rules: applying another policy, or asking what a rule alone removes, reads
the ledger and never the texts again.

Nulls and odd rows: a null or empty text has no word, so its counts are 0 and ``few_words`` fails.  Repeated rows
are measured each on its own.  An empty table gives an empty ledger.  Columns that the input has beside id and
text are not carried into the ledger, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import words as W

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits",
    "n_same_as_last",
)
#: Rules in the order of their bits; a rule's number never changes, new rules are added at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines AND n_dup_lines >= 4",
    "upper_case": "n_upper > n_lower AND n_upper >= 20",
    "short_words": "10 * word_chars < 20 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "digits": "n_digits > n_upper + n_lower AND 2 * n_digits > word_chars",
    "word_runs": "2 * n_same_as_last > n_words",
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return rule_mask(self.rules)


#: The policies in use: the base alone, and all rules.
POLICIES = {p.version: p for p in (Policy("base-1", BASE), Policy("full-1", tuple(RULES)))}


def rule_mask(names: Iterable[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(name) for name in set(names))


def _kinds() -> np.ndarray:
    """Class of each byte: 1 symbol, 2 upper case, 4 lower case, 8 digit (ASCII)."""
    kinds = np.zeros(256, np.uint8)
    kinds[[ord(c) for c in SYMBOLS]] = 1
    kinds[ord("A") : ord("Z") + 1] = 2
    kinds[ord("a") : ord("z") + 1] = 4
    kinds[ord("0") : ord("9") + 1] = 8
    return kinds


def repeated_words(codes: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text in windows that the text holds twice or more, the first one included.

    Windows are found equal by a hash and then compared word by word.
    """
    hashes, inside = W.window_hashes(W.mix(codes), bounds, width)
    if not len(hashes):
        return np.zeros(len(bounds) - 1, np.int64)
    text = W.owners(inside)
    with np.errstate(over="ignore"):
        keys = hashes ^ W.mix(text.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    places = np.flatnonzero(np.isin(keys, twice)) if len(twice) else np.zeros(0, np.int64)
    starts = bounds[:-1][text[places]] + places - inside[:-1][text[places]]
    if len(places):
        rows = np.column_stack([text[places], *(codes[starts + k] for k in range(width))])
        order = np.argsort(keys[places], kind="stable")
        same_key = keys[places][order][1:] == keys[places][order][:-1]
        if (rows[order][1:][same_key] != rows[order][:-1][same_key]).any():  # two windows share a hash: compare all
            _, group, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            starts = starts[counts[group.ravel()] > 1]
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return W.segment_sums(np.cumsum(change[:-1]) > 0, bounds)


def measure_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of a batch of texts."""
    texts = W.as_strings(texts)
    words, bounds = W.split_words(texts)
    codes, _ = W.encode(words)
    out = {"n_words": np.diff(bounds), "word_chars": W.segment_sums(pc.utf8_length(words).to_numpy(), bounds)}
    out["n_repeat_words"] = repeated_words(codes, bounds)
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[bounds[:-1][np.diff(bounds) > 0]] = False  # a text's first word follows none
    out["n_same_as_last"] = W.segment_sums(same, bounds)
    data, places = W.text_bytes(texts)
    kinds = _kinds()[data]
    for bit, name in ((1, "n_symbols"), (2, "n_upper"), (4, "n_lower"), (8, "n_digits")):
        out[name] = W.segment_sums((kinds & bit) > 0, places)
    lines, line_bounds = W.split_lines(texts)
    full = W.has_word(lines)
    codes, dictionary = W.encode(lines)
    text = W.owners(line_bounds)
    distinct = np.unique(text[full] * max(len(dictionary), 1) + codes[full]) // max(len(dictionary), 1)
    out["n_lines"] = W.segment_sums(full, line_bounds)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct, minlength=len(texts)).astype(np.int64)
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the measurements that the rules read."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", W.SLICE):
            found = measure_batch(batch.column("text"))
            columns = [batch.column("doc_id"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *MEASURES])

    return narrow.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements, and ``failed``: bit k is set if rule k of ``RULES`` fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("failed", failed)


def passes(policy: Policy, failed: Column | str = "failed") -> Column:
    """Whether a ledger row passes the policy."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(book: DataFrame, policies: Iterable[Policy] = tuple(POLICIES.values())) -> DataFrame:
    """The ledger with one boolean column ``kept_<version>`` per policy."""
    return book.select("*", *(passes(p).alias(f"kept_{p.version}") for p in policies))


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy without it keeps.

    Rows are folded to the few distinct bit patterns before any rule is looked at.
    """
    mask = F.lit(policy.mask).cast("long")
    patterns = book.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).agg(F.count("*").alias("n"))
    rules = book.sparkSession.createDataFrame(
        [(name, rule_mask([name])) for name in policy.rules], "rule string, bit long"
    )
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    rest = F.col("failed").bitwiseAND(F.bitwise_not("bit"))
    joined = patterns.join(F.broadcast(rules))  # a few dozen patterns at most times a few rules
    return joined.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: Policy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that pass the policy, all columns as they were.

    The ledger row is built beside the document, so no join is needed and repeated ids do not mix.
    """
    book = docs.select(F.struct("*").alias("doc_id"), F.col(text_col).alias("text"))
    return ledger(book).where(passes(policy)).select("doc_id.*")
