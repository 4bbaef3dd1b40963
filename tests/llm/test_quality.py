import re

from pyspark.sql import functions as F

from quillspark.llm import quality as Q

SCHEMA = "doc_id long, text string, failed string, n_words string"  # columns that clash with the ledger's
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
        "n_same_as_last": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h " * 5, "x\x1cy z\x85w", "é ü 日本 | # $", "same line\nsame line\n\nother\nsame line", "w " * 5000,
    " ".join(f"word{i}" for i in range(30)), " ".join(f"word{i}" for i in range(30)), "A B C D E F G H I J K L M N O P Q R S T U V W X", "\n\n\n",
]


def frame(spark):
    return spark.createDataFrame([(i, t, "f", "n") for i, t in enumerate(TEXTS)], SCHEMA)


def test_measurements_equal_brute_force(spark):
    rows = {r["doc_id"]: r.asDict() for r in Q.ledger(frame(spark)).collect()}
    for i, text in enumerate(TEXTS):
        for name, value in brute(text).items():
            assert rows[i][name] == value, (text, name)
        assert bool(rows[i]["failed"] & 1) == (brute(text)["n_words"] < 20)


def test_keep_good_passes_columns_through_and_handles_empty_tables(spark):
    docs = frame(spark)
    kept = Q.keep_good(docs, Q.POLICIES["full-1"])
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {9, 10}
    assert Q.keep_good(docs.limit(0), Q.POLICIES["full-1"]).count() == 0
    assert Q.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablation_follow_from_the_bits(spark):
    book = Q.ledger(frame(spark)).cache()
    bits = [r["failed"] for r in book.collect()]
    full = Q.POLICIES["full-1"]
    verdicts = Q.apply_policies(book).select("failed", F.col("`kept_base-1`").alias("base"), F.col("`kept_full-1`").alias("full")).collect()
    assert all(r["base"] == (r["failed"] & 3 == 0) and r["full"] == (r["failed"] == 0) for r in verdicts)
    for row in Q.ablation(book, full).collect():
        bit = Q.rule_mask([row["rule"]])
        assert row["n_failed"] == sum(bool(b & bit) for b in bits)
        assert row["n_failed_alone"] == sum(b == bit for b in bits)
        assert row["n_kept_without"] == sum(b & ~bit == 0 for b in bits)
