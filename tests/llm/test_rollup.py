import pytest
from pyspark.sql import functions as F

from quillspark.llm import rollup as R

SCHEMA = "doc_id long, version string, op string, source string, lang string, tokens long, seq long"


def totals(book):
    return {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in book.totals().collect()}


def test_signed_batches_commit_once(spark):
    book = R.Rollup(spark)
    assert totals(book) == {} and book.counts().count() == 0
    first = spark.createDataFrame([(1, "v1", "insert", "a", "en", 10, 0), (2, "v1", "insert", None, None, 5, 0), (3, "v1", "insert", "a", "en", None, 0), (1, "v2", "insert", "a", "en", 12, 0),
                                   (None, "v1", "insert", "a", "en", 99, 0), (1, "v1", "insert", "a", "en", 10, 0)], SCHEMA)
    assert book.apply("one", first) and not book.apply("one", first)
    assert totals(book) == {("a", "en", "v1"): (2, 10), (None, None, "v1"): (1, 5), ("a", "en", "v2"): (1, 12)}
    second = spark.createDataFrame([(1, "v1", "revise", "x", "x", 7, 1), (1, "v1", "revise", "x", "x", 8, 2), (2, "v1", "delete", "q", None, None, 0), (9, "v1", "delete", "a", "en", 4, 0),
                                    (8, "v1", "revise", "a", "en", 4, 0), (3, "v1", "insert", "b", "en", 6, 0)], SCHEMA)
    assert book.apply("two", second)
    assert totals(book) == {("a", "en", "v1"): (1, 8), ("b", "en", "v1"): (1, 6), ("a", "en", "v2"): (1, 12)}
    assert book.apply("three", spark.createDataFrame([(1, "v1", "delete", None, None, None, 0), (2, "v1", "insert", "c", "fr", 3, 1)], SCHEMA))
    assert book.apply("empty", spark.createDataFrame([], SCHEMA))
    assert totals(book) == {("b", "en", "v1"): (1, 6), ("a", "en", "v2"): (1, 12), ("c", "fr", "v1"): (1, 3)}
    # the totals are those of the documents' last counts
    state = book.counts().where("present").groupBy("source", "lang", "version").agg(F.count("*").alias("d"), F.sum("tokens").alias("t")).collect()
    assert {(r["source"], r["lang"], r["version"]): (r["d"], r["t"]) for r in state} == totals(book)


def test_a_batch_that_broke_off_is_written_anew(spark, monkeypatch):
    book = R.Rollup(spark)
    events = spark.createDataFrame([(1, "v1", "insert", "a", "en", 10, 0)], SCHEMA)
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")) if a[1] == [("one",)] else make(*a, **b))
    with pytest.raises(RuntimeError):
        book.apply("one", events)
    monkeypatch.undo()
    assert totals(book) == {}
    assert book.apply("one", events) and totals(book) == {("a", "en", "v1"): (1, 10)}
