from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, draws string"


def reshared(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {s: 0.0 for s in names}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def docs(spark, n=300):
    rows = [(i, " ".join(["w"] * (i * 7 % 40)), ["a", "é", "B", None, "hot", "hot", "hot"][i % 7], "s", "d") for i in range(n)]
    rows += [(9000, None, "empty", "s", "d"), (9001, "", "empty", "s", "d"), (9002, "x " * 3000, "long", "s", "d"), (5, "w w", "a", "s", "d"), (None, "w w w", "a", "s", "d")]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_words_taken(spark):
    rows = M.mix(docs(spark)).select("doc_id", "source", "size", "source_size", "target", M.taken(F.col("draws")).alias("taken")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken = reshared(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_the_tree_splits_quotas_exactly_and_in_proportion(spark):
    quotas = {0: 1000, 1: 10, 2: 0, 3: 333}
    table = spark.createDataFrame(list(quotas.items()), "source_no int, q long")
    rows = M.split_quotas(table, shards=8).collect()
    totals, per_source = Counter(), Counter()
    for r in rows:
        totals[r["shard"]] += r["q"]
        per_source[r["source_no"]] += r["q"]
        assert r["source_no"] != 0 or 90 < r["q"] < 160
    assert {s: per_source[s] for s in quotas} == quotas
    assert max(totals.values()) - min(totals.values()) <= 1


def test_the_mix_keeps_columns_and_agrees_with_the_plan(spark):
    table = docs(spark)
    mixed = M.mixed(table)
    assert mixed.schema == table.schema
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(M.word_count(F.col("text"))).alias("n")).collect()}
    plan = M.mix(table).groupBy("source").agg(F.sum(M.taken(F.col("draws"))).alias("n")).where("n > 0").collect()
    assert words == {r["source"]: r["n"] for r in plan}
    again = sorted(map(str, M.mixed(table.repartition(5)).collect()))
    assert again == sorted(map(str, mixed.collect()))
    assert M.mixed(table.limit(0)).count() == 0 and M.mix(table.limit(0)).count() == 0
    assert M.mix(table.where("source = 'empty'")).selectExpr("max(target)").first()[0] == 0
