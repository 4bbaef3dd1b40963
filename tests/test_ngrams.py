from quillspark.operators import ngrams


def test_assembled_vectors_keep_every_ngram(spark):
    rows = [(k, f"word{k} shared", float(k % 2)) for k in range(1500)]
    base = ngrams.with_word_ngrams(spark.createDataFrame(rows, "id long, text string, x double"))
    vectorizer = ngrams.fit_count_vectorizer(base)
    assembled = ngrams.feature_assembler(["x"], "v", ["ngram_vector"]).transform(vectorizer.transform(base))
    got = ngrams.vector_entries(assembled, ["x", *vectorizer.vocabulary], "v").collect()
    wanted = [e for k in range(1500) for e in ((k, f"word{k}", 1.0), (k, "shared", 1.0), (k, "x", 1.0))[: 2 + k % 2]]
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_entries_of_dense_vectors(spark):
    dense = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.0, 1.0)], "id long, x double, y double")
    got = ngrams.vector_entries(ngrams.feature_assembler(["x", "y"], "v").transform(dense), ["x", "y"], "v").collect()
    assert sorted(map(tuple, got)) == [(1, "x", 0.5), (1, "y", 2.0), (2, "y", 1.0)]
