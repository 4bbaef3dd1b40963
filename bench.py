"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from quillspark import catalog

HEADLINE = (
    "style_differences", "dedup_text", "stratified_split", "preprocess_classify", "preprocess_topic", "corpus_totals",
    "language_proportions", "top_keywords", "emoji_counts", "posts_per_day", "extract_features", "feature_report",
    "ngram_totals", "pos_ngram_frequencies", "lexicon_match", "lexicon_match_patterns", "phrase_scores",
    "append_phrases", "build_dictionary", "umass_coherence", "classification_report", "naive_bayes_log_probabilities",
    "train_naive_bayes", "similar_words", "stream_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    small = os.environ.get("BENCH_WARM_DIR", sf_dir)
    # one run of the tokenizer so that the first query does not pay for the JVM's warm-up
    catalog.QUERIES["preprocess_classify"](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
