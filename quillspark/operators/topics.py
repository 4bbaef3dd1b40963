"""Dictionary, topic models and their evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.rows import explode_rows
from quillspark.functions import constants as C
from quillspark.operators.joins import term_join
from quillspark.session import materialize


#: Share of the corpus that one update of the topic model reads.
LDA_SHARE = 0.05


def build_dictionary(
    df: DataFrame,
    tokens_col: str = "tokens",
    min_docs: int = C.DICTIONARY_MIN_DOCS,
    max_share: float = C.DICTIONARY_MAX_SHARE,
    keep: int = C.DICTIONARY_KEEP,
) -> DataFrame:
    """(term, term_id, doc_freq): terms of enough and not too many posts, the ``keep`` most frequent.

    Ids follow the order (most posts first, then the term).  The window numbers
    ``keep`` rows at most.
    """
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    freq = (
        explode_rows(df, [], F.array_distinct(tokens_col), "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("doc_freq"))
    )
    kept = freq.where((F.col("doc_freq") >= min_docs) & (F.col("doc_freq") <= max_share * n_docs))
    kept = kept.orderBy(F.desc("doc_freq"), F.asc("term")).limit(keep)
    order = Window.orderBy(F.desc("doc_freq"), F.asc("term"))
    return kept.select("term", (F.row_number().over(order) - 1).alias("term_id"), "doc_freq")


def dictionary_report(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: unique tokens of the dictionary and number of posts."""
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    return dictionary.agg(F.count(F.lit(1)).alias("unique_tokens")).withColumn("documents", n_docs)


def doc_term_matrix(df: DataFrame, dictionary: DataFrame, tokens_col: str = "tokens", id_col: str = "id") -> DataFrame:
    """(id, term_id, n) for the terms of the dictionary; counted per post before the join."""
    counts = (
        explode_rows(df, [id_col], tokens_col, "term")
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    joined = term_join(counts, dictionary.select("term", "term_id"), "term")
    return joined.select(id_col, "term_id", "n")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, posts, n) of each batch of token lists: posts that hold the term, and all its occurrences."""
    for batch in batches:
        lists = batch.column("tokens")
        coded = lists.flatten().dictionary_encode()
        codes, size = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        posts = np.bincount(np.unique(owner * size + codes) % size, minlength=len(coded.dictionary))
        n = np.bincount(codes, minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(posts), pa.array(n)], names=["term", "posts", "n"])


def fit_bag_of_words(
    df: DataFrame,
    tokens_col: str = "tokens",
    min_docs: float = C.DICTIONARY_MIN_DOCS,
    max_share: float = C.DICTIONARY_MAX_SHARE,
    keep: int = C.DICTIONARY_KEEP,
) -> CountVectorizerModel:
    """Count vectors of the ``keep`` most frequent terms (then by term) of enough and not too many posts.

    Bounds from 1 on are numbers of posts, smaller ones shares of them, as Spark's vectorizer has it.  Its own fit
    keeps every post's tokens as cached objects and reads them again; here terms are counted batch by batch before
    the shuffle and only the vocabulary comes to the driver.
    """
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    counted = df.select(F.filter(tokens_col, lambda t: t.isNotNull()).alias("tokens")).where("tokens IS NOT NULL").mapInArrow(_term_counts, "term string, posts long, n long")
    freq = counted.groupBy("term").agg(F.sum("posts").alias("posts"), F.sum("n").alias("n"))
    low, high = (F.lit(float(x)) * (1 if x >= 1 else n_docs) for x in (min_docs, max_share))
    kept = freq.where((F.col("posts") >= low) & (F.col("posts") <= high)).orderBy(F.desc("n"), F.asc("term")).limit(keep)
    vocabulary = kept.select("term").toArrow().column("term").to_pylist()
    if not vocabulary:
        raise ValueError("no term is in enough and not too many posts")
    return CountVectorizerModel.from_vocabulary(vocabulary, tokens_col, "bow")


def train_lda(
    bags: DataFrame,
    k: int = C.LDA_TOPICS,
    *,
    passes: int = 1,
    share: float = LDA_SHARE,
    seed: int = C.SPLIT_SEED,
    bag_col: str = "bow",
) -> LDAModel:
    """Online variational LDA: every update reads a ``share`` of the corpus, ``passes`` over it in all.

    An update samples by a scan, so the number of scans is passes / share
    whatever the size of the corpus (updates from a fixed number of posts
    would make it grow with the square).
    """
    return LDA(
        k=k, optimizer="online", featuresCol=bag_col, seed=seed, subsamplingRate=share,
        maxIter=max(1, math.ceil(passes / share)),
    ).fit(bags)


def topic_terms(spark: SparkSession, model: LDAModel, vocabulary: list[str], top: int = 20) -> DataFrame:
    """(topic, rank, term, weight); rank 1 is the heaviest term."""
    words = spark.createDataFrame(list(enumerate(vocabulary)), "term_id int, term string")
    top_ids = model.describeTopics(top)
    long = top_ids.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    long = long.select(
        "topic", (F.col("rank") + 1).alias("rank"), F.col("x.termIndices").alias("term_id"), F.col("x.termWeights").alias("weight")
    )
    return long.join(words, "term_id").select("topic", "rank", "term", "weight")


def umass_coherence(
    df: DataFrame, topics: DataFrame, tokens_col: str = "tokens", id_col: str = "id", epsilon: float = 1.0
) -> DataFrame:
    """(topic, coherence): mean over ordered term pairs of log((D(m, l) + eps) / D(l)), rank of l before m.

    For each post and topic the ranks present are folded into one sorted list,
    of at most one entry per listed term; posts with the same list are counted
    together before it is opened into its pairs, so the pairs of a post are
    never written out.
    """
    words = explode_rows(df, [id_col], F.array_distinct(tokens_col), "term")
    listed = topics.groupBy("term").agg(F.collect_set(F.struct("topic", "rank")).alias("uses"))
    hits = term_join(words, listed, "term").select(id_col, F.explode("uses").alias("u"))
    sets = hits.groupBy(id_col, F.col("u.topic").alias("topic")).agg(F.sort_array(F.collect_set("u.rank")).alias("ranks"))
    opened = sets.groupBy("topic", "ranks").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(
        F.transform("ranks", lambda m: F.transform(F.filter("ranks", lambda x: x <= m), lambda x: F.struct(m.alias("m"), x.alias("l"))))
    )
    joint = (
        opened.select("topic", "n", F.explode(pairs).alias("p"))
        .groupBy("topic", "p.m", "p.l")
        .agg(F.sum("n").alias("n"))
    )
    # every ordered pair of the topic's terms, whether it occurs or not
    ranked = topics.groupBy("topic").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    wanted = ranked.select("topic", F.explode(pairs).alias("p")).select("topic", "p.m", "p.l").where("l < m")
    single = joint.where("m = l").select("topic", "l", F.col("n").alias("d_l"))
    both = joint.select("topic", "m", "l", F.col("n").alias("d_ml"))
    scored = wanted.join(both, ["topic", "m", "l"], "left").join(single, ["topic", "l"], "left")
    value = F.log((F.coalesce("d_ml", F.lit(0)) + F.lit(epsilon)) / F.col("d_l"))
    return scored.groupBy("topic").agg(F.avg(value).alias("coherence"))


#: Entries of runs times ranks that a task works on at once (a post is never cut).
_RUN_ENTRIES = 1 << 22


def _window_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(topic, m, l, n): windows that hold both ranks, from lists of hits (since, until, rank) with their topic, run by run of lists."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("hits")).to_numpy())
        n_ranks = pc.count_distinct(batch.column("hits").flatten().field("rank")).as_py()
        run = (ends - 1) * 2 * n_ranks // _RUN_ENTRIES
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                names = batch.column("topic").slice(a, b - a).dictionary_encode("encode")
                codes = names.indices.to_numpy()
                text, rank, length, held = _window_runs(batch.column("hits").slice(a, b - a))
                for code, name in enumerate(names.dictionary):
                    at = codes[text] == code
                    inside = held[at]
                    both = inside.T @ (inside * length[at, None])  # whole numbers below 2^53: exact
                    m, low = np.nonzero(both)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * len(m), names.dictionary.type), pa.array(rank[m]), pa.array(rank[low]), pa.array(both[m, low].astype(np.int64))],
                        names=["topic", "m", "l", "n"],
                    )


def _window_runs(hits: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same ranks, all lists at once: list, ranks met, length of each run, and which ranks it holds (0 or 1).

    Hits of a rank that meet or overlap are one interval, so the work follows hits and result, not their product.
    """
    sizes = pc.list_value_length(hits).to_numpy()
    since, until, rank = (x.to_numpy().astype(np.int64) for x in hits.flatten().flatten())
    owner = np.repeat(np.arange(len(hits)), sizes)
    order = np.lexsort((since, rank, owner))
    since, until, rank, owner = since[order], until[order], rank[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (rank[1:] != rank[:-1])
    group = np.cumsum(new) << 32
    reach = np.maximum.accumulate(group + until)
    first = np.flatnonzero(np.concatenate((new[:1], group[1:] + since[1:] > reach[:-1])))
    last = np.append(first[1:], len(owner))[: len(first)] - 1
    begin, end = (owner[first] << 32) + since[first], (owner[first] << 32) + reach[last] - group[last]
    edges = np.unique(np.concatenate((begin, end)))
    begin, end = np.searchsorted(edges, begin), np.searchsorted(edges, end)
    covered = end - begin
    run = np.repeat(begin - np.cumsum(covered) + covered, covered) + np.arange(covered.sum())
    ranks, column = np.unique(rank[first], return_inverse=True)
    held = np.zeros((len(edges), len(ranks)))
    held[run, np.repeat(column, covered)] = 1
    # what lies between a list's last edge and the next list's first is no run: nothing is held there
    return edges >> 32, ranks, np.append(np.diff(edges), 0), held


def npmi_coherence(
    df: DataFrame, topics: DataFrame, tokens_col: str = "tokens", id_col: str = "id", window: int = 110
) -> DataFrame:
    """(topic, coherence): c_v measure over sliding windows of ``window`` tokens.

    Windows are cut inside each post.  The set of topic terms in the window
    changes only where a hit comes in or drops out, so a post gives at most two
    sets per hit, each with the number of windows that hold it.  Pairs of ranks
    are counted where a post's hits meet; vectors of normalised pointwise mutual information are then
    compared with the vector of the whole topic by cosine.
    """
    words = df.select(id_col, F.size(tokens_col).alias("size"), F.posexplode(tokens_col).alias("pos", "term"))
    n_windows = df.agg(F.sum(F.greatest(F.size(tokens_col) - (window - 1), F.lit(1)))).scalar()
    listed = topics.groupBy("term").agg(F.collect_set(F.struct("topic", "rank")).alias("uses"))
    hits = term_join(words, listed, "term")
    # the windows that hold a position: from pos - window + 1 to pos, inside the post
    since = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    until = F.least(F.col("pos"), F.greatest(F.col("size") - window, F.lit(0))) + 1
    held = hits.select(id_col, since.alias("since"), until.alias("until"), F.explode("uses").alias("u"))
    post = held.groupBy(id_col, F.col("u.topic").alias("topic")).agg(F.collect_list(F.struct("since", "until", F.col("u.rank").cast("long").alias("rank"))).alias("hits"))
    kind = post.schema["topic"].dataType.simpleString()
    counted = post.select("topic", "hits").mapInArrow(_window_pairs, f"topic {kind}, m long, l long, n long")
    joint = counted.groupBy("topic", "m", "l").agg(F.sum("n").alias("n"))
    joint = materialize(joint, "joint-windows")  # read three times; pairs of listed terms only
    ranked = topics.groupBy("topic").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    pairs = F.flatten(F.transform("ranks", lambda m: F.transform("ranks", lambda x: F.struct(m.alias("m"), x.alias("l")))))
    wanted = ranked.select("topic", F.explode(pairs).alias("p")).select("topic", "p.m", "p.l")
    single = joint.where("m = l")
    total = n_windows.cast("double")
    p = (
        wanted.join(joint.select("topic", "m", "l", (F.col("n") / total).alias("p_ml")), ["topic", "m", "l"], "left")
        .join(single.select("topic", "m", (F.col("n") / total).alias("p_m")), ["topic", "m"], "left")
        .join(single.select("topic", "l", (F.col("n") / total).alias("p_l")), ["topic", "l"], "left")
    )
    eps = F.lit(1e-12)
    p_ml = F.coalesce("p_ml", F.lit(0.0)) + eps
    known = F.col("p_m").isNotNull() & F.col("p_l").isNotNull()
    npmi = F.when(known, F.log(p_ml / (F.col("p_m") * F.col("p_l"))) / -F.log(p_ml)).otherwise(F.lit(0.0))
    cells = p.select("topic", "m", "l", npmi.alias("v"))
    # K terms per topic: vectors of K entries, compared with their sum
    whole = cells.groupBy("topic", "l").agg(F.sum("v").alias("s"))
    cos = cells.join(whole, ["topic", "l"]).groupBy("topic", "m").agg(
        F.sum(F.col("v") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nv"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("ns")
    )
    value = F.coalesce(F.try_divide(F.col("dot"), F.col("nv") * F.col("ns")), F.lit(0.0))
    return cos.groupBy("topic").agg(F.avg(value).alias("coherence"))


def avg_coherence(coherence: DataFrame) -> DataFrame:
    return coherence.agg(F.avg("coherence").alias("avg_coherence"))


def top_topics(topics: DataFrame, coherence: DataFrame) -> DataFrame:
    """Topics with their terms, most coherent topic first."""
    return topics.join(coherence, "topic").orderBy(F.desc("coherence"), F.asc("topic"), F.asc("rank"))


def _digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers: eight steps up, then the asymptotic series."""
    steps = sum(1 / (x + k) for k in range(8))
    y = 1 / (x + 8) ** 2
    return np.log(x + 8) - 0.5 / (x + 8) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - steps


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive numbers, in the same way."""
    steps = sum(np.log(x + k) for k in range(8))
    z = x + 8
    y = 1 / z**2
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


#: Numbers (entries of posts times topics) that a task works on at once.
_BOUND_NUMBERS = 1 << 21


def _post_bounds(expected: np.ndarray, alpha: np.ndarray, at: np.ndarray, n: np.ndarray, sizes: np.ndarray, shares: np.ndarray) -> float:
    """Sum over posts of E[log p(post | theta, beta)] + E[log p(theta | alpha) - log q(theta | gamma)]."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # a post's gamma sums to alpha's sum and its tokens
    gamma = shares * (alpha.sum() + np.bincount(owner, n, len(sizes)))[:, None]
    whole = gamma.sum(axis=1)
    theta = _digamma(gamma) - _digamma(whole)[:, None]
    x = theta[owner] + expected[at]
    top = x.max(axis=1)
    words = n @ (top + np.log(np.exp(x - top[:, None]).sum(axis=1)))
    rest = ((alpha - gamma) * theta).sum() + (_log_gamma(gamma) - _log_gamma(alpha)).sum() - _log_gamma(whole).sum()
    return float(words + rest + len(sizes) * _log_gamma(alpha.sum()))


def log_perplexity(model: LDAModel, bags: DataFrame) -> float:
    """Per-word likelihood bound (negative; Spark's own figure is its upper bound on perplexity).

    Spark's ``logPerplexity`` takes the exponential of the whole matrix of terms and topics for every post, so its time
    grows with posts times vocabulary.  Here the posts' topics come from the model's ``transform``, and a post's part
    of the same bound from its own terms.  The model's matrix is broadcast, as Spark's own inference does.
    """
    if model.isDistributed():
        return -model.logPerplexity(bags)
    weights, alpha = model.topicsMatrix().toArray(), model.estimatedDocConcentration().toArray()
    n_terms, k = weights.shape
    eta = model.getTopicConcentration() if model.isSet("topicConcentration") else 1 / k
    totals = weights.sum(axis=0)
    expected = _digamma(weights) - _digamma(totals)
    shared = bags.sparkSession.sparkContext.broadcast((expected, alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, alpha = shared.value
        for batch in batches:
            at, n, shares = (batch.column(c) for c in ("at", "n", "shares"))
            ends = np.cumsum(pc.list_value_length(at).to_numpy())
            run = (ends - 1) * k // _BOUND_NUMBERS
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    counts = n.slice(a, b - a).flatten().to_numpy()
                    sizes = pc.list_value_length(at.slice(a, b - a)).to_numpy()
                    bound = _post_bounds(expected, alpha, at.slice(a, b - a).flatten().to_numpy(), counts, sizes, shares.slice(a, b - a).flatten().to_numpy().reshape(-1, k))
                    yield pa.RecordBatch.from_pydict({"bound": [bound], "tokens": [float(counts.sum())]})

    bag = F.unwrap_udt(model.getFeaturesCol())
    # a dense vector (type 1) has no list of places
    places = F.when(bag["type"] == 0, bag["indices"]).otherwise(F.sequence(F.lit(0), F.size(bag["values"]) - 1))
    shares = F.unwrap_udt(model.getTopicDistributionCol())["values"]
    rows = model.transform(bags).select(places.alias("at"), bag["values"].alias("n"), shares.alias("shares"))
    rows = rows.where(F.exists("n", lambda x: x != 0))  # a post without a term has no part in it
    posts = rows.mapInArrow(run, "bound double, tokens double").agg(F.sum("bound").alias("bound"), F.sum("tokens").alias("tokens")).first()
    topics = ((eta - weights) * expected).sum() + (_log_gamma(weights) - _log_gamma(np.float64(eta))).sum()
    topics += k * _log_gamma(np.float64(eta * n_terms)) - _log_gamma(totals).sum()
    return float((posts["bound"] + topics) / posts["tokens"])


def topic_diff(left: DataFrame, right: DataFrame, distance: str = "kullback_leibler") -> DataFrame:
    """(topic_left, topic_right, distance) for every pair of topics of two topic-term tables.

    A term without a row in a topic has weight 0 there.  What only one side
    holds follows from sums per topic, so the tables are joined on common
    terms only: K x K rows per term, folded before the shuffle.  The
    divergence is infinite where the right topic lacks a term of the left one.
    """
    def sums(table: DataFrame, side: str) -> DataFrame:
        return table.where("weight > 0").groupBy(F.col("topic").alias(f"topic_{side}")).agg(
            F.sum("weight").alias(f"mass_{side}"), F.count_distinct("term").alias(f"n_{side}")
        )

    a = left.where("weight > 0").select(F.col("topic").alias("topic_left"), "term", F.col("weight").alias("p"))
    b = right.where("weight > 0").select(F.col("topic").alias("topic_right"), "term", F.col("weight").alias("q"))
    common = a.join(b, "term").groupBy("topic_left", "topic_right").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("product"),
        F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("divergence"),
    )
    # the result has one row per pair of topics, whether they share a term or not
    pairs = sums(left, "left").crossJoin(F.broadcast(sums(right, "right"))).join(common, ["topic_left", "topic_right"], "left")
    n, product = F.coalesce("n", F.lit(0)), F.coalesce("product", F.lit(0.0))
    if distance == "kullback_leibler":
        value = F.when(n < F.col("n_left"), F.lit(float("inf"))).otherwise(F.col("divergence"))
    elif distance == "hellinger":
        value = F.sqrt(F.greatest(F.lit(0.5) * (F.col("mass_left") + F.col("mass_right")) - product, F.lit(0.0)))
    elif distance == "jaccard":
        value = F.lit(1.0) - n / (F.col("n_left") + F.col("n_right") - n)
    else:
        raise ValueError(f"unknown distance {distance!r}")
    return pairs.select("topic_left", "topic_right", value.alias("distance"))


def topic_relevance(
    matrix: DataFrame, term_freq: DataFrame, lam: float = 0.6, top: int = 20
) -> DataFrame:
    """(topic, rank, term, relevance): lam * log p(w|t) + (1 - lam) * log(p(w|t) / p(w)).

    ``term_freq`` is (term, n).  The window ranks one topic's vocabulary.
    """
    total = term_freq.agg(F.sum("n")).scalar()
    joined = matrix.where("weight > 0").join(term_freq, "term")
    lift = F.col("weight") / (F.col("n") / total)
    scored = joined.withColumn("relevance", lam * F.log("weight") + (1 - lam) * F.log(lift))
    order = Window.partitionBy("topic").orderBy(F.desc("relevance"), F.asc("term"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("topic", "rank", "term", "relevance")


def topic_prevalence(doc_topics: DataFrame, topic_col: str = "topic", share_col: str = "share", length_col: str = "length") -> DataFrame:
    """Share of each topic in all tokens, from (id, topic, share, length)."""
    sums = doc_topics.groupBy(topic_col).agg(F.sum(F.col(share_col) * F.col(length_col)).alias("mass"))
    return sums.select(topic_col, (F.col("mass") / sums.agg(F.sum("mass")).scalar()).alias("prevalence"))
