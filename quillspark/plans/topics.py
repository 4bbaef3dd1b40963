"""Topic modelling from normalised posts to ranked topics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.functions import constants as C
from quillspark.operators import topics
from quillspark.session import materialize


def topic_model(df: DataFrame, tokens_col: str = "tokens_norm", *, k: int = C.LDA_TOPICS, min_docs: int = C.DICTIONARY_MIN_DOCS, max_share: float = C.DICTIONARY_MAX_SHARE, top: int = 20, id_col: str = "id", **lda):
    """(vectoriser, LDA model, ranked topics with coherence)."""
    corpus = materialize(df.select(id_col, tokens_col), "corpus")
    bow = topics.fit_bag_of_words(corpus, tokens_col, min_docs, max_share)
    bags = bow.transform(corpus)
    model = topics.train_lda(bags, k, **lda)
    terms = topics.topic_terms(df.sparkSession, model, bow.vocabulary, top)
    coherence = topics.umass_coherence(corpus, terms, tokens_col, id_col)
    return bow, model, topics.top_topics(terms, coherence)
