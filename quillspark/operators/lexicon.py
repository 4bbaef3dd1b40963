"""Category lexicons: matching, totals, comparison.

A lexicon is a table ``(category, term, is_prefix)``.  A term matches whole
words without regard to case; a prefix term matches every word that starts
with it; a text position counts once per category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.rows import explode_rows
from quillspark.functions import patterns as P
from quillspark.functions import style
from quillspark.functions import tokens as T
from quillspark.operators.joins import compare_side_by_side, term_join


def lexicon_from_wide(wide: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Wide sheet (one category per column, terms below) to (category, term, is_prefix)."""
    categories = categories or wide.columns
    long = wide.select(*[F.col(c).cast("string").alias(c) for c in categories]).unpivot([], categories, "category", "term")
    term = F.trim("term")
    kept = long.where(term.isNotNull() & (term != "")).withColumn("term", term)
    return kept.select(
        "category",
        F.when(kept["term"].endswith("*"), F.expr("left(term, length(term) - 1)")).otherwise(kept["term"]).alias("term"),
        kept["term"].endswith("*").alias("is_prefix"),
    )


def category_pattern(exact: list[str], prefixes: list[str]) -> str:
    """Pattern of one category, terms escaped, longest first, bounded by non-word characters."""
    parts = []
    if prefixes:
        parts.append(f"(?:{P.alternation(prefixes)}){P.WORD_CHAR}*")
    if exact:
        parts.append(f"(?:{P.alternation(exact)})")
    edge = P.WORD_CHAR
    return f"(?iu)(?<!{edge})(?:{'|'.join(f'{p}(?!{edge})' for p in parts)})"


def lexicon_match_patterns(
    df: DataFrame, patterns: dict[str, str], text_col: str = "text", id_col: str = "id", prefix: str = ""
) -> DataFrame:
    """Hits per post, one column per category, in one pass over the text and without a shuffle.

    For lexicons of a few categories that are known when the job is built;
    terms of several words are possible here.
    """
    hits = [style.pattern_hits(text_col, p).alias(prefix + c) for c, p in patterns.items()]
    return df.select(id_col, *hits)


def lexicon_match(df: DataFrame, lexicon: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, category, hits) for lexicons of any size, single-word terms.

    Exact terms join on the word, prefix terms on the beginnings of the word
    that are as long as some prefix term.  The words meet the terms first, in
    place where the terms are few, and only hits are counted and moved.
    """
    lexicon = lexicon.select("category", F.lower("term").alias("term"), "is_prefix").distinct()
    words = explode_rows(df, [id_col], T.plain_words(F.lower(F.col(text_col))), "word")
    # one row per (term, kind) with all its categories: the join then never multiplies rows of one key
    terms = lexicon.groupBy("term", "is_prefix").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    lengths = terms.where("is_prefix").agg(F.collect_set(F.length("term"))).scalar()
    words = words.withColumn("_lengths", lengths)
    beginnings = F.transform(
        F.filter("_lengths", lambda k: k <= F.length("word")),
        lambda k: F.struct(F.substring(F.col("word"), F.lit(1), k).alias("term"), F.lit(True).alias("is_prefix")),
    )
    forms = F.concat(F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("is_prefix"))), beginnings)
    probes = explode_rows(words, [id_col, "word"], forms, "f").select(id_col, "word", "f.term", "f.is_prefix")
    hits = term_join(probes, terms, ["term", "is_prefix"])
    hits = hits.select(id_col, "word", "term", "is_prefix", F.explode("categories").alias("category"))
    # an occurrence hits a category once for every form of the word that is listed there
    n_forms = F.size(F.collect_set(F.struct("term", "is_prefix")))
    per_word = hits.groupBy(id_col, "word", "category").agg((F.count(F.lit(1)) / n_forms).cast("long").alias("n"))
    return per_word.groupBy(id_col, "category").agg(F.sum("n").alias("hits"))


def lexicon_totals(matches: DataFrame) -> DataFrame:
    """Corpus sum per category, largest first."""
    return (
        matches.groupBy("category").agg(F.sum("hits").alias("total")).orderBy(F.desc("total"), F.asc("category"))
    )


def lexicon_share(totals: DataFrame, n_tokens) -> DataFrame:
    """Share of all hits and frequency relative to the corpus size.

    ``n_tokens`` is a number or a scalar column with the tokens of the corpus.
    """
    everything = totals.agg(F.sum("total")).scalar()
    n_tokens = F.lit(n_tokens) if isinstance(n_tokens, (int, float)) else n_tokens
    rel = F.col("total") / n_tokens
    return totals.select(
        "category",
        "total",
        F.round(100.0 * F.col("total") / everything, 2).alias("cat_pct"),
        F.round(rel, 8).alias("rel_freq"),
        F.round(100.0 * rel, 2).alias("rel_freq_pct"),
    )


def lexicon_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two corpora side by side with the difference of their relative frequencies."""
    return compare_side_by_side(left, right, "category", "rel_freq_pct", ("target", "background"))


def lexicon_duplicates(lexicon: DataFrame) -> DataFrame:
    """Terms listed more than once over all categories."""
    counts = lexicon.groupBy("term", "is_prefix").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").orderBy(F.desc("n"), F.asc("term"))


def lexicon_features(features: DataFrame, matches: DataFrame, categories: list[str], id_col: str = "id") -> DataFrame:
    """Feature table with one hit column per category, 0 where nothing matched."""
    wide = matches.groupBy(id_col).pivot("category", categories).agg(F.sum("hits"))
    return features.join(wide, id_col, "left").fillna(0, subset=categories)


def lexicon_chi_square(matches_wide: DataFrame, categories: list[str]) -> DataFrame:
    """Goodness of fit of the per-post counts with a uniform distribution, per category.

    sum((o - e)^2) / e with e the mean equals sum(o^2) / e - sum(o), so one pass is enough.
    """
    stats = matches_wide.select(
        *[F.struct(F.lit(c).alias("category"), F.col(c).cast("double").alias("o")).alias(c) for c in categories]
    )
    long = stats.select(F.explode(F.array(*categories)).alias("x")).select("x.category", "x.o")
    sums = long.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("o").alias("s"), F.sum(F.col("o") * F.col("o")).alias("q")
    )
    chi = F.try_divide(F.col("q") * F.col("n_docs"), F.col("s")) - F.col("s")
    return sums.select("category", (F.col("n_docs") - 1).alias("dof"), F.round(chi, 6).alias("chi_square"))
