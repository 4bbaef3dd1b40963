"""Corpus, user, language and time statistics.

All are aggregates with map-side combining.  Distinct counts group by the
counted value first, so neither a very active user nor the main language
lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.rows import explode_rows
from quillspark.functions.text import as_col
from quillspark.session import materialize


def top_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an ordering (kept per partition, then merged)."""
    return df.orderBy(*order).limit(k)


def _totals(df: DataFrame, n_tokens: Column, n_kept: Column, n_chars: Column, tokens: Column, written: bool = False) -> DataFrame:
    """The totals and the distinct tokens.  Both read the posts' numbers and tokens; where these take long to make, they are ``written`` first."""
    numbers = {"t": n_tokens.cast("bigint"), "k": n_kept.cast("bigint"), "c": n_chars.cast("bigint"), "tokens": tokens}
    per_post = df.select(*[c.alias(name) for name, c in numbers.items()])
    if written:
        per_post = materialize(per_post, "post-totals")
    distinct = explode_rows(per_post, [], "tokens", "token").agg(F.countDistinct("token").alias("d")).scalar()
    return per_post.agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.sum("t").alias("total_tokens"),
        F.sum("c").alias("total_chars"),
        F.round(F.avg("k"), 3).alias("mean_tokens"),
        F.round(F.avg("c"), 3).alias("mean_chars"),
    ).withColumn("distinct_tokens", distinct)


def corpus_totals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Posts, tokens, characters and distinct tokens, split at every single blank.

    Neighbouring blanks make empty tokens, and those count.
    """
    tokens = F.split(F.col(text_col), " ")
    return _totals(df, F.size(tokens), F.size(tokens), F.length(text_col), tokens)


def corpus_totals_norm(df: DataFrame, text_col: str = "text", tokens_col: str = "tokens_norm") -> DataFrame:
    """The same over normalised tokens; the token total stays that of the blank split."""
    tokens = F.col(tokens_col)
    return _totals(
        df, F.size(F.split(F.col(text_col), " ")), F.size(tokens), F.length(F.array_join(tokens, " ")), tokens, written=True
    )


def corpus_totals_clean(df: DataFrame, text_col: str = "text_clean", tokens_col: str = "tokens_clean") -> DataFrame:
    """The same over cleaned text and tokens."""
    tokens = F.col(tokens_col)
    return _totals(df, F.size(tokens), F.size(tokens), F.length(text_col), tokens, written=True)


def count_by(df: DataFrame, key: Column | str, name: str, count: str = "n") -> DataFrame:
    return df.groupBy(as_col(key).alias(name)).agg(F.count(F.lit(1)).alias(count))


def language_or_unknown(language_col: str = "language") -> Column:
    return F.coalesce(F.col(language_col), F.lit("unknown"))


def language_count(df: DataFrame, language_col: str = "language") -> DataFrame:
    return df.agg(F.countDistinct(language_col).alias("n_languages"))


def top_languages(df: DataFrame, k: int = 10, language_col: str = "language") -> DataFrame:
    counts = count_by(df, language_or_unknown(language_col), "language")
    return top_rows(counts, [F.desc("n"), F.asc("language")], k)


def language_shares(df: DataFrame, threshold: float = 1.0, language_col: str = "language") -> DataFrame:
    """Every language with count, percentage (2 dp) and whether it is below ``threshold``."""
    counts = count_by(df.where(F.col(language_col).isNotNull()), language_col, "language", "frequency")
    everything = counts.agg(F.sum("frequency")).scalar()
    pct = F.round(100.0 * F.col("frequency") / everything, 2)
    return counts.withColumn("pct", pct).withColumn("minor", F.col("pct") < threshold)


def language_proportions(df: DataFrame, threshold: float = 1.0, language_col: str = "language") -> DataFrame:
    """Counts and percentages per language; languages below ``threshold`` percent become ``other``."""
    shares = language_shares(df, threshold, language_col)
    merged = F.when(F.col("minor"), "other").otherwise(F.col("language")).alias("language")
    return (
        shares.groupBy(merged)
        .agg(F.sum("frequency").alias("frequency"), F.round(F.sum("pct"), 2).alias("pct"))
        .orderBy(F.desc("pct"), F.asc("language"))
    )


def minor_languages(df: DataFrame, threshold: float = 1.0, language_col: str = "language") -> DataFrame:
    """The languages that ``language_proportions`` merges into ``other``."""
    return language_shares(df, threshold, language_col).where("minor").drop("minor")


def top_liked_posts(df: DataFrame, k: int = 5, likes_col: str = "favs", id_col: str = "id") -> DataFrame:
    return top_rows(df, [F.desc(likes_col), F.asc(id_col)], k)


def user_count(df: DataFrame, user_col: str = "user") -> DataFrame:
    return df.agg(F.countDistinct(user_col).alias("n_users"))


def top_users(df: DataFrame, k: int = 10, user_col: str = "user") -> DataFrame:
    return top_rows(count_by(df, user_col, "user"), [F.desc("n"), F.asc("user")], k)


def posts_per_user(df: DataFrame, user_col: str = "user", text_col: str = "text") -> DataFrame:
    """Posts with a text per user, most active first."""
    counts = df.groupBy(F.col(user_col).alias("user")).agg(F.count(text_col).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("user"))


def mean_posts_per_user(df: DataFrame, user_col: str = "user", text_col: str = "text") -> DataFrame:
    per_user = df.groupBy(user_col).agg(F.count(text_col).alias("n"))
    return per_user.agg(F.round(F.avg("n"), 3).alias("mean_posts"))


def languages_per_user(df: DataFrame, user_col: str = "user", language_col: str = "language") -> DataFrame:
    """Mean number of languages per user; a missing language counts as one of its own."""
    per_user = df.groupBy(user_col).agg(F.countDistinct(language_or_unknown(language_col)).alias("n"))
    return per_user.agg(F.round(F.avg("n"), 3).alias("mean_languages"))


def users_per_language(df: DataFrame, user_col: str = "user", language_col: str = "language") -> DataFrame:
    per_language = df.groupBy(language_or_unknown(language_col).alias("language")).agg(
        F.countDistinct(user_col).alias("n_users")
    )
    return per_language.orderBy(F.desc("n_users"), F.asc("language"))


def mean_users_per_language(df: DataFrame, user_col: str = "user", language_col: str = "language") -> DataFrame:
    per_language = df.groupBy(language_or_unknown(language_col)).agg(F.countDistinct(user_col).alias("n"))
    return per_language.agg(F.round(F.avg("n"), 3).alias("mean_users"))


def longest_post_per_user(
    df: DataFrame, user_col: str = "user", text_col: str = "text", id_col: str = "id"
) -> DataFrame:
    """The row with the longest text of each user, the smallest id on ties."""
    row = F.struct(*df.columns)
    rank = F.struct(-F.length(text_col), F.col(id_col))
    return df.groupBy(F.col(user_col).alias("_user")).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def most_liked_users(df: DataFrame, k: int = 10, user_col: str = "user", likes_col: str = "favs") -> DataFrame:
    best = df.groupBy(F.col(user_col).alias("user")).agg(F.max(likes_col).alias("likes"))
    return top_rows(best, [F.desc("likes"), F.asc("user")], k)


def least_liked_users(df: DataFrame, k: int = 10, user_col: str = "user", likes_col: str = "favs") -> DataFrame:
    worst = df.groupBy(F.col(user_col).alias("user")).agg(F.min(likes_col).alias("likes"))
    return top_rows(worst, [F.asc("likes"), F.asc("user")], k)


def posts_per_period(df: DataFrame, date_col: str = "date", period: str = "day") -> DataFrame:
    """Posts per day (or per week ending on Monday) over the whole span, empty periods with 0.

    Counts are folded per period first; only the small counted table meets the calendar.
    """
    day = F.col(date_col).cast("date")
    if period == "week":
        day = F.when(F.dayofweek(day) == 2, day).otherwise(F.next_day(day, "Mon"))
    counts = df.where(F.col(date_col).isNotNull()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    step = F.expr("interval 7 days" if period == "week" else "interval 1 day")
    calendar = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", step)).alias("day")
    )
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def posts_per_day(df: DataFrame, date_col: str = "date") -> DataFrame:
    return posts_per_period(df, date_col, "day")
