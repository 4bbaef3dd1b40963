"""Style features as column expressions, grouped by level.

Character level reads the text only.  The other levels are formulas over numbers
of a post (``n_words``, ``n_alpha``, ..).  :func:`list_numbers` counts them in a
post's token list, through the working columns of :func:`token_sets` and
:func:`token_counts`; ``blocks.word_numbers`` sums :func:`word_weights` of the
distinct words of many posts.
Ratios over an empty denominator are NULL, or 0.0 where noted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import patterns as P
from quillspark.functions import tokens as T
from quillspark.functions.text import as_col


def pattern_hits(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(as_col(text), F.lit(pattern)).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(ratio(part, whole))


def pattern_freq(text: Column | str, pattern: str, normalize: bool = True) -> Column:
    """Matches of a pattern per character of the text, or their plain number."""
    hits = pattern_hits(text, pattern)
    return ratio(hits, F.length(as_col(text))) if normalize else hits


def pattern_flag(text: Column | str, pattern: str) -> Column:
    """1 where the pattern occurs, else 0."""
    return as_col(text).rlike(pattern).cast("int")


def built(recipes: dict[str, Callable[[], Column]], names) -> dict[str, Column]:
    """The named columns (all without ``names``); the others are never put together."""
    return {n: make() for n, make in recipes.items() if names is None or n in names}


def character_features(text: Column | str, punctuation_denominator: str = "spaced", names=None) -> dict[str, Column]:
    """Character level.  ``punctuation_denominator='spaced'`` counts the blanks that
    stand between the characters when they are joined by spaces (2n - 1)."""
    text = as_col(text)
    n = F.length(text)
    spaced = 2 * n - 1 if punctuation_denominator == "spaced" else n
    recipes = {
        "char_punc_freq": lambda: ratio(pattern_hits(text, P.ASCII_PUNCT), spaced),
        "digit_freq": lambda: pattern_freq(text, P.DIGIT),
        "whitespace_freq": lambda: pattern_freq(text, " "),
        "linebreak_freq": lambda: pattern_freq(text, P.LINEBREAK),
        "uppercased_char_freq": lambda: pattern_freq(text, P.ASCII_UPPER),
        "special_char_freq": lambda: pattern_freq(text, P.SPECIAL_CHAR_FAST),
        "repeated_questionmark": lambda: pattern_flag(text, P.REPEATED_QUESTION),
        "repeated_periods": lambda: pattern_flag(text, P.REPEATED_PERIOD),
        "repeated_exclamation": lambda: pattern_flag(text, P.REPEATED_EXCLAMATION),
        "contains_equals": lambda: text.contains("=").cast("int"),
    }
    return built(recipes, names)


def token_sets(text: Column | str, tokens: Column | str) -> dict[str, Column]:
    """First stage of working columns: the token sets that several features share."""
    text, tokens = as_col(text), as_col(tokens)
    surface = F.transform(tokens, lambda t: t["text"])
    return {
        "_n_doc": F.size(tokens),
        "_words": F.transform(F.filter(tokens, lambda t: ~t["is_punct"] & ~t["is_space"]), lambda t: t["text"]),
        "_alpha": F.transform(F.filter(tokens, lambda t: t["is_alpha"]), lambda t: t["text"]),
        "_sent_lengths": F.transform(T.split_sentences(text), F.length),
        "_quoted": quoted_words(text),
        "_emojis": T.emojis_of(surface),
        "_emoticons": T.emoticons_of(surface),
    }


def quoted_words(text: Column | str) -> Column:
    """Alphanumeric tokens inside quotes."""
    quotes = F.array_join(T.extract_all(text, P.QUOTED), " ")
    return F.filter(T.social_tokenize(quotes), lambda t: t.rlike(P.ALL_ALNUM))


def token_counts() -> dict[str, Column]:
    """Second stage, from the first."""
    alpha = F.col("_alpha")
    return {
        "_low": F.sort_array(F.transform(alpha, F.lower)),
        "_n_syllables": total(F.transform(alpha, syllables)),
    }


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


def count_where(tokens: Column, condition) -> Column:
    return F.size(F.filter(tokens, condition))


def syllables(word: Column) -> Column:
    """Estimated syllables: groups of neighbouring vowels, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit(P.VOWEL_GROUP)))


def run_length_count(ordered: Column, times: int) -> Column:
    """Number of values that occur exactly ``times`` times in a sorted array."""

    def differs(i: Column, x: Column) -> Column:
        return F.coalesce(F.get(ordered, i) != x, F.lit(True))

    def starts_run(x: Column, i: Column) -> Column:
        inside = F.lit(True) if times == 1 else ~differs(i + (times - 1), x)
        return differs(i - 1, x) & inside & differs(i + times, x)

    return F.size(F.filter(ordered, starts_run))


def word_weights() -> dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]]:
    """For each number of a post: fields of the annotation, and what one annotated word adds to it by them."""
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    alpha = lambda test: (("is_alpha",), lambda t: flag(t["is_alpha"] & test(t["text"])))
    shown = ("is_punct", "is_space")
    word = lambda t: ~t["is_punct"] & ~t["is_space"]
    tagged = lambda field, *values: (("is_alpha", field), lambda t: flag(t["is_alpha"] & t[field].isin(*values)))
    return {
        "n_words": (shown, lambda t: flag(word(t))),
        "word_chars": (shown, lambda t: F.when(word(t), F.length(t["text"])).otherwise(0)),
        "n_alpha": (("is_alpha",), lambda t: flag(t["is_alpha"])),
        "n_upper": alpha(is_upper), "n_short": alpha(is_short), "n_long": alpha(is_long),
        "n_num": (("like_num",), lambda t: flag(t["like_num"])),
        "n_past": tagged("tense", "Past"), "n_pres": tagged("tense", "Pres"),
        "n_adj": tagged("degree", "Pos"), "n_comp": tagged("degree", "Cmp", "Sup"),
        "n_emotes": ((), lambda t: flag(t["text"].rlike("^" + P.EMOJI_GUARDED)) + flag(t["text"].isin(*C.EMOTICONS))),
        "n_syllables": (("is_alpha",), lambda t: F.when(t["is_alpha"], syllables(t["text"])).otherwise(0)),
        "n_stop": (("is_stop",), lambda t: flag(t["is_stop"])),
        "n_punct": (("is_punct",), lambda t: flag(t["is_punct"])),
        "n_letters": (("is_alpha",), lambda t: F.when(t["is_alpha"], F.length(t["text"])).otherwise(0)),
        "n_complex": alpha(is_complex), "n_difficult": alpha(is_difficult),
    }


def is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def is_short(word: Column) -> Column:
    return F.length(word) <= 3


def is_long(word: Column) -> Column:
    return word.rlike(P.ELONGATED)


def is_complex(word: Column) -> Column:
    return syllables(word) >= 3


def is_difficult(word: Column) -> Column:
    return ~F.lower(word).isin(*C.STOP_WORDS)


def list_numbers(tokens: Column | str = "tokens", emotes: Column | str | None = None) -> dict[str, Callable[[], Column]]:
    """Numbers of a post from its token list, over the working columns."""
    tokens = as_col(tokens)
    words, alpha, low = F.col("_words"), F.col("_alpha"), F.col("_low")

    def tagged(field: str, *values: str) -> Column:
        return count_where(tokens, lambda t: t["is_alpha"] & t[field].isin(*values))

    def n_emotes() -> Column:
        if emotes is None:
            return F.size("_emojis") + F.size("_emoticons")
        return F.size(as_col(emotes)["emojis"]) + F.size(as_col(emotes)["emoticons"])

    return {
        "n_doc": lambda: F.col("_n_doc"),
        "n_words": lambda: F.size(words),
        "word_chars": lambda: total(F.transform(words, F.length)),
        "n_sents": lambda: F.size("_sent_lengths"),
        "sent_chars": lambda: total(F.col("_sent_lengths")),
        "n_alpha": lambda: F.size(alpha),
        "n_upper": lambda: count_where(alpha, is_upper),
        "n_short": lambda: count_where(alpha, is_short),
        "n_long": lambda: count_where(alpha, is_long),
        "n_num": lambda: count_where(tokens, lambda t: t["like_num"]),
        "n_past": lambda: tagged("tense", "Past"),
        "n_pres": lambda: tagged("tense", "Pres"),
        "n_adj": lambda: tagged("degree", "Pos"),
        "n_comp": lambda: tagged("degree", "Cmp", "Sup"),
        "n_emotes": n_emotes,
        "n_quoted": lambda: F.size("_quoted"),
        "n_types": lambda: F.size(F.array_distinct(alpha)),
        "n_once": lambda: run_length_count(low, 1),
        "n_twice": lambda: run_length_count(low, 2),
        "n_syllables": lambda: F.col("_n_syllables"),
        "n_stop": lambda: count_where(tokens, lambda t: t["is_stop"]),
        "n_punct": lambda: count_where(tokens, lambda t: t["is_punct"]),
        "n_root": lambda: count_where(tokens, lambda t: (t["dep"] == "ROOT") & ~t["is_space"]),
        "n_letters": lambda: total(F.transform(alpha, F.length)),
        "n_complex": lambda: count_where(alpha, is_complex),
        "n_difficult": lambda: count_where(alpha, is_difficult),
    }


def word_features(n: Callable[[str], Column], nonstandard: Column | str | None = None, names=None) -> dict[str, Column]:
    """Word level; ``n`` gives a number of the post by its name.

    ``nonstandard`` is the number of distinct unknown words of the post, if known.
    """
    recipes = {
        "total_word_len": lambda: n("n_words").cast("bigint"),
        "avg_word_len": lambda: ratio(n("word_chars"), n("n_words")),
        "avg_sentence_len_words": lambda: ratio(n("n_words"), n("n_sents")),
        "avg_sentence_len_chars": lambda: ratio(n("sent_chars"), n("n_sents")),
        "uppercased_words": lambda: ratio_or_zero(n("n_upper"), n("n_alpha")),
        "short_words": lambda: ratio_or_zero(n("n_short"), n("n_alpha")),
        "elongated_words": lambda: ratio_or_zero(n("n_long"), n("n_alpha")),
        "numberlike_tokens": lambda: ratio(n("n_num"), n("n_doc")),
        "past_tense_words": lambda: ratio(n("n_past"), n("n_alpha")),
        "present_tense_words": lambda: ratio(n("n_pres"), n("n_alpha")),
        "positive_adjectives": lambda: ratio(n("n_adj"), n("n_alpha")),
        "comp_and_sup_adjectives": lambda: ratio(n("n_comp"), n("n_alpha")),
        "emotes": lambda: ratio(n("n_emotes"), n("n_words")),
        "quoted_words": lambda: ratio(n("n_quoted"), n("n_words")),
        "type_token_ratio": lambda: ratio_or_zero(n("n_types"), n("n_alpha")),
        "hapax_legomena": lambda: ratio_or_zero(n("n_once"), n("n_alpha")),
        "hapax_dislegomena": lambda: ratio_or_zero(n("n_twice"), n("n_alpha")),
        "syllable_freqs": lambda: ratio_or_zero(n("n_syllables"), n("n_alpha")),
        "readability_flesch_kincaid": lambda: 206.835
        - 1.015 * ratio(n("n_alpha"), n("n_sents"))
        - 84.6 * ratio(n("n_syllables"), n("n_alpha")),
    }
    if nonstandard is not None:
        recipes["nonstandard_spelling"] = lambda: ratio(as_col(nonstandard), n("n_alpha"))
    return built(recipes, names)


def run_starts(ordered: Column) -> Column:
    """Places (from 0) at which a new value begins in a sorted array."""
    marked = F.transform(ordered, lambda x, i: F.when(F.coalesce(F.get(ordered, i - 1) != x, F.lit(True)), i))
    return F.filter(marked, lambda i: i.isNotNull())


def run_lengths(starts: Column, n: Column) -> Column:
    """Lengths of the runs that begin at ``starts`` in an array of ``n`` entries."""
    return F.transform(starts, lambda s, k: (F.coalesce(F.get(starts, k + 1), n) - s).cast("bigint"))


def richness_features(spectrum: Column | str, brunet: float = C.BRUNET_EXPONENT) -> dict[str, Column]:
    """Vocabulary richness from the numbers of times that each distinct word of a post occurs.

    NULL without a word; Simpson's index also with one word, Honore's also where every word occurs once.
    """
    times = as_col(spectrum)
    total_of = lambda f: F.aggregate(times, F.lit(0).cast("bigint"), lambda acc, x: acc + f(x))
    n_types = F.size(times).cast("double")
    n = total_of(lambda x: x).cast("double")
    once, twice = F.size(F.filter(times, lambda x: x == 1)), F.size(F.filter(times, lambda x: x == 2))
    some = lambda value: F.when(n > 0, value)
    return {
        "brunet_w": some(F.pow(n, F.pow(n_types, F.lit(-brunet)))),
        "yule_k": 10_000 * F.try_divide(total_of(lambda x: x * x) - n, n * n),
        "honore_r": some(F.try_divide(100 * F.ln(n), 1 - ratio(once, n_types))),
        "sichel_s": ratio(twice, n_types),
        "simpson_d": F.try_divide(total_of(lambda x: x * (x - 1)).cast("double"), n * (n - 1)),
    }


def readability_extra(n: Callable[[str], Column], names=None) -> dict[str, Column]:
    """Further readability scores from the same numbers.

    A word is difficult for the word-list score when it is not in the list of easy words.
    """
    per_sentence = lambda: ratio(n("n_alpha"), n("n_sents"))
    difficult = lambda: 100 * ratio(n("n_difficult"), n("n_alpha"))
    recipes = {
        "automated_readability": lambda: 4.71 * ratio(n("n_letters"), n("n_alpha")) + 0.5 * per_sentence() - 21.43,
        "coleman_liau": lambda: 5.88 * ratio(n("n_letters"), n("n_alpha")) - 29.6 * ratio(n("n_sents"), n("n_alpha")) - 15.8,
        "gunning_fog": lambda: 0.4 * (per_sentence() + 100 * ratio(n("n_complex"), n("n_alpha"))),
        "dale_chall": lambda: 0.1579 * difficult()
        + 0.0496 * per_sentence()
        + F.when(difficult() > 5, F.lit(3.6365)).otherwise(F.lit(0.0)),
    }
    return built(recipes, names)


def sentence_features(n: Callable[[str], Column], names=None) -> dict[str, Column]:
    """Sentence level: shares of all tokens."""
    recipes = {
        "stopword_freq": lambda: ratio(n("n_stop"), n("n_doc")),
        "syn_punc_freq": lambda: ratio(n("n_punct"), n("n_doc")),
        "root_freq": lambda: ratio(n("n_root"), n("n_doc")),
    }
    return built(recipes, names)


def document_features(text: Column | str, n: Callable[[str], Column], names=None) -> dict[str, Column]:
    """Document level counts."""
    recipes = {
        "n_sents": lambda: n("n_sents").cast("bigint"),
        "n_mentions": lambda: pattern_hits(F.lower(as_col(text)), P.USER_MENTION),
    }
    return built(recipes, names)


def alnum_pos_tags(tokens: Column | str) -> Column:
    """Tags of the alphanumeric tokens, in order."""
    return F.transform(
        F.filter(as_col(tokens), lambda t: t["text"].rlike(P.ALL_ALNUM)), lambda t: t["pos"]
    )


def pos_ngrams(tokens: Column | str, sizes=(1, 2, 3)) -> Column:
    """Lower-cased tag n-grams; one-letter tags vanish before the n-grams are built."""
    tags = F.filter(F.transform(alnum_pos_tags(tokens), F.lower), lambda t: F.length(t) > 1)
    return T.ngrams_of_sizes(tags, sizes)
