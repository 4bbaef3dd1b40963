"""Tokenizers, token filters and the token annotation, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import patterns as P
from quillspark.functions.text import as_col, string_array

#: Bytes of texts that are cut into runs of characters at once (a text is never cut).
RUN_BYTES = 1 << 20

ANNOTATION_TYPE = (
    "array<struct<text:string,sent_id:int,is_punct:boolean,is_space:boolean,is_alpha:boolean,"
    "like_num:boolean,is_stop:boolean,pos:string,dep:string,tense:string,degree:string>>"
)


def extract_all(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(pattern), 0)


def social_tokenize(text: Column | str) -> Column:
    """Surface tokens; emoticons, emojis, hashtags, mentions and links stay whole."""
    return extract_all(text, P.SOCIAL_TOKEN_FAST)


def word_tokenize_norm(text: Column | str) -> Column:
    """Word tokens; hashtags and hyphenated words stay whole."""
    return extract_all(text, P.NORM_TOKEN)


def plain_words(text: Column | str) -> Column:
    return extract_all(text, P.PLAIN_WORD)


def split_sentences(text: Column | str) -> Column:
    """Sentences: a break follows ``. ! ?`` runs before white space, and every line end."""
    marked = F.regexp_replace(as_col(text), P.SENTENCE_END, "$1\n")
    trimmed = F.transform(F.split(marked, P.LINE_BREAKS), lambda s: F.trim(s, F.lit(P.SPACE_CHARS)))
    return F.filter(trimmed, lambda s: s != "")


def letter_words(text: Column | str) -> Column:
    """The tokens of the annotation that are all letters, without building the annotation."""
    surface = F.flatten(F.transform(split_sentences(text), social_tokenize))
    return F.filter(surface, lambda t: t.rlike(P.ALL_LETTERS))


# ------------------------------------------------------------------ token filters


def hashtags_of(tokens: Column | str) -> Column:
    return F.transform(F.filter(as_col(tokens), lambda t: t.startswith("#")), F.lower)


def starts_with_emoji(token: Column) -> Column:
    """Whether a token begins with an emoji; a comparison (by code point) with the first one settles ordinary words without the pattern."""
    return (token >= P.FIRST_EMOJI) & token.rlike("^" + P.EMOJI_GUARDED)


def emojis_of(tokens: Column | str) -> Column:
    """Tokens that begin with an emoji."""
    return F.filter(as_col(tokens), starts_with_emoji)


def emoticons_of(tokens: Column | str, emoticons=C.EMOTICONS) -> Column:
    return F.filter(as_col(tokens), lambda t: t.isin(*emoticons))


def extract_emotes(tokens: Column | str, emoticons=C.EMOTICONS) -> Column:
    """Struct of the emojis and the emoticons of a token list, repeats kept."""
    return F.struct(
        emojis_of(tokens).alias("emojis"), emoticons_of(tokens, emoticons).alias("emoticons")
    )


def clean_tokens(tokens: Column | str, emoticons=C.EMOTICONS) -> Column:
    """Tokens that are no marker, no emote and no hashtag.

    A token whose lower-case form is a hashtag of the post is itself a hashtag,
    so one look at the token decides and the cost stays linear.
    """
    return F.filter(
        as_col(tokens),
        lambda t: ~t.isin(*C.MARKER_TOKENS, *emoticons) & ~t.startswith("#") & ~starts_with_emoji(t),
    )


def remove_stopwords(tokens: Column | str, stop_words=C.STOP_WORDS + C.PLATFORM_STOP_WORDS) -> Column:
    return F.filter(as_col(tokens), lambda t: ~F.lower(t).isin(*stop_words))


def remove_punct_tokens(tokens: Column | str) -> Column:
    """Drop tokens found, as a whole, inside the ASCII punctuation string."""
    return F.filter(as_col(tokens), lambda t: ~F.contains(F.lit(C.ASCII_PUNCTUATION), F.lower(t)))


def lemma(token: Column, lemmas=C.LEMMAS) -> Column:
    """Lemma from a small table, else the lower-cased token."""
    low = F.lower(token)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in lemmas for x in pair]), low), low)


def lemmatize(tokens: Column | str, lemmas=C.LEMMAS) -> Column:
    words = [w for w, _ in lemmas]
    # the membership test is one hash probe; only hits read the table
    return F.transform(
        as_col(tokens),
        lambda t: F.when(F.lower(t).isin(*words), lemma(t, lemmas)).otherwise(F.lower(t)),
    )


def keep_content_tokens(tokens: Column | str) -> Column:
    """Tokens that start like a word and are longer than one character, without hashtags."""
    return F.filter(
        as_col(tokens),
        lambda t: t.rlike(P.WORD_START) & (F.length(t) > 1) & ~t.startswith("#"),
    )


# -------------------------------------------------------------------- annotation


def rule_pos(token: Column, low: Column, alpha: Column) -> Column:
    """Part of speech by shape, word lists and endings.

    Patterns run on tokens that are not all letters only, and one membership
    test guards the word lists, so an ordinary word costs little.
    """
    lists = [("NUM", C.NUMBER_WORDS), *C.CLOSED_CLASSES]
    lists.append(("ADJ", C.POSITIVE_ADJECTIVES + C.COMPARATIVE_ADJECTIVES + C.SUPERLATIVE_ADJECTIVES))
    listed = F.when(low.isin(*lists[0][1]), lists[0][0])
    for tag, words in lists[1:]:
        listed = listed.when(low.isin(*words), tag)
    out = F.when(~alpha & token.rlike(P.NUMBER), "NUM").when(~alpha & token.rlike(P.ALL_PUNCT), "PUNCT")
    out = out.when(low.isin(*[w for _, words in lists for w in words]), listed)
    for tag, endings in C.SUFFIX_CLASSES:
        ends = reduce(lambda x, y: x | y, [low.endswith(e) for e in endings])
        out = out.when((F.length(low) > 4) & ends, tag)
    out = out.when(~alpha & ~token.rlike(r"\p{L}"), "SYM")
    return out.when(token.rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN")


def rule_tense(low: Column, pos: Column) -> Column:
    verb = pos == "VERB"
    return F.when(low.isin(*C.PAST_AUXILIARIES) | (verb & low.endswith("ed")), "Past").when(
        low.isin(*C.PRESENT_AUXILIARIES) | verb, "Pres"
    )


def rule_degree(low: Column, pos: Column) -> Column:
    adj = pos == "ADJ"
    return (
        F.when(low.isin(*C.COMPARATIVE_ADJECTIVES), "Cmp")
        .when(low.isin(*C.SUPERLATIVE_ADJECTIVES) | (adj & low.endswith("est")), "Sup")
        .when(adj, "Pos")
    )


def annotate(
    text: Column | str,
    *,
    stop_words=C.STOP_WORDS,
    pos: Callable[[Column, Column, Column], Column] = rule_pos,
    tense: Callable[[Column, Column], Column] = rule_tense,
    degree: Callable[[Column, Column], Column] = rule_degree,
) -> Column:
    """Token annotation of a text: one struct per token, sentences in order.

    The first token of a sentence stands in for its syntactic root.  The three
    passes over the array let a later field read an earlier one (lower form and
    letters-only flag, then tag), instead of working it out in every condition.
    """
    surface = F.flatten(
        F.transform(
            split_sentences(text), lambda s, i: F.transform(social_tokenize(s), lambda t, j: _surface(t, i.cast("int"), j == 0))
        )
    )
    return _annotation(surface, stop_words, pos, tense, degree)


def annotate_words(words: Column | str, fields) -> Column:
    """The chosen fields of the annotation of words out of their sentences, without those that do not follow from the word (``sent_id``, ``dep``)."""
    surface = F.transform(as_col(words), lambda t: _surface(t, F.lit(0), F.lit(False)))
    return _annotation(surface, C.STOP_WORDS, rule_pos, rule_tense, rule_degree, {"text", *fields})


def _surface(token: Column, sent_id: Column, first: Column) -> Column:
    return F.struct(
        token.alias("text"), F.lower(token).alias("low"), token.rlike(P.ALL_LETTERS).alias("alpha"),
        sent_id.alias("sent_id"), first.alias("first"),
    )


def _annotation(surface: Column, stop_words, pos, tense, degree, fields=None) -> Column:
    """All fields, or the chosen ones; the tag is worked out only where a chosen field reads it."""
    chosen = lambda *named: [c.alias(name) for name, c in named if fields is None or name in fields]
    tagged = fields is None or not {"pos", "tense", "degree"}.isdisjoint(fields)

    def tag(x: Column) -> Column:
        token, low, alpha = x["text"], x["low"], x["alpha"]
        return F.struct(
            token.alias("text"), low.alias("low"), x["sent_id"].alias("sent_id"), x["first"].alias("first"),
            *chosen(
                ("is_punct", ~alpha & token.rlike(P.ALL_PUNCT)),
                ("is_space", ~alpha & token.rlike(P.ALL_SPACE)),
                ("is_alpha", alpha),
                ("like_num", (~alpha & token.rlike(P.NUMBER)) | low.isin(*C.NUMBER_WORDS)),
                ("is_stop", low.isin(*stop_words)),
            ),
            *([pos(token, low, alpha).alias("pos")] if tagged else []),
        )

    def finish(x: Column) -> Column:
        same = ("text", "sent_id", "is_punct", "is_space", "is_alpha", "like_num", "is_stop", "pos")
        if not tagged:
            return F.struct(*chosen(*[(f, x[f]) for f in same if f != "pos" and f in fields]))
        return F.struct(
            *chosen(
                *[(f, x[f]) for f in same if fields is None or f in fields],
                ("dep", F.when(x["first"], "ROOT").otherwise("dep")),
                ("tense", tense(x["low"], x["pos"])),
                ("degree", degree(x["low"], x["pos"])),
            )
        )

    return F.transform(F.transform(surface, tag), finish)


# ------------------------------------------------------------------------ n-grams


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression that is named inside the body of a ``transform`` is worked
    out again for every element; a bound one is a plain variable there.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams_of_sizes(tokens: Column | str, sizes, sep: str = " ") -> Column:
    """Runs of neighbouring tokens of every size, the shorter sizes first.

    Entries are read by place.  (``slice`` copies the whole array on every call,
    which makes long posts quadratic.)
    """

    def runs(ts: Column, n: int) -> Column:
        if n == 1:
            return ts

        def run(i: Column) -> Column:
            parts = [F.get(ts, i + k) for k in range(n)]
            return F.concat_ws(sep, *parts) if sep else F.concat(*parts)

        places = F.sequence(F.lit(0), F.size(ts) - n)
        return F.when(F.size(ts) >= n, F.transform(places, run)).otherwise(string_array(()))

    return bind(as_col(tokens), lambda ts: F.concat(*[runs(ts, n) for n in sizes]))


def token_ngrams(tokens: Column | str, n: int, sep: str = " ") -> Column:
    """Runs of ``n`` neighbouring tokens; empty when there are fewer tokens."""
    return ngrams_of_sizes(tokens, (n,), sep)


def char_ngrams(text: Column | str, n: int) -> Column:
    """Runs of ``n`` characters after collapsing white-space runs; case kept.  A null text has none.

    Runs of texts in an Arrow batch are cut at once, so the cost is linear in their length.
    """
    return F.arrow_udf(lambda texts: _char_runs(texts, n), "array<string>")(collapsed(text))


def collapsed(text: Column | str) -> Column:
    """The text with every run of white space as one blank."""
    return F.regexp_replace(as_col(text), f"{P.SPACE}{{2,}}", " ")


def text_runs(texts: pa.Array) -> list[tuple[int, int]]:
    """Runs of texts with about RUN_BYTES each."""
    run = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return list(zip(cuts, cuts[1:], strict=False))


def _char_runs(texts: pa.Array, n: int) -> pa.ListArray:
    return pa.concat_arrays([runs_of_texts(texts.slice(a, b - a), n) for a, b in text_runs(texts)])


def runs_of_texts(texts: pa.Array, n: int) -> pa.ListArray:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    data = b"".join(texts.cast(pa.binary()).drop_null().to_pylist())
    octets = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((octets & 0xC0) != 0x80)  # of the characters, by octet
    chars = np.diff(np.searchsorted(starts, ends), prepend=0)
    per_text = np.maximum(chars - (n - 1), 0)
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    first = np.arange(bounds[-1]) + np.repeat(np.cumsum(chars) - chars - bounds[:-1], per_text)
    begin = starts[first]
    length = np.append(starts, len(octets))[first + n] - begin
    offsets = np.concatenate(([0], np.cumsum(length)))
    grams = octets[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])]
    values = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(grams))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
