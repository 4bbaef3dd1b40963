"""Word lists and code-point ranges used by the text functions.

Everything in this module is a fixed value: plain data with no logic.  All of
the lists are defaults; the operators that use one take it as an argument.
"""

# ---------------------------------------------------------------- fixed values

#: Western emoticons, counted and stripped as literals.
#: Emoticons, built by rule: eyes, nose and mouth; mouth, nose and eyes; glasses; crossed eyes; hearts.
EMOTICONS = (
    *(eyes + nose + mouth for eyes in ":;=" for nose in ("", "-") for mouth in ")(][DPpOo/\\|"),
    *(mouth + nose + eyes for mouth in ")(][" for nose in ("", "-") for eyes in ":;="),
    *("8" + nose + mouth for nose in ("", "-") for mouth in ")("), *(eyes + mouth for eyes in "Xx" for mouth in "DP"),
    ":3", ":*", ":-*", ":^)", ":'(", ":'-(", "<3", "</3",
)

#: English function words, the default stop list.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and",
    "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing",
    "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "might",
    "more", "most", "must", "my", "myself", "no", "nor", "not", "now", "of", "off",
    "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over",
    "own", "same", "shall", "she", "should", "so", "some", "such", "than", "that",
    "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they",
    "this", "those", "through", "to", "too", "under", "until", "up", "us", "very",
    "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom",
    "why", "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
)

#: Platform words that the topic mode treats as stop words too.
PLATFORM_STOP_WORDS = ("rt", "url")

#: Tokens that the classify mode drops, case kept.
MARKER_TOKENS = ("RT", "URL")

#: ASCII punctuation, in code-point order.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Words that stand for a number.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty",
    "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
    "billion", "trillion",
)

#: Closed word classes of the rule tagger: tag -> words, first match wins.
CLOSED_CLASSES = (
    ("DET", ("the", "a", "an", "this", "these", "those", "each", "every", "some", "any", "no", "all", "both")),
    ("PRON", ("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "who", "what", "myself", "yourself", "himself", "herself", "itself", "themselves", "my", "your", "his", "its", "our", "their")),
    ("AUX", ("am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may", "might", "must")),
    ("SCONJ", ("because", "if", "while", "although", "unless", "since", "whether", "that")),
    ("CCONJ", ("and", "or", "but", "nor", "yet")),
    ("ADP", ("of", "in", "on", "at", "by", "for", "with", "from", "about", "into", "over", "under", "after", "before", "between", "through", "during", "against", "as")),
    ("PART", ("to", "not")),
    ("ADV", ("very", "too", "also", "now", "then", "here", "there", "never", "always", "often", "just", "only", "so", "more", "most", "when", "where", "why", "how")),
    ("INTJ", ("oh", "wow", "yes", "hey", "hello", "lol", "omg", "please")),
)

#: Open word classes of the rule tagger: tag -> endings, tried after the closed classes.
SUFFIX_CLASSES = (
    ("ADV", ("ly",)),
    ("VERB", ("ing", "ed", "ize", "ise", "ify")),
    ("ADJ", ("ous", "ful", "able", "ible", "ive", "less", "ish", "est")),
)

#: Auxiliaries by tense.
PAST_AUXILIARIES = ("was", "were", "had", "did", "been")
PRESENT_AUXILIARIES = ("am", "is", "are", "have", "has", "do", "does")

#: Adjectives that do not show their degree by an ending.
POSITIVE_ADJECTIVES = ("good", "bad", "great", "big", "small", "new", "old", "real", "true", "free", "right", "wrong", "high", "low")
COMPARATIVE_ADJECTIVES = ("better", "worse", "less", "more", "bigger", "smaller", "newer", "older", "higher", "lower")
SUPERLATIVE_ADJECTIVES = ("best", "worst", "least", "most")

#: Irregular lemmas of the default lemma table.
LEMMAS = (
    ("people", "person"), ("children", "child"), ("men", "man"), ("women", "woman"),
    ("better", "good"), ("best", "good"), ("worse", "bad"), ("worst", "bad"),
    ("went", "go"), ("gone", "go"), ("said", "say"), ("says", "say"), ("made", "make"),
    ("took", "take"), ("taken", "take"), ("saw", "see"), ("seen", "see"), ("knew", "know"),
    ("known", "know"), ("thought", "think"), ("told", "tell"), ("came", "come"),
    ("got", "get"), ("lies", "lie"), ("votes", "vote"), ("posts", "post"),
)

#: Retweet marker, mention and link placeholders written by the masking functions.
MENTION_PLACEHOLDER = "@USER"
URL_PLACEHOLDER = "URL"

#: Code points shown as an emoji (class body, usable in Java and RE2 patterns).
EMOJI_RANGES = (
    r"\x{203C}\x{2049}\x{2139}\x{2194}-\x{21AA}\x{231A}\x{231B}\x{23E9}-\x{23FA}"
    r"\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}"
    r"\x{3297}\x{3299}\x{1F004}\x{1F0CF}\x{1F170}-\x{1F251}\x{1F300}-\x{1FAFF}"
)

#: Thresholds of the pipeline.
MIN_TOKENS = 2
PHRASE_MIN_COUNT = 20
PHRASE_THRESHOLD = 10.0
DICTIONARY_MIN_DOCS = 20
DICTIONARY_MAX_SHARE = 0.5
DICTIONARY_KEEP = 100_000
LDA_TOPICS = 20
SPLIT_SEED = 18
TRAIN_SHARE = 0.70
TEST_SHARE_OF_REST = 0.32
SVM_C = 0.1
SVM_MAX_ITER = 50_000
FOREST_TREES = 100
TOP_TERMS = 200
TOP_FEATURES = 20
WORDCLOUD_TERMS = 50

#: Style features by level, in report order.
#: Exponent of Brunet's W.
BRUNET_EXPONENT = 0.172

FEATURES_BY_LEVEL = {
    "character_level": (
        "char_punc_freq", "digit_freq", "whitespace_freq", "linebreak_freq",
        "uppercased_char_freq", "special_char_freq", "repeated_questionmark",
        "repeated_periods", "repeated_exclamation", "contains_equals",
    ),
    "word_level": (
        "total_word_len", "avg_word_len", "avg_sentence_len_words",
        "avg_sentence_len_chars", "uppercased_words", "short_words", "elongated_words",
        "numberlike_tokens", "past_tense_words", "present_tense_words",
        "positive_adjectives", "comp_and_sup_adjectives", "emotes",
        "nonstandard_spelling", "quoted_words", "type_token_ratio", "hapax_legomena",
        "hapax_dislegomena", "syllable_freqs", "readability_flesch_kincaid",
    ),
    "sentence_level": ("stopword_freq", "syn_punc_freq", "root_freq", "pos_ngrams"),
    "document_level": ("n_sents", "n_mentions"),
}
