"""Regular expressions (``java.util.regex`` syntax) shared by the text functions.

Letters, digits and white space are always spelled as explicit Unicode classes,
so a pattern means the same whatever flags the engine defaults to.  Repeated
groups are possessive (``*+``): the JVM runs those in a loop, while a greedy
repeated group recurses once per repetition and overflows the stack on junk
text such as a hundred thousand apostrophes.
"""

from __future__ import annotations

from quillspark.functions import constants as C

WORD_CHAR = r"[\p{L}\p{N}_]"
SPACE_BODY = r" \t\n\r\f\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{SPACE_BODY}]"
#: The characters of that class.
SPACE_CHARS = " \t\n\r\f\x0b\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NON_SPACE = f"[^{SPACE_BODY}]"

MENTION = f"@{WORD_CHAR}+"
HASHTAG = f"#{WORD_CHAR}+"
URL = rf"(?:https?://|www\.){NON_SPACE}+"
#: The same for this engine, with a look at the first character, which settles most positions of a text.
URL_GUARDED = f"(?=[hw]){URL}"
RETWEET = r"\bRT\b"
FLOOD = r"([^\n])\1{3,}"
ELONGATED = r"([^\n])\1{2,}"

EMOJI_CHAR = f"[{C.EMOJI_RANGES}]"
EMOJI = (
    r"(?:[\x{1F1E6}-\x{1F1FF}]{2}|" + EMOJI_CHAR
    + r"(?:[\x{FE0F}\x{1F3FB}-\x{1F3FF}]|\x{200D}" + EMOJI_CHAR + r")*+)"
)
#: The same with a look at the next character first, which settles most positions of a text.
EMOJI_GUARDED = r"(?=[\x{203C}-\x{1FAFF}])" + EMOJI
#: The first character of that range: a token that is smaller begins with no emoji.
FIRST_EMOJI = "\u203c"


def literal(text: str) -> str:
    """Escape ``text`` so that it matches itself."""
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch for ch in text)


def alternation(literals) -> str:
    """Alternation of literals, longest first so no literal hides a longer one."""
    ordered = sorted(set(literals), key=lambda s: (-len(s), s))
    return "|".join(literal(s) for s in ordered)


def guarded_alternation(literals) -> str:
    """``alternation`` behind a look at the first character."""
    literals = list(literals)
    firsts = "".join(literal(ch) if ch not in "-^" else "\\" + ch for ch in sorted({s[0] for s in literals}))
    return f"(?=[{firsts}])(?:{alternation(literals)})"


EMOTICON = "(?:" + alternation(C.EMOTICONS) + ")"
#: Emoticons made of letters only are found as words and compared as a whole.
_WORD_START_EMOTICON = alternation(e for e in C.EMOTICONS if e[0].isalnum() and not e.isalpha())
_SYMBOL_EMOTICON = alternation(e for e in C.EMOTICONS if not e[0].isalnum())

#: url | emoticon | word with inner apostrophes | emoji | #tag | @mention | other.
#: Words come before what cannot start with a word character: most positions are words.
SOCIAL_TOKEN = "|".join((
    URL, _WORD_START_EMOTICON, f"{WORD_CHAR}+(?:['’]{WORD_CHAR}+)*+", HASHTAG, MENTION, f"(?:{_SYMBOL_EMOTICON})",
    EMOJI, NON_SPACE,
))

#: The same tokens for this engine: emoticons and emojis behind a look at their first character, which settles most marks and every space.
SOCIAL_TOKEN_FAST = "|".join((
    URL_GUARDED, guarded_alternation(e for e in C.EMOTICONS if e[0].isalnum() and not e.isalpha()),
    f"{WORD_CHAR}+(?:['’]{WORD_CHAR}+)*+", HASHTAG, MENTION, guarded_alternation(e for e in C.EMOTICONS if not e[0].isalnum()),
    EMOJI_GUARDED, NON_SPACE,
))

#: #tag | word with inner hyphens | other
NORM_TOKEN = "|".join((HASHTAG, f"{WORD_CHAR}+(?:-{WORD_CHAR}+)*+", NON_SPACE))

#: Plain word tokens: maximal runs of word characters.
PLAIN_WORD = f"{WORD_CHAR}+"
#: Word tokens of the n-gram vectoriser: two characters or more.
LONG_WORD = f"{WORD_CHAR}{{2,}}"

SENTENCE_END = rf"([.!?]+){SPACE}+"
LINE_BREAKS = r"[\n\r]+"

ASCII_PUNCT = r"[!-/:-@\[-`{-~]"
DIGIT = r"\p{Nd}"
LINEBREAK = r"[\r\n\f]"
ASCII_UPPER = r"[A-Z]"
SPECIAL_CHAR = f"[^a-z .,!?':;{SPACE_BODY}]"
#: The same; the rarer kinds of space are looked at only where the plain class matches.
SPECIAL_CHAR_FAST = r"[^a-z .,!?':;\t\n\r\f\x0B](?<!" + SPACE + ")"
REPEATED_QUESTION = r"\?{2,}"
REPEATED_PERIOD = r"\.{2,}"
REPEATED_EXCLAMATION = r"!{2,}"

ALL_LETTERS = r"^\p{L}+$"
ALL_ALNUM = r"^[\p{L}\p{N}]+$"
ALL_PUNCT = r"^\p{P}+$"
ALL_SPACE = f"^{SPACE}+$"
NUMBER = r"^[+-]?\p{Nd}+(?:[.,/]\p{Nd}+)*+$"
#: A quoted span: double quotes, or single quotes that touch no word from outside.
QUOTED = rf"\".+?\"|(?<!{WORD_CHAR})'.+?'(?!{WORD_CHAR})"
VOWEL_GROUP = r"[aeiouy]+"
WORD_START = rf"^#?{WORD_CHAR}+"
USER_MENTION = "@user"
