"""Tokens, languages, stems and small string functions.

Everything here is row-local: it adds no shuffle and keeps the work next to
the scan, which for 10^13 words is far cheaper than joining each word to a
stop list or a stem table.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

# Unicode word characters and blanks, spelt out: Java's \w and \s are ASCII only.
_WORD = r"\p{L}\p{N}_"
_BLANK = r"\s\p{Z}\x0b\x1c-\x1f\x85"
TOKEN_PATTERN = f"([{_WORD}]+|[^{_WORD}{_BLANK}]+)"
CHUNK_PATTERN = f"([^{_BLANK}]+)"

# Letters that lose an accent, by canonical decomposition (Latin-1 and Latin Extended-A).
_ACCENTED = [
    (chr(c), unicodedata.normalize("NFD", chr(c))[0])
    for c in range(0x00C0, 0x0180)
    if unicodedata.normalize("NFD", chr(c))[0] != chr(c)
]
_LIGATURES = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"),
              ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"))


def tokens(text: Column) -> Column:
    """Runs of word characters, or runs of marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))


def chunks(text: Column) -> Column:
    """Pieces between blanks."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CHUNK_PATTERN))


def space_marks(text: Column) -> Column:
    """Blanks around ``. , ( ) ' ’ ? ! :``."""
    return F.regexp_replace(text, r"([.,()'’?!:])", " $1 ")


def spaced_tokens(text: Column) -> Column:
    """Treebank-like tokens: marks set apart, then cut at blanks."""
    return chunks(F.regexp_replace(space_marks(text), r'([;@#$%&"\[\]{}<>])', " $1 "))


def fold(token: Column) -> Column:
    """Letters and digits only, no accents, lower case."""
    plain = F.regexp_replace(token, r"[^\p{L}\p{N}]", "")
    plain = F.translate(plain, "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED))
    plain = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), _LIGATURES, plain)
    # Most words are what they fold to, but for their case.
    return F.when(token.rlike("^[a-z0-9]+$"), token).when(
        token.rlike("^[A-Za-z0-9]+$"), F.lower(token)).otherwise(F.lower(plain))


def sanitise_paragraph(text: Column, markers) -> Column:
    """Empty when a marker string occurs, else without the two characters ``\\r``."""
    hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])
    return F.when(hit, F.lit("")).otherwise(F.replace(text, F.lit("\\r"), F.lit("")))


def strip_patterns(title: Column, patterns: Column) -> Column:
    """Remove each pattern of the array in order."""
    none = F.array().cast("array<string>")
    return F.aggregate(F.coalesce(patterns, none), title,
                       lambda t, p: F.regexp_replace(t, p, F.lit("")))


def _in(value: str, words) -> str:
    listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return f"{value} IN ({listed})"


def _hits(words: str, language: str) -> str:
    listed = _in("t", lexicon.base_words(language))
    return f"cast(size(filter({words}, t -> {listed})) as bigint)"


def language_scores(words: str, languages=lexicon.LANGUAGES) -> dict[str, Column]:
    """Per language, how many tokens of the (distinct, lower-case) array are in its stop list."""
    return {n: F.expr(_hits(words, n)) for n in languages}


def _content(word: str, language: str) -> str:
    return (f"CASE WHEN {language} = 'french' THEN NOT {_in(word, lexicon.stop_words('french'))} "
            f"WHEN {language} = 'english' THEN NOT {_in(word, lexicon.stop_words('english'))} "
            f"ELSE NOT {_in(word, lexicon.stop_words(None))} END")


def is_content(word: str, language: str) -> Column:
    """True when the (lower-case) word is not a stop word of the language; SQL names."""
    return F.expr(_content(word, language))


def content_word(word: Column, language: Column, also: tuple[str, ...] = ()) -> Column:
    """The same for columns; the words of ``also`` are left out, too."""
    listed = lambda of: list(lexicon.stop_words(of)) + list(also)
    return F.when(language == "french", ~word.isin(listed("french"))).when(
        language == "english", ~word.isin(listed("english"))).otherwise(~word.isin(listed(None)))


def is_free(word: str) -> Column:
    """True when the word is on no stop list of French, English, marks or measures."""
    return F.expr(f"NOT {_in(word, lexicon.stop_words(None))}")
