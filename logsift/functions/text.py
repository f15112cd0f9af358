"""Cleaning, tokenising and parsing of log lines as Column expressions.

Nothing here is a UDF. The patterns spell out Unicode classes because Java's ``\\s``, ``\\w`` and
``\\d`` are ASCII-only. Each pattern starts with a cheap test of one character, and possessive
repeats with a look-behind keep the cost of a very long token linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes and patterns below define the cleaning rules.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[!-~[^\s\x0b\x1c-\x1f\x85\p{Z}]]"
WORD = r"[A-Za-z0-9_\p{L}\p{N}]"
FREE_COLON = rf":(?:(?={WS})|(?<={WS}:))"
DOTTED_NUMBER = r"\p{Nd}(?<!\p{Nd}{2})\p{Nd}*+(?:\.\p{Nd}++)++"
CLOCK = r"\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}"
MONTHS = r"(?=[ADFJMNOS])(?:Mar|Apr|Dec|Jan|Feb|Nov|Oct|May|Jun|Jul|Aug|Sep)"
WORD_PREFIX = rf"(?::|(?<!{WORD}))(?:{WORD}++:)++"
PUNCTUATION = r"[.()<>/\-=\[\]]"
LETTER_TOKEN = rf"(?<!{NOT_WS})[A-Za-z()]++(?!{NOT_WS})"

# Layout of a BlueGene/L line. (?d) makes "." stop at newline only.
BGL_BODY = r"(?d)(?:-.{1,3}){2} (.+)$"
BGL_HEX_DUMP = r"(?d)x'.+'"
BGL_SEVERITY = rf"(?<!{WORD})({WORD}++){WS}++(INFO|WARN|ERROR|FATAL)"
BGL_RECORD_ID = r"^\p{Nd}"
BGL_MIN_BODY = 20

# More words than a row can hold, so a slice of this length reaches the end of the array.
MAX_WORDS = 1 << 30


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A plain column expression used inside a higher-order function would be evaluated again for
    every array element.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.regexp_replace(text, rf"^{WS}++|(?<!{WS}){WS}++$", "")


def tokens(text: Column) -> Column:
    """Whitespace tokens; no empty ones."""
    return F.regexp_extract_all(text, F.lit(rf"{NOT_WS}++"), F.lit(0))


def clean_tokens(text: Column) -> Column:
    """The letter-only tokens left after the variable parameters are deleted.

    The six deletions run in this order: free colons, dotted numbers, clock times, month names,
    ``word:`` prefixes, then punctuation becomes a space.
    """
    for pattern in (FREE_COLON, DOTTED_NUMBER, CLOCK, MONTHS):
        text = F.regexp_replace(text, pattern, "")
    text = bind(
        text,
        lambda t: F.when(F.contains(t, F.lit(":")), F.regexp_replace(t, WORD_PREFIX, ""))
        .otherwise(t),
    )
    text = F.regexp_replace(text, PUNCTUATION, " ")
    return F.regexp_extract_all(text, F.lit(LETTER_TOKEN), F.lit(0))


def clean_parameters(text: Column) -> Column:
    """The cleaned message, single-spaced; empty when no token survives."""
    return F.array_join(clean_tokens(text), " ")


def join_from(words: Column, first: int) -> Column:
    """Join ``words`` from 1-based position ``first`` with single spaces."""
    return F.array_join(F.slice(words, first, MAX_WORDS), " ")


def drop_first_token(line: Column) -> Column:
    """The line without its first whitespace token, single-spaced."""
    return join_from(tokens(line), 2)


def ngrams(words: Column, n: int) -> Column:
    """Sliding word n-grams; a non-empty line shorter than ``n`` is one gram."""

    def grams(w: Column) -> Column:
        sliding = F.transform(
            F.sequence(F.lit(1), F.size(w) - F.lit(n - 1)),
            lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "),
        )
        whole = F.array(F.array_join(w, " "))
        none = F.array().cast("array<string>")
        return F.when(F.size(w) == 0, none).when(F.size(w) < n, whole).otherwise(sliding)

    return bind(words, grams)


def bgl_body(line: Column) -> Column:
    """Message part of a stripped BlueGene/L line; empty when the separator is missing."""
    body = strip(F.regexp_extract(line, BGL_BODY, 1))
    body = strip(F.substring_index(body, "   ", -1))
    return strip(F.element_at(F.split(body, BGL_HEX_DUMP), -1))


def bgl_severity(line: Column) -> Column:
    return F.regexp_extract(line, BGL_SEVERITY, 2)


def bgl_component(line: Column) -> Column:
    """The word in front of the severity."""
    return F.regexp_extract(line, BGL_SEVERITY, 1)


def bgl_has_record_id(line: Column) -> Column:
    return line.rlike(BGL_RECORD_ID)
