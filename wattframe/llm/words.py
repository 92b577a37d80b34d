"""Words, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged (`lower` also changes letters beyond ASCII)."""
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def count_blank_words(text: Column) -> Column:
    """The number of words between blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_BLANK)), F.lit(0)).cast("bigint")


def letter_words(text: Column) -> Column:
    """The array of words of digits, a-z (A-Z lowered) and characters beyond ASCII; empty for null."""
    words = F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")
    return F.coalesce(words, F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where a lambda inside uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
