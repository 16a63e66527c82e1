"""Column functions for sequence text: trimming, splitting, characters, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_line(line: Column) -> Column:
    """Without spaces, tabs and line ends around it; other white space stays."""
    return F.btrim(line, F.lit(" \t\r\n"))


def split_fields(line: Column) -> Column:
    """Fields between spaces; a tab is part of a field, empty fields are dropped."""
    return F.filter(F.split(line, " "), lambda x: x != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def characters(text: Column) -> Column:
    """Code points, an empty array for empty text."""
    return F.filter(F.split(text, ""), lambda x: x != "")


def corpus_words(cut: Column) -> Column:
    """Words of a segmented line, opening brackets in front of them taken off."""
    return F.filter(F.transform(F.split(cut, "(?U)\\s+"), lambda w: F.ltrim(w, F.lit("["))), lambda w: w != "")


#: All tags of characters in words.
TAGS = "BMES"


def bmes(word: Column) -> Column:
    """Tags of a word's characters as one string: S alone, else B, as many M as are inside, E."""
    n = F.char_length(word)
    return F.when(n == 1, "S").otherwise(F.concat(F.lit("B"), F.repeat(F.lit("M"), n - 2), F.lit("E")))


def tagged(words: Column) -> Column:
    """Tags of all words, one array element a character."""
    return characters(F.array_join(F.transform(words, bmes), ""))


def joined_by_tags(chars: Column, tags: Column) -> Column:
    """Text with a space after each E or S, without the last one."""
    return F.rtrim(F.array_join(F.zip_with(chars, tags, lambda c, t: F.when(t.isin("E", "S"), F.concat(c, F.lit(" "))).otherwise(c)), ""))


def hex_float(value: float) -> str:
    return value.hex()


def six_digits(value: float) -> str:
    """A number with six significant digits, as labelled output has it."""
    return f"{value:.6g}"
