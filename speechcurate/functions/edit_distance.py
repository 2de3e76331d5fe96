"""Word and character error rates from built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One code point per distinct word, from the first one above the surrogates; there is room for a million.
FIRST_CODE = 0xE000
MAX_WORDS = 0x110000 - FIRST_CODE


def words(text: Column) -> Column:
    """Words of a text; runs of white space separate, ends are trimmed."""
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(tidy == "", F.array().cast("array<string>")).otherwise(F.split(tidy, " "))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _spell(tokens: Column, vocabulary: Column) -> Column:
    """A string with one character per word."""
    def letter(word: Column) -> Column:
        code = F.lit(FIRST_CODE - 1) + F.array_position(vocabulary, word)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    return F.array_join(F.transform(tokens, letter), "")


def _word_distance(ref: Column, hyp: Column) -> Column:
    too_many = F.raise_error(F.lit(f"more than {MAX_WORDS} distinct words in one pair")).cast("int")
    return _once(
        F.array_distinct(F.concat(ref, hyp)),
        lambda v: F.when(F.size(v) > MAX_WORDS, too_many).otherwise(F.levenshtein(_spell(ref, v), _spell(hyp, v))),
    )


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Least number of word insertions, deletions and substitutions."""
    pair = F.struct(words(reference).alias("ref"), words(hypothesis).alias("hyp"))
    return _once(pair, lambda p: _word_distance(p["ref"], p["hyp"]))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate; null when the reference has no words."""
    pair = F.struct(words(reference).alias("ref"), words(hypothesis).alias("hyp"))
    return _once(pair, lambda p: _word_distance(p["ref"], p["hyp"]) / F.nullif(F.size(p["ref"]), F.lit(0)))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate; null when the reference is empty."""
    return F.levenshtein(reference, hypothesis) / F.nullif(F.length(reference), F.lit(0))
