"""Column expressions on paths and transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that become a space, an apostrophe or an ASCII letter.
TO_SPACE = "`[]()-"
TO_LETTER = {"â": "'", "á": "a", "ë": "e", "é": "e", "ñ": "n", "ú": "u", "ō": "o", "ó": "o"}
TYPOGRAPHIC_APOSTROPHE = "’"
# Fixed value: the one phrase in which the wrongly encoded character is a letter.
MUSTARD = ("mustard â", "mustard a")

VARIANTS = ("sampler", "creator")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_transcript(sentence: str | Column, variant: str = "sampler") -> Column:
    """Replace punctuation and accented letters; spaces and case stay as they are."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    text = _col(sentence)
    source, target = TO_SPACE + "".join(TO_LETTER), " " * len(TO_SPACE) + "".join(TO_LETTER.values())
    if variant == "creator":
        text = F.replace(text, F.lit(MUSTARD[0]), F.lit(MUSTARD[1]))
        source, target = source + TYPOGRAPHIC_APOSTROPHE, target + "'"
    return F.replace(F.translate(text, source, target), F.lit("&"), F.lit(" and "))


def split_of(path: str | Column) -> Column:
    """Second component of a path, null when there is none."""
    return F.get(F.split(_col(path), "/"), F.lit(1))


def basename(path: str | Column) -> Column:
    return F.substring_index(_col(path), "/", -1)


def swap_extension(path: str | Column, extension: str) -> Column:
    """Cut at the first dot of the whole path and append ``extension``."""
    return F.concat(F.substring_index(_col(path), ".", 1), F.lit(extension))


def append_extension(path: str | Column, extension: str = ".mp3") -> Column:
    return F.concat(_col(path), F.lit(extension))


def derived_name(path: str | Column, suffix: str) -> Column:
    """``x.tsv`` with suffix ``_output`` gives ``x_output.tsv``; an error unless there is exactly one dot."""
    parts = F.split(_col(path), r"\.")
    name = F.concat(parts[0], F.lit(f"{suffix}."), F.get(parts, F.lit(1)))
    error = F.raise_error(F.concat(F.lit("not one dot in "), _col(path))).cast("string")
    return F.when(F.size(parts) != 2, error).otherwise(name)


def change_basename(path: str | Column, new: str | Column) -> Column:
    """New base name; folder and last extension stay. Leading dots start no extension."""
    p = _col(path)
    folder = F.regexp_extract(p, r"^(?s)(.*/)?[^/]*$", 1)
    extension = F.regexp_extract(basename(p), r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.concat(folder, _col(new), extension)


def corpus_of(filename: str | Column, first: str = "librispeech", second: str = "common_voice") -> Column:
    """Tell two corpora apart by the length of the file name."""
    # Fixed value: names shorter than 30 characters belong to the first corpus.
    return F.when(F.length(_col(filename)) < 30, F.lit(first)).otherwise(F.lit(second))


def prefix_path(path: str | Column, *parts: str) -> Column:
    """Put folder names in front of a path, null stays null."""
    return F.concat(F.lit("/".join(parts) + "/"), _col(path))


def sample_digest(key: str | Column, seed: int | str = 42) -> Column:
    """Hex digest that orders rows at random, whatever their partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")).cast("binary"))
