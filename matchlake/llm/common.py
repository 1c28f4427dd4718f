"""Helpers the corpus operators share: tables written to the shared folder, word patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.scratch import shared_dir, written

#: The white space that separates words, as characters and as a regular expression.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["SPACE", "SPACE_CHARS", "in_fold", "shared_dir", "words_of", "written"]


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than white space; an empty array for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def in_fold(key: Column, parts: int, rest: int) -> Column:
    """crc32 of the key as text, modulo parts, is rest; a null key counts as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(parts) == F.lit(rest)
