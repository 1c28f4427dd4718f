"""Fill-in-middle transformation: a text's code points are cut at two ranks, and its parts are put in another order.

The units are the isolated matches of a regular expression in the Split pre-tokenizer of the tokenizers library, which
needs no training and gives the matches' offsets in code points. They are matched in two grains, as an array with a
place for each code point of a long text is large: blocks of BLOCK code points, then single ones in the last block, for
their number, and in the blocks that a cut falls into, for its place.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
# The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


@lru_cache(maxsize=8)
def _splitter(units: int):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(rf"[\s\S]{{1,{units}}}"), "isolated")


def offsets(text: str, units: int = 1) -> list[tuple[int, int]]:
    """(start, end) of the runs of so many code points of a text, from left to right; the last may be shorter."""
    return [at for _, at in _splitter(units).pre_tokenize_str(text)]


class Units:
    """The single code points of a text by rank."""

    def __init__(self, text: str):
        self.text, self.blocks = text, offsets(text, BLOCK)
        self.n = BLOCK * (len(self.blocks) - 1) + len(offsets(text[slice(*self.blocks[-1])])) if self.blocks else 0

    def start(self, rank: int) -> int:
        """Where the unit of a rank begins; for rank n, where the text ends."""
        block, nth = divmod(rank, BLOCK)
        if block >= len(self.blocks):
            return len(self.text)
        first, end = self.blocks[block]
        singles = offsets(self.text[first:end])
        return first + (singles[nth][0] if nth < len(singles) else end - first)


def transformed(text: str, h1: int, h2: int, h3: int, h4: int, plain_percent: int, spm_percent: int) -> tuple[int, str, str, int | None, int | None]:
    """(n, form, output, prefix_chars, middle_chars) of one text, decided by four numbers."""
    units = Units(text)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 100 - plain_percent:
        return units.n, "plain", text, None, None
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.start(low), units.start(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return units.n, "spm", f"{MARKS[1]}{suffix}{MARKS[0]}{prefix}{MARKS[2]}{middle}", a, b - a
    return units.n, "psm", f"{MARKS[0]}{prefix}{MARKS[1]}{suffix}{MARKS[2]}{middle}", a, b - a


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """key, n, form, output, prefix_chars and middle_chars of every row.

    n counts the text's code points. Where to cut, and the form, follow from the sha256 of `seed:key` alone. Texts that
    hold a mark stay plain, so that `restored` is exact for all.

    - null texts are empty: n 0, form plain, an empty output. A null key counts as ''.
    - equal rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]

    def run(texts: pd.Series, *hashes: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([transformed(t, *h, plain_percent, spm_percent) for t, *h in zip(texts, *hashes, strict=True)], columns=["n", "form", "output", "prefix_chars", "middle_chars"], dtype=object)
        return found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    kind = "n long, form string, output string, prefix_chars long, middle_chars long"
    made = df.select(F.col(key).alias("key"), F.pandas_udf(run, kind)(F.coalesce(F.col(text), F.lit("")), *numbers).alias("made"))
    return made.select(F.col("key").alias(key), "made.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. No part of a text holds a mark, so each mark is found where it was put."""
    p, s, m = map(F.lit, MARKS)
    head, middle = F.substring_index(output, MARKS[2], 1), F.substring_index(output, MARKS[2], -1)
    first = F.substring_index(head, MARKS[1], 1), F.substring_index(head, MARKS[1], -1)
    other = F.substring_index(head, MARKS[0], 1), F.substring_index(head, MARKS[0], -1)
    return (F.when(form == "psm", F.concat(F.substr(first[0], F.length(p) + 1), middle, first[1]))
            .when(form == "spm", F.concat(other[1], middle, F.substr(other[0], F.length(s) + 1))).otherwise(output))
