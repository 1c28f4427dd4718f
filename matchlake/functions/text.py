"""Name folding, edit distances and clock texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Characters that text recognition confuses.
CONFUSED, CANONICAL = "soilbz", "501182"


def name_key(name: Column) -> Column:
    """Lower case, without Latin accents, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), r"\s+", " "))


def player_identity(name: Column) -> Column:
    return F.translate(name_key(name), CONFUSED, CANONICAL)


def ocr_normal(name: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def similar(a: Column, b: Column) -> Column:
    """At most one edit between the shorter's length of beginnings (six letters or more), or a fifth of the longer in edits."""
    short = F.least(F.length(a), F.length(b))
    long = F.greatest(F.length(a), F.length(b))
    prefix = (short >= 6) & (F.levenshtein(F.left(a, short), F.left(b, short)) <= 1)
    return prefix | (F.levenshtein(a, b) <= F.greatest(F.lit(1), F.bround(long * 0.2).cast("int")))


def clock(seconds: Column) -> Column:
    """Whole seconds as m:ss."""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def parse_clock(value: Column) -> Column:
    """Seconds of 'h:mm:ss', 'm:ss' or '83,5'; null if it is none of them."""
    plain = F.replace(F.trim(value), F.lit(","), F.lit("."))
    parts = F.split(plain, ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + F.coalesce(F.try_to_number(p, F.lit("999999.999")).cast("double"), F.lit(0.0)))
    return F.when(plain.rlike(r"^[0-9]{1,6}(:[0-9]{1,2}){0,2}(\.[0-9]{1,3})?$"), total)
