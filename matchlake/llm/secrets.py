"""Secret scan with corpus-wide ownership frequency.

Patterns propose spans. The hash of each proposed value is counted over the whole corpus by distinct owners and distinct
repositories: a value that several owners hold, or one owner in many repositories, is a copied example; a value of one
owner in a few repositories looks live. Spans of the base patterns always stay; the wider candidates become spans only
where their value looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import written

# The base kinds in the order in which ties are listed.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of fewer characters fails whole, and no other match can start in it
_HEX = re.compile(r"[0-9a-f]{16,}")
# Wider candidates: vendor prefixes, signed tokens, private keys, and long mixed strings after a credential word.
_WIDE = {
    "vendor": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,}|sk[_-](?:live|test|ant)?[_-]?[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,})"),
    "signed": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    "pem": re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    "word": re.compile(r"(?ai:bearer|auth|credential|private_?key|access_?key|client_?id|pwd|signature)[\"']?+\x20*+[:=]?+\x20*+[\"']?+([A-Za-z0-9+/_.=-]{16,})"),
    "mixed": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"),
}
KINDS = (*BASE_KINDS, *_WIDE)
MIN_BITS = 3.0  # of entropy a character, for wider candidates
HEAVY = 10_000  # occurrences from which a value can be joined by broadcast
HEAVY_VALUES = 100_000  # at most so many of them, whatever the corpus


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base patterns, by start and then kind; failing matches are dropped, not retried."""
    found = [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], BASE_KINDS.index(x[0])))


def wide_matches(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Wider candidates that overlap no base span and no earlier candidate."""
    found: list[tuple[str, int, int, str]] = []
    # disjoint, ascending stretches that are taken; base spans of different kinds may overlap each other
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e, _ in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for kind, pattern in _WIDE.items():
        for m in pattern.finditer(text):
            value = m[m.lastindex or 0]
            mixed = kind == "pem" or (any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= MIN_BITS)
            at = bisect_right(ends, m.start())
            if mixed and (at == len(starts) or m.end() <= starts[at]):
                found.append((kind, *m.span(), value))
                starts.insert(at, m.start())
                ends.insert(at, m.end())
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def _extract(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        text = text or ""
        base = base_matches(text)
        listed = [{"start": s, "rank": KINDS.index(k), "kind": k, "end": e, "value": int.from_bytes(hashlib.sha256(v.encode("utf-8", "replace")).digest()[:8], "big", signed=True)}
                  for k, s, e, v in base + wide_matches(text, base)]
        out.append((listed, digest([f"{k}:{s}:{e}" for k, s, e, _ in base])))
    return pd.DataFrame(out, columns=["spans", "base_sha256"])


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """key, base_sha256 and spans of every row; a span has kind, start, end, base, owners, repositories, live.

    live: at most max_owners owners hold the value, in at most max_repositories repositories altogether.

    - null and empty texts have no spans. Null owners and repositories each count as one owner or repository of their own.
    - repository defaults to the row's key. A repeated row gets its own, equal result and is no further repository.
    - wider candidates that are not live are left out; base spans always stay, marked live or not.
    - an empty table gives an empty result; other columns are ignored.
    """
    holder = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    place = F.coalesce(F.col(repository or key).cast("string"), F.lit(""))
    extract = F.pandas_udf(_extract, "spans array<struct<start:long,rank:int,kind:string,end:long,value:long>>, base_sha256 string")
    found = df.select(F.col(key).alias("key"), holder.alias("owner"), place.alias("repo"), extract(F.col(text)).alias("found"))
    rows = written(found.select(F.monotonically_increasing_id().alias("row"), "key", "owner", "repo", "found.*"), "secret-candidates")
    each = rows.where(F.size("spans") > 0).select("row", "owner", "repo", F.explode("spans").alias("span")).withColumn("value", F.col("span.value"))
    # By (value, owner, repository), then (value, owner), then value: each step combines before it shuffles.
    owned = (each.groupBy("value", "owner", "repo").agg(F.count("*").alias("times"))
             .groupBy("value", "owner").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
             .groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.sum("times").alias("times")))
    owned = written(owned, "secret-owners")
    # A value that is everywhere would meet all its spans in one task: such values, few by their number, are broadcast.
    most = max(HEAVY, (owned.agg(F.sum("times")).first()[0] or 0) // HEAVY_VALUES)
    heavy = each.join(F.broadcast(owned.where(F.col("times") > most)), "value")
    light = each.join(F.broadcast(owned.where(F.col("times") > most).select("value")), "value", "left_anti").join(owned.where(F.col("times") <= most), "value")
    base = F.col("span.rank") < len(BASE_KINDS)
    judged = (heavy.unionByName(light).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).where(base | F.col("live"))
              .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
                  F.col("span.start").alias("start"), F.col("span.rank").alias("rank"), F.col("span.kind").alias("kind"), F.col("span.end").alias("end"),
                  base.alias("base"), "owners", "repositories", "live"))).alias("found")))
    empty = F.array().cast("array<struct<start:long,rank:int,kind:string,end:long,base:boolean,owners:long,repositories:long,live:boolean>>")
    return (rows.select("row", "key", "base_sha256").join(judged, "row", "left")
            .select(F.col("key").alias(key), "base_sha256", F.coalesce("found", empty).alias("spans")))
