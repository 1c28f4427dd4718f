"""Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over the groups, and each row's proof.

Bottom up, the nodes of a group are numbered by range partitions and dealt to blocks of consecutive nodes; a block gives
the node some levels above and, for each of its members, the siblings met on the way. Each such level is a written
table. Top down, a level's blocks are joined to their parents, and each member puts its own siblings before the proof
that its parent has. A block has at most BLOCK members, whatever the size of a group, and a proof has as many steps as
the trees have levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import written

BLOCK = 64  # nodes of a block at most, unless the arity is larger
BROADCAST_ROWS = 20_000  # of a few numbers, or of a proof's digests


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """sha256 of the values one after the other, each as its number of UTF-8 bytes, a colon and itself; a null as a dash."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c), F.lit(":"), c)) for c in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(F.get(F.split(step, ":"), F.lit(0)), h, F.get(F.split(step, ":"), F.lit(1))), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of a proof's digests, in their order."""
    return F.sha2(F.replace(F.array_join(proof, ""), F.lit(":"), F.lit("")), 256)


def _levels_of(n: int, arity: int) -> int:
    """How often runs of n nodes become one node until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def block_paths(hashes: list[str], levels: int, arity: int) -> tuple[str, list[list[str]]]:
    """The node so many levels above a block's nodes, and for each node its steps `left:right`, the digests beside it in its run."""
    paths: list[list[str]] = [[] for _ in hashes]
    nodes, below = list(hashes), [[i] for i in range(len(hashes))]
    for _ in range(levels):
        starts = range(0, len(nodes), arity)
        for s in starts:
            run = nodes[s:s + arity]
            for i, members in enumerate(below[s:s + arity]):
                step = "".join(run[:i]) + ":" + "".join(run[i + 1:])
                for m in members:
                    paths[m].append(step)
        nodes, below = [digest("".join(nodes[s:s + arity])) for s in starts], [sum(below[s:s + arity], []) for s in starts]
    return nodes[0], paths


def _few(df: DataFrame) -> DataFrame:
    """df, a written table, for a join: broadcast only where its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with pos, from 0 by `order` in each group g, and n, the group's rows; and the largest n. df is a written table."""
    by = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("id"))
    rows = written(ranged, "merkle-ranged").withColumn("part", F.shiftright("id", 33))
    parts = rows.groupBy("g", "part").agg(F.min("id").alias("first"), F.count("*").alias("n_part"))
    of_group = Window.partitionBy("g")
    before = F.sum("n_part").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n_part").over(of_group).alias("n")), "merkle-parts")
    most = parts.agg(F.max("n")).first()[0] or 0
    return rows.join(_few(parts), ["g", "part"]).withColumn("pos", F.col("id") + F.col("shift")).drop("id", "part", "shift"), most


def _grown(nodes: DataFrame, most: int, arity: int, carried: list[str]) -> list[DataFrame]:
    """The written levels of blocks over nodes (g, pos, n, hash): g, block, n, top, and members of pos, path and what is carried."""
    span = max(1, next(k for k in range(64) if arity ** (k + 1) > BLOCK))
    size, levels = arity ** span, []

    def run(hashes: pd.Series, n: pd.Series) -> pd.DataFrame:
        made = [block_paths(list(h), span if k > size else _levels_of(int(k), arity), arity) for h, k in zip(hashes, n, strict=True)]
        return pd.DataFrame({"top": [top for top, _ in made], "paths": [[np.array(p, dtype=object) for p in paths] for _, paths in made]})

    while True:
        blocks = (nodes.groupBy("g", F.expr(f"pos div {size}").alias("block"), "n")
                  .agg(F.sort_array(F.collect_list(F.struct("pos", "hash", *carried))).alias("its")))
        made = F.pandas_udf(run, "top string, paths array<array<string>>")(F.transform("its", lambda x: x["hash"]), F.col("n"))
        blocks = blocks.withColumn("made", made)
        members = F.transform("its", lambda x, i: F.struct(x["pos"].alias("pos"), F.get("made.paths", i).alias("path"), x["hash"].alias("hash"), *[x[c].alias(c) for c in carried]))
        levels.append(written(blocks.select("g", "block", "n", F.col("made.top").alias("top"), members.alias("members")), "merkle-level"))
        most = -(-most // size)
        if most <= 1:
            return levels
        nodes, carried = levels[-1].select("g", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("hash")), []


def _pushed(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The members of the lowest level with their whole proof; tops has g, proof and what else goes down to all members."""
    down = tops.withColumn("block", F.lit(0).cast("long"))
    extra = [c for c in tops.columns if c not in ("g", "proof")]
    for i, level in enumerate(reversed(levels)):
        if i:
            down = written(down.select("g", F.col("m.pos").alias("block"), "proof", *extra), "merkle-proofs")
        down = (level.select("g", "block", "members").join(_few(down), ["g", "block"])
                .select("g", "proof", *extra, F.explode("members").alias("m")).withColumn("proof", F.concat("m.path", "proof")))
    return down.select("g", "proof", *extra, "m.*")


def merkle_manifest(df: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", arity: int = 2,
                    claimed: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof and claimed of every row.

    The leaves of a group ascend by key; every `arity` consecutive nodes, fewer at the end, become the digest of theirs
    until one is left, the subroot. Subroots, ordered by group, become the root likewise. A proof lists, from the leaf
    to the root, the digests to the left and to the right of a node in its run, as `left:right`. `claimed` is a leaf
    digest that is to be checked against the manifest, the leaf itself where it is not given.

    - null keys and groups come first; a null value has a digest of its own. Rows of equal key ascend by leaf, then as
      they were read; equal rows have equal leaves, so the results of the table are the same in any order.
    - an empty table gives an empty result. Other columns are ignored.
    """
    leaf = leaf_digest(*map(F.col, columns))
    named = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = df.select(named.alias("g"), F.col(key).alias("key"), leaf.alias("hash"), (leaf if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("row"))
    nodes, most = _numbered(written(leaves, "merkle-leaves"), ["key", "hash", "row"])
    if not most:
        return leaves.select(F.col("key").alias(key), F.col("hash").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast("array<string>").alias("proof"), "claimed").where("false")
    levels = _grown(nodes.drop("row"), most, arity, ["key", "claimed"])
    subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("hash"))
    nodes, most = _numbered(subroots, ["name"])
    over = _grown(nodes, most, arity, ["name"])
    root = over[-1].select("g", F.array().cast("array<string>").alias("proof"), F.col("top").alias("root"))
    tops = written(_pushed(over, root).select(F.col("name").alias("g"), "proof", F.col("hash").alias("subroot"), "root"), "merkle-subroots")
    return _pushed(levels, tops).select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "proof", "claimed")
