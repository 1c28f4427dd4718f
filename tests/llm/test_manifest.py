"""The Merkle manifest against a tree built by plain recursion."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from matchlake.llm import manifest
from matchlake.llm import queries as Q

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, pos int, hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    """The top of the nodes, and for each its runs from below: (digests, own place)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        for leaf, place in enumerate(at):
            paths[leaf].append((runs[place // arity], place % arity))
        nodes, at = [sha("".join(r)) for r in runs], [p // arity for p in at]
    return nodes[0], paths


def expected(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof digest, folded root of the tampered leaf) by row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    tops, made = [], []
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        top, paths = tree([leaf_of(r) for r in own], arity)
        tops.append(top)
        made.append(list(zip(own, paths, strict=True)))
    root, over = tree(tops, arity) if tops else (None, [])
    out = []
    for top, path, own in zip(tops, over, made, strict=True):
        for r, lower in own:
            tampered = (*r[:3], None if r[3] is None else r[3] + (zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0), r[4])
            h, steps = leaf_of(tampered), lower + path
            for run, place in steps:
                h = sha("".join(run[:place]) + h + "".join(run[place + 1:]))
            proof = sha("".join(x for run, place in steps for i, x in enumerate(run) if i != place))
            out.append((r[0], leaf_of(r), top, root, proof, h, h == root))
    return sorted(map(str, out))


def found(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "g", 1, "h") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(str(tuple(r)) for r in Q.op12_proof_push(spark, str(tmp_path)).collect())


def some_rows(sizes, seed=1):
    rng = random.Random(seed)
    return [(i + 1000 * n, rng.choice(["a", None, "ü"]), lang, rng.choice([None, 3, 40]), rng.choice(["", None, "text", "漢字 1:2", "x" * 5000]) if i % 3 else f"t{i}")
            for n, (lang, size) in enumerate(sizes.items()) for i in range(size)]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2}, {"en": 3}, {"en": 1, None: 1}, {"en": 5, "de": 1, None: 2, "": 3}, {"en": 64, "de": 65, "": 63, "é": 129, None: 7}, {"en": 300}, {"z": 4097, "a": 1}],
                         ids=lambda s: "-".join(map(str, s.values())))
def test_against_a_plain_tree(spark, tmp_path, sizes):
    rows = some_rows(sizes)
    random.Random(2).shuffle(rows)
    assert found(spark, rows, tmp_path) == expected(rows)


def test_null_and_repeated_keys(spark, tmp_path):
    rows = some_rows({"en": 70, None: 9})
    rows += rows[:20] + rows[:3] + [(None, "s", "en", 1, "x"), (None, "s", "en", 1, "x"), (None, None, None, None, None), (rows[0][0], "other", rows[0][2], 5, "of the same key")]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_a_third_of_all_rows_alike(spark, tmp_path):
    rows = some_rows({"en": 400, "de": 50}) + [(77, "s", "en", 4, "copy")] * 220
    assert found(spark, rows, tmp_path) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


@pytest.mark.parametrize("arity", [3, 5, 100])
def test_other_arities_and_columns(spark, arity):
    rows = some_rows({"en": 250, "de": 11, None: 1, "fr": 2})
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = manifest.merkle_manifest(df, arity=arity).withColumn("back", manifest.folded(F.col("claimed"), F.col("proof"))).collect()
    wanted = expected(rows, arity)
    (root,) = {r["root"] for r in out}
    assert all(f"'{root}'" in w for w in wanted) and all(r["back"] == root and r["claimed"] == r["leaf"] for r in out)
    hashed = sorted(str((r["doc_id"], r["leaf"], r["subroot"], r["root"], sha("".join(r["proof"]).replace(":", "")))) for r in out)
    assert hashed == sorted(str(tuple(eval(w)[:5])) for w in wanted)  # noqa: S307


def test_any_change_is_seen(spark):
    rows = some_rows({"en": 30, "de": 3})
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    kept = manifest.merkle_manifest(df).select(F.col("doc_id").alias("id"), "root", "proof")
    for column, change in (("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!"))), ("lang", F.lit("xx")), ("source", F.lit("new")), ("doc_id", F.col("doc_id") + 1)):
        changed = df.withColumn("id", F.col("doc_id")).withColumn(column, change).join(kept, "id")
        leaf = manifest.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
        assert changed.where(manifest.folded(leaf, F.col("proof")) == F.col("root")).count() == 0, column


def test_block_paths_of_all_small_sizes():
    for n, arity in itertools.product(range(1, 20), (2, 3, 4)):
        nodes = [sha(str(i)) for i in range(n)]
        top, paths = manifest.block_paths(nodes, manifest._levels_of(n, arity), arity)
        wanted, runs = tree(nodes, arity)
        assert top == wanted
        assert paths == [["".join(r[:p]) + ":" + "".join(r[p + 1:]) for r, p in own] for own in runs]
