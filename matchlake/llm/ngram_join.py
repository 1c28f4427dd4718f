"""Exact Jaccard join of word n-gram sets by set-relation skipping.

An inverted index over the prefixes of all sets, rarest shingles first, lists for each shingle the sets that hold it and
at which position. Lists with the same members are read once. A list is read in the order of positions, and what the
positions alone rule out is skipped. A set's answers are derived from those of a highly similar set: once a leader's
distances to the list are computed, its followers look only at the sets near the leader, as distances obey the triangle
inequality; parity sketches measure them and never overstate one.

Candidates are linked by a forest and checked exactly on whole sets, so no group is expanded into all its pairs. Where an
edge fails, the nearest pairs of the components it would have joined follow, in batches that grow until none is left. A
long list is read in parts that share leaders; afterwards only sets outside its largest component meet the other parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import written
from matchlake.scratch import small_batches

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words rarer than this share of all words count as rare; at most its inverse can be frequent, which bounds the broadcast.
RARE = 4e-6
CACHED_WORDS = 120_000
CHUNK = 512  # sets of a list that one group holds
LEADERS = 64  # about so many sets of a longer list are in all its groups
SMALL = 48  # so many sets are compared at once
BATCH = 64  # pairs that one list proposes for two components, at first
REMEMBERED = 100_000  # pairs a task keeps, so as not to propose them again
SALTS = 64  # a set that is in many pairs is sent to at most so many tasks
BROADCAST_IDS = 1_000_000
BATCH_ROWS = 2000  # texts, or members of lists with their sketches, that a Python worker gets at once
BLOCK_BYTES = 4 << 20  # of sketches that are held against others at once
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _from_python(df: DataFrame, label: str) -> DataFrame:
    """df, which Python workers make, as a written table; they hold few texts or sketches at once."""
    with small_batches(df.sparkSession, BATCH_ROWS):
        return written(df, label)


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased; bytes split at exactly the white space \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


class _Words(dict):
    """word -> 64-bit hash whose low four bits are the word's frequency class; bounded."""

    def __init__(self, classes: dict[int, int] | None = None):
        super().__init__()
        self.classes = classes or {}

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word) & ~15
        h |= self.classes.get(h, 0)
        self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingles(words: list[bytes], size: int, hashes: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and the frequency class of each (the sum of its words' classes)."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=1)], np.uint64), np.zeros(1, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    classes = (w & np.uint64(15)).astype(np.int64)
    w = w & ~np.uint64(15)
    n = len(words) - size + 1
    h, rank = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for i in range(size):
        h = _mix(h + w[i:i + n] + np.uint64(i + 1))
        rank += classes[i:i + n]
    h, first = np.unique(h, return_index=True)
    return h, rank[first]


def _sketch(h: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2^k >= 2n bits (256 to 32768): xor counts at most the sets' difference."""
    bits = int(min(1 << 15, max(256, 1 << int(2 * len(h) - 1).bit_length())))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words that hold at least half the rare share of a task's words, and the number of all its words under null."""
    seen: Counter = Counter()
    total, most = 0, 2 * CACHED_WORDS
    for batch in batches:
        for text in batch["text"]:
            words = words_of(text)
            total += len(words)
            seen.update(words)
            if len(seen) > most:  # a word this rare so far cannot reach the share by its count so far
                seen = Counter({w: c for w, c in seen.items() if c > total * RARE / 8})
                most = max(2 * CACHED_WORDS, 2 * len(seen))
    rows = [(xxhash.xxh3_64_intdigest(w) & ~15, c) for w, c in seen.items() if c >= total * RARE / 2]
    yield pd.DataFrame({"word": np.array([r[0] for r in rows], np.uint64).view(np.int64), "n": np.array([r[1] for r in rows], np.int64)}).assign(rest=False)
    yield pd.DataFrame({"word": [0], "n": [total], "rest": [True]})


def frequency_classes(df: DataFrame) -> dict[int, int]:
    """hash -> 1..15, the binary logarithm of how often a word is above RARE; at most 1 / RARE words."""
    counts = _from_python(df.mapInPandas(_count_words, "word long, n long, rest boolean").groupBy("rest", "word").agg(F.sum("n").alias("n")), "join-words")
    total = counts.where("rest").agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(~F.col("rest") & (F.col("n") >= F.lit(total * RARE))).toPandas()
    classes = np.clip(np.log2(frequent["n"].to_numpy() / max(total * RARE, 1e-9)).astype(int) + 1, 1, 15)
    return dict(zip(frequent["word"].to_numpy().view(np.uint64).tolist(), classes.tolist(), strict=True))


def _index(size: int, num: int, den: int, shared):
    """Set size, 128-bit identity, prefix in the global order (rarest first) and sketch of each text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Words(shared.value)
        for texts in batches:
            out = []
            for text in texts:
                h, rank = shingles(words_of(text), size, hashes)
                n = len(h)
                if not n:
                    out.append((0, 0, 0, [], b""))
                    continue
                prefix = n - (num * n + den - 1) // den + 1
                order = np.lexsort((h, rank))[:prefix]
                sign = xxhash.xxh3_128_digest(h.tobytes())
                out.append((n, int.from_bytes(sign[:8], "big", signed=True), int.from_bytes(sign[8:], "big", signed=True), h[order].view(np.int64), _sketch(h)))
            yield pd.DataFrame(out, columns=["n", "hi", "lo", "prefix", "sketch"])
    return F.pandas_udf(run, "n int, hi long, lo long, prefix array<long>, sketch binary")


def _sets(size: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Words()
        for texts in batches:
            yield pd.Series([shingles(words_of(t), size, hashes)[0].view(np.int64) for t in texts])
    return F.pandas_udf(run, "array<long>")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _distances(bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of the index pairs (left, right), block by block: all pairs of a long list of long sketches are a gigabyte."""
    step = max(1, BLOCK_BYTES // max(1, bits[:1].nbytes))
    return np.concatenate([np.empty(0, np.int64), *(_distance(bits[left[i:i + step]], bits[right[i:i + step]]) for i in range(0, len(left), step))])


def _within(bits, p, size, left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the index pairs left x right, those that positions, sizes and sketches do not rule out, and their distances."""
    rest = size - p
    most = (size[left, None] + size[None, right]) * (den - num) // (den + num)
    x, y = np.nonzero(np.abs(p[left, None] - p[None, right]) + np.abs(rest[left, None] - rest[None, right]) <= most)
    far = _distances(bits, left[x], right[y])
    near = far <= most[x, y]
    return left[x[near]], right[y[near]], far[near]


def _survivors(pos: np.ndarray, n: np.ndarray, sketches: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of one list, each once, that may link, with the distance that their sketches show."""
    lengths = np.array([len(s) for s in sketches])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]
    for length in np.unique(lengths):
        rows = np.nonzero((lengths == length) | (lengths == 2 * length))[0]
        bits = np.empty((len(rows), length // 8), np.uint64)
        wide = lengths[rows] > length
        for x, r in enumerate(rows):
            s = np.frombuffer(sketches[r], np.uint8)
            # bits are taken modulo a power of two, so xor of the halves is the sketch of half the width
            bits[x] = (s[:length] ^ s[length:] if wide[x] else s).view(np.uint64)
        order = np.argsort(pos[rows], kind="stable")
        rows, bits, wide = rows[order], bits[order], wide[order]
        p, size = pos[rows], n[rows]

        def keep(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
            use = ~(wide[a] & wide[b])  # noqa: B023
            found.append((rows[a[use]], rows[b[use]], far[use]))  # noqa: B023

        if len(rows) <= SMALL:
            every = np.arange(len(rows))
            a, b, far = _within(bits, p, size, every, every, num, den)
            keep(a[a < b], b[a < b], far[a < b])
            continue
        # A leader, the first set left; its distances to all left within reach of its position; its followers' answers of these.
        left = np.arange(len(rows))
        while len(left) > 1:
            lead = left[0]
            slack = 2 * int(size[lead]) * (den - num) // (den + num) // 4
            largest = int(size[lead]) + slack  # of a follower; its answers hold at most den / num times as many
            bound = (largest + min(int(size[left].max()), largest * den // num)) * (den - num) // (den + num)
            # Positions ascend: what lies beyond the bound is skipped as a whole.
            reach = left[:np.searchsorted(p[left], p[lead] + 2 * bound, side="right")]
            far = _distance(bits[reach], bits[lead])
            follows = (far <= slack) & (p[reach] <= p[lead] + bound) & (size[reach] <= largest)
            follows[0] = True
            mine, his = reach[follows], far[follows]
            a, b, d = _within(bits, p, size, mine, reach[far <= bound + int(his.max())], num, den)
            place = np.full(len(rows), -1)
            place[mine] = np.arange(len(mine))
            once = (place[b] < 0) | (a < b)  # a pair of two followers comes up twice
            once &= a != b
            keep(a[once], b[once], d[once])
            left = left[place[left] < 0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class _Forest:
    """Components of the nodes one task has met; gives edges that join components, fewest first."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (parent := self.up.get(root, root)) != root:
            root = parent
        while (parent := self.up.get(x, x)) != root:
            self.up[x] = root
            x = parent
        return root

    def joining(self, nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Of the index pairs (a, b), a forest across components, edges to small nodes first."""
        label = np.array([self.find(int(x)) for x in nodes])
        found = []
        while len(a):
            cross = label[a] != label[b]
            a, b = a[cross], b[cross]
            if not len(a):
                break
            own = np.concatenate([label[a], label[b]])
            other = np.concatenate([label[b], label[a]])
            edge = np.concatenate([np.arange(len(a)), np.arange(len(a))])
            first = np.lexsort((np.minimum(nodes[a], nodes[b])[edge], other, own))
            _, at = np.unique(own[first], return_index=True)
            for e in np.unique(edge[first][at]):
                x, y = self.find(int(nodes[a[e]])), self.find(int(nodes[b[e]]))
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    found.append((int(min(nodes[a[e]], nodes[b[e]])), int(max(nodes[a[e]], nodes[b[e]]))))
            label = np.array([self.find(int(x)) for x in nodes])
        return found


def _nearest(a: np.ndarray, b: np.ndarray, label: np.ndarray, far: np.ndarray, batch: int) -> tuple[np.ndarray, bool]:
    """Which pairs are among the `batch` nearest of their two components, and whether any are not."""
    x, y = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
    order = np.lexsort((far, y, x))
    new = np.ones(len(order), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < batch], bool((np.arange(len(order)) - first >= batch).any())


def _pair_rows(num: int, den: int, batch: int | None):
    """Pairs to check, of groups that arrive as consecutive rows: a forest, or with `batch` the nearest ones of every two components.

    A pair of -1 and a token says that a batch was too small for all pairs of its list.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held = _Forest(), None
        told: set[tuple[int, int]] = set()

        def pairs(group: pd.DataFrame) -> list[tuple[int, int]]:
            nodes, label = group["rep"].to_numpy(), group["label"].to_numpy()
            if len(nodes) < 2 or (batch and (label == label[0]).all()):
                return []
            a, b, far = _survivors(group["pos"].to_numpy().astype(np.int64), group["n"].to_numpy().astype(np.int64), group["sketch"].tolist(), num, den)
            if not batch:
                return forest.joining(nodes, a, b)
            cross = label[a] != label[b]
            a, b, far = a[cross], b[cross], far[cross]
            at, more = _nearest(a, b, label, far, batch)
            x, y = nodes[a[at]], nodes[b[at]]
            if len(told) > REMEMBERED:
                told.clear()
            # lists of one group share most of their pairs
            new = [pair for pair in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True) if pair not in told]
            told.update(new)
            return [*new, *([(-1, int(group["token"].iloc[0]))] if more else [])]

        for rows in batches:
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            key = rows[["token", "i", "j"]].to_numpy()
            starts = np.concatenate([[0], 1 + np.nonzero((key[1:] != key[:-1]).any(axis=1))[0]]) if len(rows) else np.array([0])
            out = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                out += pairs(rows.iloc[s:e])
            held = rows.iloc[starts[-1]:]
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        if held is not None and len(held):
            yield pd.DataFrame(pairs(held), columns=["a", "b"], dtype=np.int64)
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b), by label passing with shortcuts; nodes without edges are absent."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    labels = written(labels, "join-labels")
    while True:
        best = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node"))
        step = labels.join(best, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Only nodes that are labels are asked for theirs; a large component is then one row on that side, not one task.
        roots = labels.select("label").distinct().join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        step = written(step.join(roots, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label")), "join-labels")
        if step.where("label <> old").limit(1).count() == 0:
            return step.select("node", "label")
        labels = step.select("node", "label")


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of `labels` once more edges are known; only edges between different components are passed along."""
    named = edges.select("a", "b")
    for end in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
    over = components(named.where("a <> b").select("a", "b"))
    known = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return written(known.unionByName(over.join(labels, "node", "left_anti").select("node", "label")), "join-labels")


def _identity(text: Column) -> list[Column]:
    """128 bits of a text, by which a set's text is found again."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _dealt(members: DataFrame) -> DataFrame:
    """Rows of lists by group (token, i, j): a list of at most CHUNK sets is one; a longer one has parts that share leaders."""
    parts = F.ceil(F.col("k") / F.lit(CHUNK)).cast("int")
    leads = (F.col("k") > CHUNK) & (F.pmod(F.xxhash64("rep", F.lit(5)), F.col("k")) < LEADERS)
    own = F.array(F.pmod(F.xxhash64("rep", F.lit(3)), parts).cast("int"))
    return members.withColumn("i", F.explode(F.when(leads, F.sequence(F.lit(0), parts - 1)).otherwise(own))).withColumn("j", F.lit(0))


def _with_neighbours(members: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (token, k, pos, rep, n) of lists without those that no other set of their list can link with, by sizes, and in a list of two by positions.

    In the order of sizes the next ones decide, as sets farther off differ more. Longer lists than CHUNK stay whole.
    """
    order = Window.partitionBy("token").orderBy("n", "rep")

    def near(other: Column) -> Column:
        most = F.floor((F.col("n") + other["n"]) * F.lit(den - num) / F.lit(den + num) + 1e-9)
        places = F.abs(F.col("pos") - other["pos"]) + F.abs((F.col("n") - F.col("pos")) - (other["n"] - other["pos"]))
        return F.coalesce((F.abs(F.col("n") - other["n"]) <= most) & ((F.col("k") > 2) | (places <= most)), F.lit(False))

    own = F.struct("n", "pos")
    short = members.where(F.col("k") <= CHUNK).withColumn("__less", F.lag(own).over(order)).withColumn("__more", F.lead(own).over(order))
    return short.where(near(F.col("__less")) | near(F.col("__more"))).drop("__less", "__more").unionByName(members.where(F.col("k") > CHUNK))


def _dealt_again(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, with their labels, of the lists that hold several components.

    A list of at most CHUNK sets is one group. Of a longer one the sets outside its largest component, by parts j, meet
    all sets, by parts i; those inside need not meet each other again.
    """
    named = members.select("token", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("token", F.coalesce("label", "rep").alias("label"))
    sizes = named.groupBy("token", "label").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.max("size").alias("most"), F.count("*").alias("parties"))
    rows = (members.join(sizes.where("parties > 1"), "token").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    half = F.lit(CHUNK // 2)
    all_parts, few_parts = F.ceil(F.col("k") / half).cast("int"), F.ceil((F.col("k") - F.col("most")) / half).cast("int")
    short = rows.where(F.col("k") <= CHUNK).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    long = rows.where(F.col("k") > CHUNK)
    every = (long.withColumn("i", F.pmod(F.xxhash64("rep", F.lit(3)), all_parts).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), few_parts - 1))))
    few = (long.where("label <> largest").withColumn("j", F.pmod(F.xxhash64("rep", F.lit(4)), few_parts).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), all_parts - 1))))
    few = few.where(F.col("i") != F.pmod(F.xxhash64("rep", F.lit(3)), all_parts))  # there it is already
    return short.unionByName(every).unionByName(few).drop("largest", "most", "parties")


def _of_shared_keys(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of the rows that share a key."""
    keyed = rows.where("n > 0 AND key IS NOT NULL")
    one = F.struct("n", "hi", "lo")
    several = (keyed.groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low <> high")
               .select("key", F.col("low.n").alias("low_n"), F.col("low.hi").alias("low_hi"), F.col("low.lo").alias("low_lo")))
    pairs = keyed.join(several, "key").select("n", "hi", "lo", "low_n", "low_hi", "low_lo").distinct().join(classes.select("n", "hi", "lo", F.col("rep").alias("b")), ["n", "hi", "lo"]).drop("n", "hi", "lo")
    named = pairs.withColumnsRenamed({"low_n": "n", "low_hi": "hi", "low_lo": "lo"}).join(classes.select("n", "hi", "lo", F.col("rep").alias("a")), ["n", "hi", "lo"])
    return named.where("a <> b").select("a", "b")


def linked_texts(df: DataFrame, key: str, text: str, size: int, percent: int, share_keys: bool) -> DataFrame:
    """key, t1 and t2 (the text's identity), n (set size) and label of every row; rows of one component have one label.

    share_keys says that rows of one key are one document. Rows without words have no label.
    """
    if percent < 50:
        raise ValueError("sketches of more than twice the width are not compared: percent is at least 50")
    spark = df.sparkSession
    num, den = percent, 100
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(frequency_classes(docs.select("text")))
    rows = _from_python(docs.select("key", *_identity(F.col("text")), _index(size, num, den, shared)(F.col("text")).alias("r")).select("key", "t1", "t2", "r.*"), "join-rows")

    # Equal sets are one class, numbered; combined before the shuffle, so hot copies are few rows.
    classes = (rows.where("n > 0").groupBy("n", "hi", "lo").agg(F.min_by(F.struct("t1", "t2", "prefix", "sketch"), F.struct("t1", "t2")).alias("own"))
               .select(F.monotonically_increasing_id().alias("rep"), "n", "hi", "lo", "own.*"))
    classes = written(classes, "join-classes")

    postings = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    stats = (postings.groupBy("token").agg(F.count("*").alias("k"), F.min("rep").alias("least"), F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("s1"),
                                           F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("s2")).where("k > 1"))
    lists = stats.groupBy("k", "least", "s1", "s2").agg(F.min("token").alias("token")).select("token", "k", "least")
    # lists of one group meet in few tasks, which then propose fewer edges; longer lists are spread over more
    salt = F.pmod(F.xxhash64("token"), F.when(F.col("k") <= 2, F.lit(1)).otherwise(F.lit(8) + F.ceil(F.col("k") / F.lit(64))))
    members = postings.join(lists, "token").select("token", "k", "least", salt.alias("salt"), "pos", "rep", "n")
    members = written(_with_neighbours(members, num, den), "join-lists")

    def proposed(given: DataFrame, batch: int | None) -> DataFrame:
        # sketches, the bulk of a row, join it only now that all else is known: they are written nowhere and sent once to each group
        given = given.select("token", "least", "salt", "i", "j", "pos", "rep", "n", "label").join(classes.select("rep", "sketch"), "rep").repartition("least", "salt", "i", "j")
        return given.sortWithinPartitions("least", "salt", "token", "i", "j", "pos").mapInPandas(_pair_rows(num, den, batch), "a long, b long").distinct()

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets."""
        ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
        texts = written(ids.join(classes.select("rep", "t1", "t2"), "rep"), "join-asked")
        asked = F.broadcast(texts) if texts.count() <= BROADCAST_IDS else texts
        there = docs.select("text", *_identity(F.col("text"))).join(asked, ["t1", "t2"]).dropDuplicates(["rep"])
        sets = _from_python(there.select("rep", _sets(size)(F.col("text")).alias("items")), "join-sets")
        joined = pairs.withColumn("salt_a", F.pmod(F.xxhash64("b"), F.lit(SALTS))).withColumn("salt_b", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
        for side, items in (("a", "x"), ("b", "y")):
            # A set goes once to each task that has pairs of it, and a set of very many pairs to SALTS tasks.
            needed = joined.select(side, f"salt_{side}").distinct().join(sets.select(F.col("rep").alias(side), F.col("items").alias(items)), side)
            joined = joined.join(needed, [side, f"salt_{side}"])
        common = F.size(F.array_intersect("x", "y"))
        return joined.where(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b")

    first = _from_python(proposed(_dealt(members).withColumn("label", F.col("rep")), None), "join-pairs")
    held = written(links(first), "join-links")
    labels = components(held)
    n_tested, batch, more = first.count(), BATCH, True
    tested = first
    if held.count() == n_tested and not members.where(F.col("k") > CHUNK).limit(1).count():
        more = False
    open_lists = members
    while more:
        asked = _from_python(proposed(_dealt_again(open_lists, labels), batch), "join-pairs")
        # every pair of the other lists is tested now
        unread = asked.where("a = -1").select(F.col("b").alias("token"))
        more = bool(unread.limit(1).count())
        open_lists = members.join(unread, "token", "left_semi")
        fresh = written(asked.where("a <> -1").join(tested, ["a", "b"], "left_anti"), "join-pairs")
        if fresh.limit(1).count():
            new = written(links(fresh), "join-links")
            tested = tested.unionByName(fresh)
            if new.limit(1).count():
                labels = extended(labels, new)
        batch *= 8

    if share_keys:
        shared_keys = written(_of_shared_keys(rows, classes), "join-shared")
        if shared_keys.limit(1).count():
            labels = extended(labels, shared_keys)
    named = classes.select("rep", "n", "hi", "lo").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "hi", "lo", F.coalesce("label", "rep").alias("label"))
    return rows.select("key", "t1", "t2", "n", "hi", "lo").join(named, ["n", "hi", "lo"], "left").select("key", "t1", "t2", "n", "label")


def similar_sets(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles and component_id (smallest key reachable by links) of every row.

    Two rows link when 100 * intersection >= percent * union of their sets of distinct shingles of `size` words.

    - fewer words than size: the whole sequence is the one shingle. No words, empty or null text: n_shingles 0, linked
      with nothing; component_id is the key.
    - keys are whole numbers. Rows of null key link as others do; where a component has no other key, its id is null.
    - rows that share a key are one document, whatever their texts, and so in one component. Repeated rows get equal
      results. Ties cannot occur: ids are minima. The order of rows never matters.
    - percent is at least 50. An empty table gives an empty result; other columns are ignored.
    """
    linked = written(linked_texts(df, key, text, size, percent, share_keys=True), "join-labelled")
    least = linked.where("label IS NOT NULL").groupBy("label").agg(F.min("key").alias("component"))
    return linked.join(least, "label", "left").select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component")).alias("component_id"))


def keep_one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, all columns as they are, but of each group of linked texts only the one of the smallest key.

    - texts without words are copies of their equals; null equals the empty text.
    - null keys come last; among equal keys the texts' hashes decide, so that neither chance nor order does. Rows that
      repeat key and text stay once. A key that several unlinked texts share keeps them all.
    """
    linked = written(linked_texts(df, key, text, size, percent, share_keys=False), "join-labelled")
    rows = linked.groupBy("key", "t1", "t2", "n", "label").agg(F.count("*").alias("times"))
    choice = F.struct(F.col("key").isNull().alias("unnamed"), "key", "t1", "t2", "times")
    blank = F.col("n") == 0
    stays = (rows.groupBy(blank.alias("blank"), F.when(blank, F.col("t1")).otherwise(F.col("label")).alias("g1"), F.when(blank, F.col("t2")).otherwise(F.lit(0)).alias("g2"))
             .agg(F.min(choice).alias("best")).select("best.key", "best.t1", "best.t2", "best.times"))
    stays = written(stays, "join-stays")
    # The row is one column here, so that no name of df can clash; the key is part of the join, so that copies are spread.
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(key).cast("long").alias("own"), *_identity(F.coalesce(F.col(text), F.lit(""))))

    def there(chosen: DataFrame) -> DataFrame:
        return packed.join(chosen.select("key", "t1", "t2"), packed["own"].eqNullSafe(chosen["key"]) & (packed["t1"] == chosen["t1"]) & (packed["t2"] == chosen["t2"]), "left_semi")

    repeated = stays.where("times > 1")
    out = there(stays.where("times = 1")).select("doc")
    if repeated.limit(1).count():
        out = out.unionByName(there(repeated).dropDuplicates(["own", "t1", "t2"]).select("doc"))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in df.columns])
