"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

A text is looked at through windows as long as a benchmark item; a shorter text is one window. A window can reach the
wanted similarity only if it shares a shingle with an item, so windows are laid where one does, aligned as in the item.
Windows and items get SimHash fingerprints of their shingles. The similarity bounds how many shingles can differ, and so
which bits of an item's fingerprint can: all others, its firm bits, must be equal, which drops no window that reaches
the similarity. An exact weighted-shingle similarity decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import words_of, written

SIZE = 5  # words of a shingle
FIELD = 20  # bits of a packed counter: windows of up to a million shingles
BROADCAST_ROWS = 500_000


def _shingles(words: str, size: int = SIZE) -> str:
    """Hash of every run of `size` words; of the whole sequence if it is shorter."""
    return f"CASE WHEN size({words}) >= {size} THEN transform(sequence(1, size({words}) - {size - 1}), i -> xxhash64(slice({words}, i, {size}))) WHEN size({words}) > 0 THEN array(xxhash64({words})) ELSE array() END"


def _bits(hashes: str, seed: int, holds: str) -> Column:
    """60 bits: bit b says whether `holds` is true of x, how many more of the hashes have it than have not. Three counters share a long."""
    mask = sum(1 << (FIELD * j) for j in range(3))
    sums = ", ".join(f"aggregate({hashes}, 0L, (a, h) -> a + (shiftright(xxhash64(h, {seed}), {k}) & {mask}L))" for k in range(FIELD))
    bits = " | ".join(f"(CASE WHEN {holds.replace('x', f'(2 * (shiftright(s, {FIELD * j}) & {(1 << FIELD) - 1}L) - size({hashes}))')} THEN shiftleft(1L, 3 * k + {j}) ELSE 0L END)" for j in range(3))
    return F.expr(f"aggregate(transform(array({sums}), (s, k) -> {bits}), 0L, (a, x) -> a | x)")


def _fingerprint(hashes: str, seed: int) -> Column:
    """60 bits of SimHash: bit b says whether most hashes have it."""
    return _bits(hashes, seed, "x > 0")


def _firm(hashes: str, seed: int, changes: str) -> Column:
    """The bits of the fingerprint that no `changes` hashes, added or taken away, can turn."""
    return _bits(hashes, seed, f"(x > {changes} OR x <= -{changes})")


def _changes(own: str, mass: str, similarity: float) -> Column:
    """The most shingles, missing and added, by which a window of at least this similarity differs from an item.

    Missing weight + similarity * added <= (1 - similarity) * mass, so the lightest go first, and the rest is added.
    """
    least, room = max(similarity, 1e-9), f"({mass} * {1 - similarity!r}D + 1e-6D)"
    return F.expr(f"""aggregate(array_sort(transform({own}, o -> o.weight)), struct(0L AS n, 0D AS gone, cast(floor({room} / {least!r}D) AS long) AS most),
        (a, w) -> struct(a.n + 1L AS n, a.gone + w AS gone, CASE WHEN a.gone + w <= {room} THEN greatest(a.most, a.n + 1L + cast(floor(({room} - a.gone - w) / {least!r}D) AS long)) ELSE a.most END AS most),
        a -> a.most)""")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: broadcast only where its counted rows are few, else left to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(key, text_hash, item, start, length, similarity): each text's best window for each item it leaks.

    Words are lower-cased; start counts words. A shingle of k items weighs 1 / k, one of no item weighs 1.

    - null and empty texts, and items of null id or no words, leak nothing. Items of fewer than five words are one shingle.
    - rows equal in key and text count once; ties go to the earliest window. Empty tables give an empty result.
    - other columns are ignored.
    """
    items = benchmark.select(F.col(item).alias("item"), words_of(F.lower(F.col(item_text))).alias("words")).where((F.size("words") > 0) & F.col("item").isNotNull())
    items = items.dropDuplicates().withColumn("hashes", F.expr(_shingles("words"))).withColumn("length", F.size("words"))
    items = written(items.select("item", "length", "hashes"), "leak-words")
    of_items = items.select("item", "length", F.posexplode("hashes").alias("at", "h"))
    weights = of_items.groupBy("h").agg((F.lit(1.0) / F.count_distinct("item")).alias("weight"))
    weighted = (of_items.select("item", "length", "h").distinct().join(weights, "h").groupBy("item", "length")
                .agg(F.collect_list(F.struct("h", "weight")).alias("own"), F.sum("weight").alias("mass")))
    prints = weighted.withColumn("its", F.expr("transform(own, o -> o.h)")).withColumn("changes", _changes("own", "mass", similarity))
    items = written(prints.select("item", F.col("length").alias("item_length"), "own", "mass", *[c.alias(f"item_{n}") for n, c in (("low", _fingerprint("its", 1)), ("high", _fingerprint("its", 2)))],
                                  _firm("its", 1, "changes").alias("firm_low"), _firm("its", 2, "changes").alias("firm_high")), "leak-items")
    places = written(of_items.select("h", "at", "item", "length").distinct(), "leak-places")
    n_places = places.count()
    sizes = sorted(r[0] for r in items.select(F.least("item_length", F.lit(SIZE))).distinct().collect()) or [SIZE]

    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    lists = [f"CASE WHEN size(words) >= {s} THEN transform(sequence(1, size(words) - {s - 1}), i -> xxhash64(slice(words, i, {s}))) ELSE array() END" for s in sizes]
    worded = docs.select("key", "text_hash", words_of(F.lower("text")).alias("words")).select("key", "text_hash", F.size("words").alias("n"), *[F.expr(x).alias(f"h{i}") for i, x in enumerate(lists)])
    # The outer form, as for the plain one the optimizer would filter on its size first and split the text for each word.
    runs = [worded.select("key", "text_hash", "n", F.posexplode_outer(f"h{i}").alias("pos", "h")) for i in range(len(sizes))]
    anchors = runs[0]
    for r in runs[1:]:
        anchors = anchors.unionByName(r)
    # A text shorter than the item is one window.
    windows = (anchors.join(_few(places, n_places), "h").withColumn("item_length", F.col("length")).withColumn("length", F.least("n", "item_length"))
               .select("key", "text_hash", "length", F.least(F.greatest(F.col("pos") - F.col("at"), F.lit(0)), F.col("n") - F.col("length")).alias("start"), F.struct("item", "item_length").alias("of"))
               .groupBy("key", "text_hash", "length", "start").agg(F.collect_set("of").alias("of")))
    windows = written(windows, "leak-windows")
    n_windows = windows.count()

    # The words of the windows' texts, then the fingerprint of each window.
    spots = windows.groupBy("key", "text_hash").agg(F.collect_list(F.struct("length", "start", "of")).alias("spots"))
    spots = spots.withColumnsRenamed({"key": "its_key", "text_hash": "its_hash"})
    looked = (docs.join(_few(spots, n_windows), F.col("key").eqNullSafe(F.col("its_key")) & (F.col("text_hash") == F.col("its_hash"))).dropDuplicates(["key", "text_hash"])
              .select("key", "text_hash", words_of(F.lower("text")).alias("all"), "spots")
              .select("key", "text_hash", F.explode(F.expr("transform(spots, s -> struct(s.length, s.start, s.of, slice(all, s.start + 1, s.length) AS words))")).alias("w"))
              .select("key", "text_hash", "w.*"))
    looked = looked.select("key", "text_hash", "length", "start", "of", F.expr(f"array_distinct({_shingles('words')})").alias("hashes"))
    looked = written(looked.select("*", _fingerprint("hashes", 1).alias("low"), _fingerprint("hashes", 2).alias("high")), "leak-prints")
    met = (looked.select("*", F.explode("of").alias("o")).select("*", "o.item", "o.item_length").drop("o", "of")
           .join(_few(items, n_places), ["item", "item_length"])
           .where((F.col("low").bitwiseXOR(F.col("item_low")).bitwiseAND(F.col("firm_low")) == 0) & (F.col("high").bitwiseXOR(F.col("item_high")).bitwiseAND(F.col("firm_high")) == 0)))
    shared = F.aggregate(F.filter("own", lambda x: F.array_contains("hashes", x["h"])), F.lit(0.0), lambda a, x: a + x["weight"])
    alone = F.size(F.array_except("hashes", F.transform("own", lambda x: x["h"])))
    scored = met.withColumn("similarity", shared / (F.col("mass") + alone)).where(F.col("similarity") >= similarity)
    best = scored.groupBy("key", "text_hash", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "length")).alias("b"))
    return best.select("key", "text_hash", "item", (-F.col("b.back")).cast("long").alias("start"), F.col("b.length").cast("long").alias("length"), F.col("b.similarity").alias("similarity"))


def keep_unleaked(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df, all columns as they are, that leak no benchmark item."""
    leaks = written(find_leaks(df, benchmark, key, text, **options).select(F.col("key").alias("its_key"), F.col("text_hash").alias("its_hash")).distinct(), "leaks")
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    same = F.col("key").eqNullSafe(F.col("its_key")) & (F.col("text_hash") == F.col("its_hash"))
    return rows.join(_few(leaks, leaks.count()), same, "left_anti").select("row.*")
