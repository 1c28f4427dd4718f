"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents are tokenized and cut into pieces; pieces that fill a sequence stand alone. The others are dealt to islands by
a hash. On each island a small population of packings evolves: crossover injects whole well-filled bins of one parent
into the other, drops the bins that then hold a document twice, and best-fits the documents this displaces. Between two
epochs, islands hand their best-filled bins, as multisets of lengths, to a neighbour, which injects them with its own
documents of those lengths. Every island holds a bounded number of pieces, so memory does not grow with the corpus.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import written

END_ID = 2
CACHED_UNITS = 300_000
#: White space next to a space, or white space on which regular-expression engines differ: such texts are encoded whole.
_UNEVEN = re.compile("\\s | \\s|[\x1c-\x1f\x85\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


class Encoder:
    """Byte-level BPE ids, as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library.

    The vocabulary's pattern starts a token at every space before a word, so a text with single spaces only is encoded
    space by space, from a bounded cache; all other texts, and those with a special token's string, are encoded whole.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        encode = self.ranks.encode_ordinary

        class Units(dict):
            def __missing__(self, unit: str) -> bytes:
                if len(self) > CACHED_UNITS:
                    self.clear()
                self[unit] = ids = np.array(encode(" " + unit), "<u4").tobytes()
                return ids

        self.units = Units()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or _UNEVEN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.ranks.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.units.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(name)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else pieces of capacity after a first one that takes the rest."""
    if n <= capacity:
        return [(0, n)]
    head = n - capacity * ((n - 1) // capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def _piece_lists(name: str, capacity: int, keep_ids: bool):
    def run(texts: pd.Series) -> pd.Series:
        encode, end = encoder(name), np.array([END_ID], "<u4").tobytes()
        out = []
        for text in texts:
            ids = encode(text or "") + end
            out.append([{"start": start, "length": length, "ids_crc32": zlib.crc32(part := ids[4 * start:4 * (start + length)]), **({"ids": part} if keep_ids else {})}
                        for start, length in cut(len(ids) // 4, capacity)])
        return pd.Series(out)
    return run


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """row, key, piece, start, length, ids_crc32 (and ids) of every piece of every document; null texts are empty."""
    kind = "array<struct<start:long,length:long,ids_crc32:long" + ",ids:binary" * keep_ids + ">>"
    listed = df.select(F.col(key).alias("key"), F.pandas_udf(_piece_lists(tokenizer, capacity, keep_ids), kind)(F.col(text)).alias("parts"))
    return listed.select("key", F.posexplode_outer("parts").alias("piece", "p")).select(F.monotonically_increasing_id().alias("row"), "key", "piece", "p.*")


class _Bins:
    """Bins of one packing, found by room left; best fit takes the fullest bin that still has room."""

    def __init__(self, capacity: int, lengths: list[int]):
        self.capacity, self.lengths = capacity, lengths
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0  # bit r: some bin has r tokens of room

    def add(self, items: list[int], room: int) -> None:
        self.by_room.setdefault(room, []).append(len(self.items))
        self.mask |= 1 << room
        self.items.append(items)
        self.room.append(room)

    def fit(self, item: int) -> None:
        length = self.lengths[item]
        open_ = self.mask >> length
        if not open_:
            self.add([item], self.capacity - length)
            return
        room = length + (open_ & -open_).bit_length() - 1
        at = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.items[at].append(item)
        self.room[at] = left = room - length
        self.by_room.setdefault(left, []).append(at)
        self.mask |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the mean square of how full they are."""
        return -len(self.items), sum((1 - r / self.capacity) ** 2 for r in self.room) / max(1, len(self.room))


def _packed(groups: list[list[int]], rest: list[int], lengths: list[int], capacity: int) -> _Bins:
    """Whole groups as bins, then the rest by best fit, longest first."""
    bins = _Bins(capacity, lengths)
    for g in groups:
        bins.add(list(g), capacity - sum(lengths[x] for x in g))
    for x in sorted(rest, key=lambda x: -lengths[x]):
        bins.fit(x)
    return bins


def crossover(to: _Bins, injected: list[list[int]], capacity: int) -> _Bins:
    """`to` with the injected bins: its bins that hold an injected document are dissolved, what they lose is best-fitted."""
    new = {x for g in injected for x in g}
    kept, displaced = [], []
    for g in to.items:
        if new.isdisjoint(g):
            kept.append(g)
        else:
            displaced += [x for x in g if x not in new]
    # the emptiest bins are opened again too, so that displaced documents can meet others than the full bins' rooms
    order = sorted(range(len(kept)), key=lambda i: sum(to.lengths[x] for x in kept[i]))
    loose = set(order[:max(1, len(kept) // 50)])
    displaced += [x for i in loose for x in kept[i]]
    return _packed(injected + [g for i, g in enumerate(kept) if i not in loose], displaced, to.lengths, capacity)


def evolve(lengths: list[int], capacity: int, seed: int, start: list[list[int]] | None, patterns: list[list[int]], population: int, generations: int) -> _Bins:
    """The best packing after some generations, from best fit and shuffled starts, with patterns of lengths that migrated in."""
    rng = random.Random(seed)
    every = list(range(len(lengths)))
    group = [_packed([], every, lengths, capacity) if start is None else _packed(start, [], lengths, capacity)]
    low = -(-sum(lengths) // capacity)
    while len(group) < population and len(group[0].items) > low:
        mixed = _Bins(capacity, lengths)
        for x in sorted(every, key=lambda x: -lengths[x] * rng.uniform(0.8, 1.2)):
            mixed.fit(x)
        group.append(mixed)
    if patterns and len(group[0].items) > low:
        # migrants: bins of another island, filled with this island's documents of the same lengths
        stock: dict[int, list[int]] = {}
        for x in every:
            stock.setdefault(lengths[x], []).append(x)
        whole = []
        for p in patterns:
            need = {n: p.count(n) for n in p}
            if all(len(stock.get(n, ())) >= c for n, c in need.items()):
                whole.append([stock[n].pop() for n in p])
        group.append(crossover(group[0], whole, capacity))
    for _ in range(generations):
        group.sort(key=_Bins.fitness, reverse=True)
        if len(group[0].items) <= low or len(group) < 2:
            break  # no packing can use fewer bins
        a, b = group[0], group[rng.randrange(1, len(group))]
        if rng.random() < 0.5:
            a, b = b, a
        full = [g for g, r in zip(b.items, b.room, strict=True) if r <= capacity // 128]
        child = crossover(a, rng.sample(full, min(len(full), max(1, len(b.items) // 10))), capacity)
        group[-1] = child if child.fitness() > group[-1].fitness() else group[-1]
    return max(group, key=_Bins.fitness)


def _island(capacity: int, population: int, generations: int):
    """One epoch of one island: rows with their bin, and nested in `elite` of its first row the bins it hands on."""

    def run(rows: pd.DataFrame, migrants: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(rows):
            return rows.assign(bin=pd.Series(dtype="int64"), offset=pd.Series(dtype="int64"))
        rows = rows.sort_values("row", ignore_index=True)
        start = None
        if "bin" in rows:
            groups: dict[int, list[int]] = {}
            for i, b in enumerate(rows["bin"].tolist()):
                groups.setdefault(b, []).append(i)
            start = list(groups.values())
        patterns = [list(p) for ps in (migrants["patterns"] if migrants is not None else []) for p in ps]
        best = evolve(rows["length"].tolist(), capacity, int(rows["island"].iat[0]) * 2 + (start is not None), start, patterns, population, generations)
        bins, offsets = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = best.lengths
        for at, items in enumerate(best.items):
            place = 0
            for x in items:
                bins[x], offsets[x] = at, place
                place += lengths[x]
        return rows.assign(bin=bins, offset=offsets)
    return run


def pack(parts: DataFrame, capacity: int = 1024, island_pieces: int = 3000, population: int = 5, generations: int = 12, elite: int = 64) -> DataFrame:
    """parts (row, length, ...) with sequence_id and offset; a row's sequence holds at most `capacity` tokens.

    Rows of length capacity stand alone. `row` is unique; every other column is passed on.
    """
    small = parts.where(F.col("length") < capacity)
    islands = max(1, -(-small.count() // island_pieces))
    dealt = small.withColumn("island", F.pmod(F.xxhash64("row"), F.lit(islands)).cast("long"))
    columns = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    schema, names = f"{columns}, bin long, offset long", [*dealt.columns, "bin", "offset"]
    evolve_once = _island(capacity, population, generations)
    first = written(dealt.groupBy("island").applyInPandas(lambda rows: evolve_once(rows), schema), "packing-epoch")
    # Elites: an island's fullest bins, as the lengths they hold, go to the next island.
    bins = first.groupBy("island", "bin").agg(F.sum("length").alias("fill"), F.collect_list("length").alias("pattern"))
    elites = (bins.where(F.col("fill") >= capacity - capacity // 128).groupBy("island")
              .agg(F.expr(f"slice(transform(array_sort(collect_list(struct(-fill AS low, pattern))), x -> x.pattern), 1, {elite})").alias("patterns"))
              .select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "patterns"))
    final = (first.drop("offset").groupBy("island").cogroup(elites.groupBy("island"))
             .applyInPandas(lambda rows, migrants: evolve_once(rows, migrants)[names], schema))
    placed = final.withColumn("sequence_id", F.col("island") * F.lit(1 << 24) + F.col("bin")).drop("island", "bin")
    alone = parts.where(F.col("length") == capacity).select("*", F.lit(0).cast("long").alias("offset"), (-1 - F.col("row")).alias("sequence_id"))
    return placed.unionByName(alone)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = 1024, keep_ids: bool = False, **options) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    - null and empty texts are one piece that holds the end id only. Repeated rows are packed as documents of their own.
    - only documents longer than capacity are cut; the first piece takes what is left over.
    - equal lengths are interchangeable; ties go to the row read first. An empty table gives an empty result.
    - other columns are ignored.
    """
    parts = written(pieces(df, key, text, tokenizer, capacity, keep_ids), "packing-pieces")
    packed = pack(parts, capacity, **options)
    return packed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
