"""Sharding by sampled splitters, in DataFrame operations only.

A size-weighted sample of keys gives quantile boundaries; rows are range-partitioned by them; ranges that hold too many
bytes are subdivided at quantiles of their own. What then still holds too many rows, be it many keys or one hot key, is
subdivided by ranges of the text's checksum, and, where equal rows are too many, by row. Within a range a window adds sizes up, ranges are chained by their
totals, and a record goes to the shard in which the middle of its bytes falls. So shards differ by less than one record
whatever the sample was: the sample decides only how evenly the work is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from matchlake.llm.common import written

SCHEMA = "doc_id, size, text_crc32, law, shard, slot, grown_shard"
RANGE_ROWS = 1_000_000  # of a range at most, so that the number of ranges grows with the rows and no window does


def _at_or_below(bounds: Column, key: Column) -> Column:
    """How many of the ascending bounds are at or below key."""
    return F.size(F.filter(bounds, lambda b: b <= key))


def shard_by_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, ranges_per_shard: int = 8,
                   sample_per_range: int = 16, overfull: float = 2.0, sub_ranges: int = 8) -> DataFrame:
    """Assign every record to one of `shards` shards of near equal bytes.

    Returns key, size (UTF-8 bytes + 8), text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    - null text: size 8, crc of no bytes (0). Empty table: empty result. Null keys sort first.
    - repeated rows and equal keys: ordered by size, then crc; rows equal in all three are interchangeable.
    - a text longer than a shard's share still stays whole, in the shard of its middle byte.
    - other columns of df are ignored, whatever their names.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    rows = written(df.select(F.col(key).alias("doc_id"), (F.octet_length(text_col).cast("long") + 8).alias("size"),
                             F.crc32(text_col).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "shard-sizes")
    numeric = isinstance(df.schema[key].dataType, NumericType)
    order = F.coalesce((F.col("doc_id") if numeric else F.xxhash64("doc_id")).cast("double"), F.lit(float("-inf")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard

    # Size-weighted sample: a row is drawn with probability size * wanted / total, decided by a hash of its key.
    draw = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(20)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = ranges * sample_per_range
    steps = [i / ranges for i in range(1, ranges)]
    sample = rows.where(draw < F.col("size") * F.lit(float(wanted)) / F.lit(float(max(total, 1))))
    bounds = sample.agg(F.percentile_approx(order, steps, 10_000)).first()[0] or []
    coarse = rows.withColumn("part", _at_or_below(F.lit(bounds).cast("array<double>"), order))

    # Overfull ranges are cut again, at quantiles of their own keys; at most `overfull`-th of the ranges can be overfull.
    weights = coarse.groupBy("part").agg(F.sum("size").alias("part_bytes"))
    full = weights.where(F.col("part_bytes") > F.lit(overfull * total / ranges)).select("part")
    cuts = (coarse.join(F.broadcast(full), "part")
            .groupBy("part").agg(F.percentile_approx(order, [i / sub_ranges for i in range(1, sub_ranges)], 1000).alias("cuts")))
    fine = (coarse.join(F.broadcast(cuts), "part", "left")
            .withColumn("sub", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(_at_or_below(F.col("cuts"), order)))
            .drop("cuts"))
    cell = ["part", "sub"]

    # Ranges of too many rows are cut by checksum, and what is still too large, equal rows, by row.
    for level, place in (("by_text", F.floor(F.col("text_crc32") * F.col("cells") / F.lit(float(1 << 32)))), ("by_row", F.pmod(F.xxhash64("row"), F.col("cells")))):
        sizes = fine.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(float(RANGE_ROWS))).alias("cells")).where("cells > 1")
        fine = fine.join(F.broadcast(sizes), cell, "left").withColumn(level, F.when(F.col("cells").isNull(), F.lit(0)).otherwise(place)).drop("cells")
        cell = [*cell, level]

    # Totals of the ranges, chained: rows / RANGE_ROWS and at most ranges * sub_ranges more.
    chain = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = (fine.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
              .select(*cell, F.coalesce(F.sum("bytes").over(chain), F.lit(0)).alias("bytes_before"),
                      F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("rows_before")))
    inside = Window.partitionBy(*cell).orderBy("doc_id", "size", "text_crc32", "row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (fine.select("*", F.row_number().over(inside).alias("nth"), F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("before"))
              .join(F.broadcast(starts), cell)
              .select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth") - 1).alias("place"),
                      # floor((start + size / 2) * shards / total) in whole numbers
                      F.least(F.lit(shards - 1), F.expr(f"cast((2 * (bytes_before + before) + size) * {shards} div {2 * max(total, 1)} as int)")).alias("shard")))
    placed = written(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
