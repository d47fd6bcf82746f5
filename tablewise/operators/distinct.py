"""Exact distinct counts that roll up: bitmaps over dense ids, merged from level to level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import col
from tablewise.sources.dataset import materialise


def dense_ids(pairs: DataFrame, labels: list[str], value: str) -> DataFrame:
    """(value, id): a number for each distinct value of ``pairs`` (labels, value), neighbours in a group.

    Values are numbered in the order of their first group, so a group's ids lie in few ranges and its
    bitmaps are dense. Numbers go on from task to task with gaps, which costs a bitmap a task.
    """
    home = pairs.groupBy(col(value)).agg(F.min(F.struct(*[col(c) for c in labels])).alias("home"))
    ordered = home.repartitionByRange("home", col(value)).sortWithinPartitions("home", col(value))
    # Stored, since the numbers depend on how the rows are split.
    return materialise(ordered.select(col(value), F.monotonically_increasing_id().alias("id")))


def distinct_rollup(rows: DataFrame, labels: list[str], value: str, name: str) -> DataFrame:
    """Distinct non-null ``value`` per prefix of ``labels``: (labels, level, name), as ROLLUP groups them.

    ``level`` is the grouping id. The rows are read once. The most detailed level holds a bitmap per group
    and 32768 ids; each further level merges the bitmaps of the one before, so no level sees
    the values again. A group without values has no row.
    """
    pairs = materialise(rows.where(col(value).isNotNull()).select(*[col(c) for c in labels], col(value)).distinct())
    ids = dense_ids(pairs, labels, value).withColumnRenamed(value, "__value")
    numbered = pairs.join(ids, col(value) == F.col("__value"))
    keys = [col(c) for c in labels]
    bits = numbered.groupBy(*keys, F.bitmap_bucket_number("id").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("__bits")
    )
    levels = []
    for dropped in range(len(labels) + 1):
        if dropped:
            bits = bits.groupBy(*keys[: len(labels) - dropped], "__bucket").agg(F.bitmap_or_agg("__bits").alias("__bits"))
        bits = materialise(bits)
        counts = bits.groupBy(*keys[: len(labels) - dropped]).agg(F.sum(F.bitmap_count("__bits")).alias(name))
        if dropped == len(labels):
            counts = counts.where(col(name).isNotNull())
        absent = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in labels[len(labels) - dropped :]]
        level = F.lit((1 << dropped) - 1).cast("bigint").alias("level")
        levels.append(counts.select(*keys[: len(labels) - dropped], *absent, level, col(name)))
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return out
