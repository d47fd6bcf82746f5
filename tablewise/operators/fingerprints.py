"""Fingerprints of tables: what two versions hold is compared before any row is moved.

Every row gets a 128-bit hash, and a bucket keeps the number of its rows and the sums of the hashes' four
words. Sums do not depend on the order or the partitioning of rows, merge in the map tasks, and change
with any value, so equal fingerprints mean equal rows, repeated ones included. A fingerprint is a
table of at most ``BUCKETS`` rows and can be stored next to whatever was derived from the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import col, comparable

BUCKETS = 4_096
_WORD = 0xFFFFFFFF
_SUMS = ("s0", "s1", "s2", "s3")


def bucket_of(df: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> Column:
    """The bucket of each row: by its key, or by all of its values."""
    return F.pmod(F.xxhash64(*[col(k) for k in keys or sorted(df.columns)]), F.lit(buckets)).cast("int")


def fingerprint(df: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, rows, s0, s1, s2, s3)`` of the columns of ``df``; empty buckets are left out.

    One scan; what moves are the sums of each task. Columns are taken in order of their names, so
    moving a column changes nothing. NULL is a value like any other, maps are compared by their entries.
    """
    df = comparable(df)
    names = sorted(df.columns)
    # A hash skips NULLs, so which values are there is hashed as well.
    there = F.concat(*[F.when(col(n).isNull(), "0").otherwise("1") for n in names])
    cells = [col(n) for n in names]
    first, second = F.xxhash64(there, *cells), F.xxhash64(F.lit(1), *reversed(cells), there)
    words = [w for h in (first, second) for w in (h.bitwiseAND(F.lit(_WORD)), F.shiftrightunsigned(h, 32))]
    rows = df.select(bucket_of(df, keys, buckets).alias("bucket"), *[w.alias(s) for w, s in zip(words, _SUMS, strict=True)])
    return rows.groupBy("bucket").agg(F.count("*").alias("rows"), *[F.sum(s).alias(s) for s in _SUMS])


def differing(old: DataFrame, new: DataFrame) -> list[int]:
    """Buckets in which two fingerprints differ; at most ``BUCKETS`` rows of each are looked at."""
    held = [{r["bucket"]: tuple(r)[1:] for r in side.select("bucket", "rows", *_SUMS).collect()} for side in (old, new)]
    return sorted(b for b in held[0].keys() | held[1].keys() if held[0].get(b) != held[1].get(b))
