"""What is sent to the driver: tables whose files say little of their size are not broadcast."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tablewise.llm import common
from tablewise.llm.jaccard_join import _tiles, stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def cells(spark, n):
    """One cell of ``n`` sets that all ask, as regions of near copies make them."""
    rows = spark.range(n).select(F.lit(7).cast("long").alias("pivot"), F.lit(9).cast("long").alias("p"), (F.col("id") % 50).alias("k"))
    return rows.withColumns({"asks": F.lit(True), "asking": F.lit(1).cast("long"), "all": F.lit(1).cast("long")})


def test_a_table_that_its_files_make_small_is_joined_by_sorting(spark):
    tiles = stored(_tiles(cells(spark, 100_000)), "tiles")
    folder = tiles.stored_in.removeprefix("file://")
    size = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))
    assert tiles.count() == 200_000 and size < 1 << 20  # 8 MB of values
    other = stored(spark.range(1_000_000).withColumnRenamed("id", "k"), "other")
    for one in (tiles, tiles.where("side = 1").select("k"), tiles.groupBy("g1", "k").agg(F.count("*"))):
        assert "BroadcastHashJoin" not in plan(other.join(one, "k")), one.columns
    assert other.join(tiles, "k").count() == 200_000
    common.dropped(tiles, other)
    assert not os.path.exists(folder)


def test_small_and_empty_tables_may_be_broadcast(spark):
    other = spark.range(1_000_000).withColumnRenamed("id", "k")
    for rows in (0, 50):
        tiles = stored(_tiles(cells(spark, rows)), "tiles")
        assert "BroadcastHashJoin" in plan(other.join(tiles, "k"))
        assert other.join(tiles, "k").count() == 2 * rows


def test_nulls_count_as_empty(spark):
    df = spark.createDataFrame([(None, None, None), (1, "text", b"bytes")], "k long, text string, sig binary")
    out = stored(df, "odd")
    assert sorted(out.collect(), key=str) == sorted(df.collect(), key=str)
