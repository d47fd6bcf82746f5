"""Fingerprints of tables: equal rows give equal ones, any other row does not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewise.operators import checks as V
from tablewise.operators import fingerprints as FP


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, None if i % 5 == 0 else f"v{i % 7}", float(i % 3), {"a": i % 2}) for i in range(400)]
    return spark.createDataFrame(rows, "k bigint, s string, x double, m map<string,int>")


def same(a, b, keys=None):
    return FP.differing(FP.fingerprint(a, keys), FP.fingerprint(b, keys)) == []


def test_order_and_partitioning_do_not_matter(table):
    assert same(table, table.repartition(13, "s").select("x", "m", "s", "k").orderBy(F.desc("k")))


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t.withColumn("x", F.when(F.col("k") == 9, 1.5).otherwise(F.col("x"))),
        lambda t: t.withColumn("s", F.coalesce("s", F.lit(""))),
        lambda t: t.withColumn("m", F.when(F.col("k") == 3, F.create_map(F.lit("b"), F.lit(1))).otherwise(F.col("m"))),
        lambda t: t.unionAll(t.filter("k = 1")),
        lambda t: t.unionAll(t),
        lambda t: t.filter("k <> 1"),
        lambda t: t.limit(0),
    ],
    ids=["cell", "null", "map", "a row twice", "all twice", "a row less", "empty"],
)
def test_any_change_shows(table, change):
    assert not same(table, change(table))


def test_nulls_keep_their_column(spark):
    a = spark.createDataFrame([(None, 5)], "p int, q int")
    assert not same(a, a.select(F.col("q").alias("p"), F.col("p").alias("q")))


def test_a_changed_row_shows_in_its_bucket_alone(table):
    new = table.withColumn("x", F.when(F.col("k").isin(9, 10), 7.5).otherwise(F.col("x")))
    found = FP.differing(FP.fingerprint(table, ["k"]), FP.fingerprint(new, ["k"]))
    expected = table.filter("k IN (9, 10)").select(FP.bucket_of(table, ["k"])).distinct().collect()
    assert found == sorted(r[0] for r in expected)


def test_one_changed_cell_fails_the_recheck(spark, table):
    stored = FP.fingerprint(table)
    assert V.recheck_values(table.repartition(3), stored, "t")[1] == "passed"
    edited = table.withColumn("x", F.when(F.col("k") == 200, 0.25).otherwise(F.col("x")))
    assert V.recheck_source(edited, 400, 4, "t")[1] == "passed"  # counts alone do not tell
    assert V.recheck_values(edited, stored, "t")[1] == "failed"
    assert V.recheck_values(None, stored, "t")[1] == "not_run"


def test_equal_versions_move_no_rows(spark, table):
    rows = table.drop("m")
    change = V.table_change(rows, rows.repartition(5), "k")
    plan = change._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Repartition" not in plan  # both sides are known to be empty
    assert tuple(change.first())[2:] == (0, 0, 0)
    assert tuple(V.table_change(rows, rows, None).first())[2:] == (0, 0, 0)


def test_changes_are_counted_as_before(spark, table):
    old = table.drop("m")
    new = old.filter("k >= 10").withColumn("s", F.when(F.col("k") < 30, "new").otherwise(F.col("s")))
    new = new.unionByName(spark.createDataFrame([(1000, "z", 0.0), (None, "z", 0.0)], "k bigint, s string, x double"))
    assert tuple(V.table_change(old, new, "k").first())[2:] == (2, 10, 20)
    assert tuple(V.table_change(old, new, None).first())[2:] == (22, 30, 0)
    with pytest.raises(ValueError, match="repeats"):
        V.table_change(old, new.unionAll(new.filter("k = 1000")), "k")
