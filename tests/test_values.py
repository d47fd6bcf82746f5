"""Values that are easily mistaken: two zeros, NaN, NULL keys, maps, one name in two tables."""

from __future__ import annotations

import pytest

from tablewise.operators.checks import table_change
from tablewise.operators.dependencies import determines
from tablewise.operators.metrics import correlations
from tablewise.plans.semantic import _labels


def test_both_zeros_are_one_parent(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", -0.0), ("b", 1.0)], "child string, parent double")
    assert determines(df, "child", "parent")
    assert not determines(df.union(spark.createDataFrame([("a", 2.0)], df.schema)), "child", "parent")


def test_a_row_with_nan_counts_and_leaves_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, float("nan")), (4.0, None)], "a double, b double")
    row = correlations(df, ["a", "b"]).first()
    assert (row.n, row.r) == (3, None)


def test_changes_by_key_know_nulls_and_maps(spark):
    schema = "k string, m map<string,int>"
    old = spark.createDataFrame([("a", {"x": 1, "y": 2}), (None, {"x": 1}), ("gone", None)], schema)
    new = spark.createDataFrame([("a", {"y": 2, "x": 1}), (None, {"x": 2}), ("new", None)], schema)
    row = table_change(old, new, "k").first()
    assert (row.rows_added, row.rows_removed, row.rows_changed) == (1, 1, 1)
    with pytest.raises(ValueError, match="repeats"):
        table_change(old.union(old), new, "k")
    assert table_change(old, old, None).first().rows_added == 0


def test_fields_of_one_name_keep_their_tables():
    assert _labels([("DA", "Name"), ("DB", "name"), ("DA", "Size")]) == ["DA[Name]", "DB[name]", "Size"]
    assert _labels([("DA", "Name")]) == ["Name"]


def test_workbook_headers_keep_every_column():
    from tablewise.sources.workbook import _unique

    assert _unique({0: "amt", 1: "amt", 3: "AMT", 4: "x"}) == {0: "amt", 1: "amt_2", 3: "AMT_3", 4: "x"}
