from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tablewise.operators import checks as V
from tablewise.operators import metrics as M
from tablewise.operators import profile as P
from tablewise.plans.star import design_star, validate_star
from tests.test_star import LOANS, loans


@pytest.fixture(scope="module")
def designed(spark):
    df = spark.createDataFrame(loans(), LOANS)
    star = design_star(df, P.profile_table(df, "loans"))
    return star, {n: t.cache() for n, t in star.tables.items()}


def failed(found):
    return {(r["check"], r["object"]) for r in found.filter("status = 'failed'").collect()}


def test_key_pair(spark):
    fact = spark.createDataFrame([("a",), ("b",), ("z",), ("z",), (None,)], "k string")
    dim = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    row = V.key_pair(fact, "k", dim, "k").first()
    assert row["type_compatible"] and not row["to_side_unique"]
    assert (row["orphan_rows"], list(row["orphan_examples"]), row["null_from_rows"]) == (2, ["z"], 1)
    assert not row["ok"]
    other = V.key_pair(spark.createDataFrame([(1,)], "k int"), "k", dim, "k").first()
    assert not other["type_compatible"] and other["orphan_rows"] == 0
    good = V.key_pair(fact.filter("k = 'a'"), "k", dim.distinct(), "k").first()
    assert good["ok"]


def test_missing_key_on_the_one_side(spark):
    dim = spark.createDataFrame([("a",), (None,)], "k string")
    row = V.key_pair(dim.filter("k = 'a'"), "k", dim, "k").first()
    assert row["to_side_unique"] and row["to_side_nulls"] == 1 and not row["ok"]


def test_referential_integrity(spark):
    fact = spark.createDataFrame([(1,), (2,), (2,), (None,)], "f bigint")
    dim = spark.createDataFrame([(1,)], "d bigint")
    row = V.referential_integrity(fact, "f", dim, "d").first()
    assert (row["status"], row["message"]) == ("failed", "2 orphan rows; e.g. ['2']")
    assert V.referential_integrity(fact.filter("f = 1"), "f", dim, "d").first()["status"] == "passed"


def test_clean_star_passes(designed):
    star, tables = designed
    found = validate_star(star, tables, 120)
    assert failed(found) == set()
    row = V.report(found).first()
    assert row["passed"] and row["not_run"] == 0


def test_dropped_dimension_row_makes_orphans(designed):
    star, tables = designed
    broken = tables | {"DimBook": tables["DimBook"].filter("BookID <> 'B0'")}
    found = validate_star(star, broken, 120)
    link = "FactLoans[BookID] -> DimBook[BookID]"
    assert failed(found) == {("no_orphan_keys", link)}
    assert not V.report(found).first()["passed"]


def test_duplicate_key(designed):
    star, tables = designed
    twice = tables["DimBook"].unionAll(tables["DimBook"].limit(1))
    found = failed(validate_star(star, tables | {"DimBook": twice}, 120))
    assert ("key_unique_not_null", "DimBook[BookID]") in found
    assert ("cardinality_matches_data", "FactLoans[BookID] -> DimBook[BookID]") in found


def test_calendar_gap_and_coverage(designed):
    star, tables = designed
    gap = tables["DimDate"].filter("Date <> DATE'2023-06-15'")
    assert ("date_table_contiguous", "DimDate") in failed(validate_star(star, tables | {"DimDate": gap}, 120))
    short = tables["DimDate"].filter("Date >= DATE'2023-12-01'")
    found = failed(validate_star(star, tables | {"DimDate": short}, 120))
    assert ("date_table_covers_facts", "FactLoans[Lent] -> DimDate[Date]") in found
    assert ("date_table_contiguous", "DimDate") not in found
    empty = tables["DimDate"].filter("Date IS NULL")
    assert ("date_table_key", "DimDate") in failed(validate_star(star, tables | {"DimDate": empty}, 120))


def test_changed_columns_rows_and_missing_tables(designed):
    star, tables = designed
    odd = tables["FactLoans"].withColumn("Fee", F.col("Fee").cast("string")).limit(80)
    found = failed(validate_star(star, tables | {"FactLoans": odd}, 120))
    assert ("columns_match_data", "FactLoans") in found
    assert ("fact_rows_match_source", "FactLoans") in found
    some = {n: t for n, t in tables.items() if n != "DimReader"}
    report = validate_star(star, some, 120)
    assert ("table_data_present", "DimReader") in failed(report)
    assert report.filter("status = 'not_run'").count() == 1


def test_blank_foreign_keys_only_warn(spark):
    df = spark.createDataFrame([r[:4] + (None,) + r[5:] if i == 9 else r for i, r in enumerate(loans())], LOANS)
    star = design_star(df, P.profile_table(df, "loans"))
    found = validate_star(star, star.tables, 120)
    row = V.report(found).first()
    assert row["passed"] and row["failed_warnings"] == 1


def test_cross_check_catches_an_edited_sum(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (None, 1e30)], "Quantity bigint, Amount double")
    stats = M.measure_stats(P.profile_table(df))
    assert V.cross_check(df, stats).filter("status = 'passed'").count() == 2
    edited = stats.withColumn("sum", F.when(F.col("column") == "Quantity", 4.0).otherwise(F.col("sum")))
    bad = V.cross_check(df, edited).filter("status = 'failed'").collect()
    assert [r["object"] for r in bad] == ["metrics:Quantity"]
    renamed = stats.withColumn("column", F.lit("gone"))
    assert V.cross_check(df, renamed).first()["check"] == "metrics_columns_exist"


def test_stored_results(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    profile, totals = P.profile_columns(df), P.table_totals(df)
    schema = profile.select("ordinal", "column")
    good = V.stored_result_findings(profile, totals, schema, 2, 2)
    assert failed(good) == set() and good.count() == 6
    edited = profile.withColumn("null_count", F.lit(5).cast("bigint"))
    found = {c for c, _ in failed(V.stored_result_findings(edited, totals, schema.limit(1), 3, 2))}
    assert found == {
        "profile_missing_total", "null_counts_within_rows", "schema_matches_profile", "quality_matches_profile",
    }


def test_source_recheck(spark):
    df = spark.range(3)
    assert V.recheck_source(df, 3, 1, "t")[1] == "passed"
    assert V.recheck_source(df, 4, 1, "t")[1] == "failed"
    assert V.recheck_source(None, 4, 1, "t")[1] == "not_run"


def test_table_change(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k int, v string, w double")
    new = spark.createDataFrame([(2, "b", None), (3, "C", 3.0), (4, "d", 4.0)], "k int, v string, w double")
    row = V.table_change(old, new.withColumn("x", F.lit(1)).drop("w"), "k").first()
    assert (list(row["columns_added"]), list(row["columns_removed"])) == (["x"], ["w"])
    assert (row["rows_added"], row["rows_removed"], row["rows_changed"]) == (1, 1, 1)
    row = V.table_change(old, new, None).first()
    assert (row["rows_added"], row["rows_removed"]) == (2, 2)
    same = V.table_change(old, old, "k").first()
    assert (same["rows_added"], same["rows_removed"], same["rows_changed"]) == (0, 0, 0)
