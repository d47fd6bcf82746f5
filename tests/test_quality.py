"""Quality checks on small tables, and the number of passes that they take together."""

from __future__ import annotations

import json

import pytest

from tablewise.operators import quality as Q
from tablewise.operators.profile import profile_table


def audited(df, checks=None):
    """The issues of a table by (kind, column)."""
    found = Q.check_quality(df, profile_table(df, "stock"), checks).orderBy("position").collect()
    return {(r["kind"], r["column"]): r for r in found}


def single(spark, values, name, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")


@pytest.fixture(scope="module")
def stock(spark):
    """A warehouse with one defect of each kind; every number below follows from these rules."""
    rows = []
    for i in range(200):
        place = ["Bern", "Genf", "Chur", "Sion"][i % 4]
        rows.append(
            (
                None if i % 50 == 7 else f"A{i % 60}",
                f"  {place.upper()}" if i % 40 == 8 else place,
                "\t " if i % 25 == 3 else f"note {i}",
                "kg",
                -1.0 - i if i in (11, 31) else 5_000.0 if i == 90 else 10.0 + i % 9,
                "unknown" if i == 5 else f"{i},250.5",
                f"2024/03/{1 + i % 28:02d}",
            )
        )
    rows += [rows[0], rows[0], rows[1]]
    names = "ArticleID string, Place string, Remark string, Unit string, Weight double, Price string, Counted string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def issues(stock):
    return audited(stock)


def test_an_empty_key_is_an_error(issues):
    found = issues["missing_values", "ArticleID"]
    assert (found["severity"], found["affected_rows"]) == ("error", 4)
    assert found["description"] == "ArticleID is empty in 4 rows, 2.0% of all. As a key it leads these rows nowhere."


def test_an_empty_attribute_is_a_warning(spark):
    df = single(spark, ["x", None, "y", "x"], "Shelf")
    assert audited(df)["missing_values", "Shelf"]["severity"] == "warning"


def test_repeated_rows(issues):
    found = issues["duplicate_rows", None]
    assert found["affected_rows"] == 3
    assert [json.loads(e)["ArticleID"] for e in found["examples"]] == ["A0", "A1"]


def test_spellings_of_a_category(issues):
    found = issues["inconsistent_categories", "Place"]
    assert found["affected_rows"] == 5
    assert [json.loads(e) for e in found["examples"]] == [{"canonical": "Bern", "variants": ["  BERN"]}]


def test_no_break_spaces_are_blanks(spark):
    df = single(spark, ["Old Town"] * 3 + ["Old\u00a0Town", "old  town\u2003"], "Place")
    assert audited(df)["inconsistent_categories", "Place"]["affected_rows"] == 2


def test_blank_texts_and_constants(issues):
    assert issues["blank_strings", "Remark"]["affected_rows"] == 8
    assert issues["constant_column", "Unit"]["description"] == "Unit is 'kg' wherever it is filled."


def test_values_far_out(issues):
    found = issues["outliers", "Weight"]
    # Quartiles 12 and 16 put the fences at 0 and 28.
    assert (found["affected_rows"], found["examples"]) == (3, ["5000.0", "-12.0", "-32.0"])
    assert "beyond 0.00 to 28.00" in found["description"]


@pytest.mark.parametrize(
    "values", [[3.0, 4.0, 5.0, 1e12], [8.0] * 50 + [9.0], [float("nan")] * 3 + [1.0] * 30], ids=["few", "flat", "nan"]
)
def test_no_fences_without_a_spread(spark, values):
    assert ("outliers", "Weight") not in audited(single(spark, values, "Weight", "double"))


def test_values_below_zero(issues, spark):
    assert issues["negative_values", "Weight"]["examples"] == ["-32.0", "-12.0"]
    df = single(spark, [4, -2, -2, -7, 0, 3], "Stocked", "int")
    assert audited(df)["negative_values", "Stocked"]["examples"] == ["-7.0", "-2.0", "-2.0"]


def test_numbers_and_dates_held_as_texts(issues):
    price, counted = issues["type_mismatch", "Price"], issues["type_mismatch", "Counted"]
    assert (price["affected_rows"], price["examples"]) == (1, ["unknown"])
    assert "numbers" in price["description"] and "dates" in counted["description"]
    assert (counted["affected_rows"], counted["examples"]) == (0, [])


@pytest.mark.parametrize("shape", ["2023-11-{:02d}", "{:02d}-11-2023", "{:02d}/11/2023", "{:02d}.11.2023", "202311{:02d}"])
def test_every_date_format(spark, shape):
    df = single(spark, [shape.format(d) for d in range(1, 31)], "Sent")
    found = audited(df)["type_mismatch", "Sent"]
    # Eight digits are a number as well, and numbers come first.
    assert ("numbers" if shape.startswith("2023") and "-" not in shape else "dates") in found["description"]


def test_suffixes_of_literals_are_no_numbers(spark):
    assert ("type_mismatch", "Price") not in audited(single(spark, ["7.5f", "2L", "1e3d"] * 9, "Price"))


def test_a_sound_table_passes(spark):
    df = spark.createDataFrame([("Bern", 3.5), ("Chur", 4.5)], "Place string, Weight double")
    found = Q.check_quality(df, profile_table(df))
    assert found.count() == 0 and Q.quality_summary(found).first()["passed"] is True


def test_order_of_issues(stock, issues):
    weight = {"error": 0, "warning": 1, "info": 2}
    listed = [(weight[r["severity"]], -r["affected_rows"]) for r in issues.values()]
    assert listed == sorted(listed) and listed[0][0] == 0
    assert Q.quality_summary(Q.check_quality(stock, profile_table(stock))).first()["passed"] is False


def test_own_checks_run_beside_the_declared_ones(stock):
    class Heavy(Q.CountedCheck):
        name = "heavy"

        def sums(self, profile):
            return {"n": (["Weight"], Q.counts.cell_number() > 100)}

        def rows(self, profile, totals, examples):
            return [("heavy", Q.INFO, "Weight", totals["n"]["Weight"], "too heavy", [])]

    own = lambda df, profile: Q._issues(df, [("rows", Q.INFO, None, df.count(), "all", [])])
    found = audited(stock, {"heavy": Heavy(), "rows": own, "blank": Q.blank_strings})
    assert {k: r["affected_rows"] for k, r in found.items()} == {
        ("heavy", "Weight"): 1, ("rows", None): 203, ("blank_strings", "Remark"): 8,
    }


def test_all_checks_take_few_jobs_and_do_not_read_the_source(spark, stock):
    profile = profile_table(stock, medians=False)
    profile.duplicate_rows  # noqa: B018  (found once, kept by the profile)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("audit", "audit")
    gone = stock.select(*[Q.F.raise_error(Q.F.lit("read again")).cast(f.dataType).alias(f.name) for f in stock.schema.fields])
    assert Q.check_quality(gone, profile).count() == 9
    jobs = len(tracker.getJobIdsForGroup("audit"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 30, jobs
