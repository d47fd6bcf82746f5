"""Questions to a star against plain Python, with dimensions joined before and after grouping."""

from __future__ import annotations

import random

import pytest

from tablewise.plans import semantic as S
from tablewise.plans.semantic import Measure, hierarchy_rollup, measure_by, visual_query
from tablewise.plans.star import Relationship, StarDesign

TRIPS = Measure("trips", "count")
FARE = Measure("fare", "sum", "Fare")
DRIVERS = Measure("drivers", "distinct_count", "DriverID")
CARS = Measure("cars", "distinct_count", "Car")
COST = Measure("cost", "sum", "Cost")
ALL = [TRIPS, FARE, DRIVERS, CARS, COST, Measure("least", "min", "Fare"), Measure("mean", "average", "Fare"),
       Measure("gain", "difference", of=("fare", "cost")), Measure("share", "ratio", of=("gain", "fare"))]


@pytest.fixture(scope="module")
def facts():
    pick = random.Random(6)
    stops = {i: (f"stop {i}", f"line {i % 4}", "north" if i % 4 < 2 else "south") for i in range(15)}
    rows = [
        (pick.choice([None, 3, 99, *range(15)]) if i % 3 else 3, pick.randrange(6), pick.randrange(40), pick.choice(["a", "b", None]),
         float(pick.randrange(1, 90)), float(pick.randrange(30)))
        for i in range(1200)
    ]
    return rows, stops, {i: ("day", "night")[i % 2] for i in range(5)}


@pytest.fixture(params=[32 << 20, 0], ids=["before", "after"])
def star(spark, facts, request, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_BYTES", request.param)
    rows, stops, shifts = facts
    design = StarDesign("FactTrips")
    design.tables = {
        "FactTrips": spark.createDataFrame(rows, "StopID bigint, ShiftID bigint, DriverID bigint, Car string, Fare double, Cost double"),
        "DimStop": spark.createDataFrame([(k, *v) for k, v in stops.items()], "StopID bigint, Stop string, Line string, Part string"),
        "DimShift": spark.createDataFrame(list(shifts.items()), "ShiftID bigint, Shift string"),
    }
    design.relationships = [
        Relationship("FactTrips", "StopID", "DimStop", "StopID"), Relationship("FactTrips", "ShiftID", "DimShift", "ShiftID"),
    ]
    return design


def answered(rows):
    fares, costs = [r[4] for r in rows], sum(r[5] for r in rows)
    gain = sum(fares) - costs
    return (
        len(rows), sum(fares), len({r[2] for r in rows}), len({r[3] for r in rows} - {None}), costs, min(fares),
        pytest.approx(sum(fares) / len(rows)), gain, pytest.approx(gain / sum(fares)),
    )


def grouped(rows, key):
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    return {k: answered(v) for k, v in groups.items()}


def test_measures_by_attributes_of_two_dimensions(star, facts):
    rows, stops, shifts = facts
    found = measure_by(star, ALL, ["DimStop[Line]", "DimShift[Shift]", "FactTrips[Car]"]).collect()
    expected = grouped(rows, lambda r: (stops.get(r[0], (None, None))[1], shifts.get(r[1]), r[3]))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == expected


def test_filters_of_both_sides(star, facts):
    rows, stops, shifts = facts
    found = visual_query(
        star, ["DimStop[Stop]"], ALL, legend="DimShift[Shift]",
        filters=[{"DimStop[Part]": ["north", "south"]}, {"DimStop[Part]": ["north"], "FactTrips[Car]": ["a"]}, {"DimShift[Shift]": []}],
    ).collect()
    own = [r for r in rows if stops.get(r[0], (0, 0, 0))[2] == "north" and r[3] == "a"]
    expected = grouped(own, lambda r: (stops[r[0]][0], shifts.get(r[1])))
    assert {tuple(r)[:2]: tuple(r)[2:] for r in found} == expected


def test_a_filter_on_a_dimension_that_is_not_shown(star, facts):
    rows, stops, _ = facts
    found = measure_by(star, [TRIPS, DRIVERS], filters={"DimStop[Line]": ["line 1", "none"]}).collect()
    own = [r for r in rows if stops.get(r[0], (0, 0))[1] == "line 1"]
    assert [tuple(r) for r in found] == [(len(own), len({r[2] for r in own}))]


def test_levels_of_a_hierarchy(star, facts):
    rows, stops, _ = facts
    found = {tuple(r)[:3]: tuple(r)[3:] for r in hierarchy_rollup(star, [TRIPS, DRIVERS, CARS], "DimStop", ["Part", "Line"]).collect()}
    part, line = (lambda r: stops.get(r[0], (None,) * 3)[2]), (lambda r: stops.get(r[0], (None,) * 3)[1])
    for level, key in ((0, lambda r: (part(r), line(r), 0)), (1, lambda r: (part(r), None, 1)), (3, lambda r: (None, None, 3))):
        for k, v in grouped(rows, key).items():
            assert found.pop(k) == (v[0], v[2], v[3]), level
    assert not found


def test_a_filter_cuts_the_fact_before_it_is_moved(star):
    plan = measure_by(star, [FARE, DRIVERS], ["DimShift[Shift]"], {"DimStop[Part]": ["north"]})._jdf.queryExecution().executedPlan().toString()
    if S.BROADCAST_BYTES:
        # The plan is printed from the last step to the first: nothing is exchanged below the joins but dimensions.
        below = plan[plan.rindex("BroadcastHashJoin") :]
        assert "hashpartitioning" not in below
        assert plan.count("BroadcastHashJoin") >= 2
    assert plan.count("DriverID#") and plan.count("Scan ExistingRDD[StopID") <= 2


def test_unknown_tables_and_aggregates(star):
    with pytest.raises(ValueError, match="no relationship"):
        measure_by(star, [TRIPS], ["DimCar[Name]"])
    with pytest.raises(ValueError, match="unknown aggregate"):
        Measure("x", "median", "Fare")
    with pytest.raises(ValueError, match="expected Table"):
        measure_by(star, [TRIPS], ["Shift"])


def test_values_are_told_apart_once(star):
    text = measure_by(star, [FARE, TRIPS, DRIVERS], ["DimStop[Line]"])._jdf.queryExecution().optimizedPlan().toString()
    # Groups by joined attributes hold each value once; those by keys that are joined later may share values.
    assert ("distinct" in text) == (S.BROADCAST_BYTES == 0)
