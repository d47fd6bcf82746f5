"""Distinct counts of all levels against sets held in Python."""

import pytest

from tablewise.operators.distinct import dense_ids, distinct_rollup

SCHEMA = "land string, town string, card string"


def expected(rows):
    groups = {}
    for land, town, card in rows:
        for key in ((land, town, 0), (land, None, 1), (None, None, 3)):
            groups.setdefault(key, set()).add(card)
    return {k: len(v - {None}) for k, v in groups.items() if v - {None}}


def counted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = distinct_rollup(df, ["land", "town"], "card", "cards")
    assert out.columns == ["land", "town", "level", "cards"]
    return {tuple(r)[:3]: r.cards for r in out.collect()}


def test_values_in_several_groups_and_nulls(spark):
    rows = [(f"L{i % 3}", f"T{i % 7}" if i % 5 else None, f"c{i % 50}" if i % 11 else None) for i in range(600)]
    # One value is a third of the rows; a group holds nothing but nulls.
    rows += [(f"L{i % 3}", f"T{i % 7}", "hot") for i in range(300)] + [(None, "T9", None), (None, "T8", "c1")]
    assert counted(spark, rows) == expected(rows)


def test_no_rows_and_no_values(spark):
    assert counted(spark, []) == {}
    assert counted(spark, [("a", "b", None)]) == {}


def test_more_values_than_a_bitmap_holds(spark):
    df = spark.range(100_000).selectExpr("CAST(id % 2 AS string) AS land", "CAST(id % 4 AS string) AS town", "id AS card")
    twice = df.unionByName(df.selectExpr("'x' AS land", "town", "card"))
    found = {tuple(r)[:3]: r.cards for r in distinct_rollup(twice, ["land", "town"], "card", "cards").collect()}
    assert found.pop((None, None, 3)) == 100_000
    assert found.pop(("x", None, 1)) == 100_000 and found.pop(("0", None, 1)) == 50_000
    assert found.pop(("1", None, 1)) == 50_000 and set(found.values()) == {25_000} and len(found) == 8


def test_ids_of_a_group_are_neighbours(spark):
    df = spark.range(40_000).selectExpr("id % 4 AS town", "hash(id) AS card").distinct()
    ids = dense_ids(df, ["town"], "card")
    assert ids.count() == ids.select("id").distinct().count() == df.select("card").distinct().count()
    buckets = df.join(ids, "card").selectExpr("town", "id div 32768 AS bucket").distinct().count()
    assert buckets <= 4 + ids.selectExpr("id div 32768").distinct().count()


@pytest.mark.parametrize("hot", [0, 900])
def test_levels_do_not_read_the_rows_again(spark, hot):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(300 + hot).selectExpr("'a' AS land", "CAST(id % 3 AS string) AS town", "greatest(id, 600) AS card")
    out = distinct_rollup(df.mapInArrow(look, df.schema), ["land", "town"], "card", "cards")
    assert {r.level: r.cards for r in out.collect()}[3] == (1 if not hot else 600)
    assert seen.value == 300 + hot
