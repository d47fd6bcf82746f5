"""The flat table stored in turns, and what queries of two versions of it leave on the disks."""

from __future__ import annotations

from pathlib import Path

import pytest

from registry import queries as Q
from registry import tables
from tablewise.sources import dataset
from tests.test_tables import ROWS, folder  # noqa: F401  (a fixture)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """A folder of its own for stored tables, to see what is stored."""
    monkeypatch.setattr(dataset, "scratch_folder", lambda spark: str(tmp_path))
    return tmp_path


@pytest.mark.parametrize(("lines", "most", "turns"), [(2, 8, 4), (1, 3, 3), (7, 8, 1), (100, 8, 1)])
def test_turns_make_the_same_rows(spark, folder, shared, monkeypatch, lines, most, turns):  # noqa: F811
    monkeypatch.setattr(tables, "TURN_LINES", lines)
    monkeypatch.setattr(tables, "MAX_TURNS", most)
    parts = list(tables.flat_turns(spark, folder))
    assert len(parts) == turns
    whole = rows(tables.flat_sales(spark, folder))
    assert sorted(r for p in parts for r in rows(p)) == whole and len(whole) > 2
    flat = dataset.materialise_parts(iter(parts), codec="zstd")
    assert rows(flat) == whole and len(list(shared.iterdir())) == 1
    assert rows(tables.with_defects(flat)) == rows(tables.dirty_sales(spark, folder))


def test_turns_of_no_lines_and_of_one_order(spark, folder, monkeypatch, tmp_path):  # noqa: F811
    monkeypatch.setattr(tables, "TURN_LINES", 1)
    for name in ROWS:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.where("l_orderkey = 1") if name == "lineitem" else df).write.parquet(f"{tmp_path}/one/{name}.parquet")
        (df.limit(0) if name == "lineitem" else df).coalesce(1).write.parquet(f"{tmp_path}/none/{name}.parquet")
    one = [r for p in tables.flat_turns(spark, f"{tmp_path}/one") for r in rows(p)]
    assert sorted(one) == rows(tables.flat_sales(spark, f"{tmp_path}/one")) and one
    assert [rows(p) for p in tables.flat_turns(spark, f"{tmp_path}/none")] == [[]]


def test_stored_results_keeps_the_lines_once(spark, folder, shared):  # noqa: F811
    found = {(r["version"], r["check"]): r["status"] for r in Q.QUERIES["stored_results"](spark, folder).collect()}
    assert len(found) == 12 and found["own", "profile_missing_total"] == "passed"
    wide = [d for d in Path(shared).iterdir() if len(spark.read.parquet(str(d)).columns) >= len(tables.FLAT)]
    assert len(wide) == 1
