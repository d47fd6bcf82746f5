"""Registered queries against their SQL twins, on the smallest tables."""

from __future__ import annotations

import math

import pytest

from registry.oracles import ORACLES
from registry.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = (
    "region nation customer supplier part orders lineitem events documents pages labels conversations"
)
# The whole comparison takes minutes; these cover each family of operators.
COMPARED = [
    "profile_columns",
    "top_values",
    "duplicate_groups",
    "category_variants",
    "peak_low",
    "breakdown_customer",
    "correlations",
    "dim_customer",
    "conflicts",
    "calendar",
    "star_change",
    "key_pair",
    "star_measures",
    "hierarchy_rollup_geo",
    "hierarchy_rollup_distinct",
    "visual",
    "redact_documents",
    "escaped_text",
    "csv_ingest",
    "xlsx_ingest",
]


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def _text(value: object) -> str:
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(round(value, 6))
    return "NULL" if value is None else str(value)


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_its_twin(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    order = sorted(df.columns)
    ours = sorted(tuple(_text(r[c]) for c in order) for r in df.collect())
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    theirs = sorted(tuple(_text(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert ours == theirs
