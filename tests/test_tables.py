"""The flat sales table and the star over it: what moves, and the same rows whichever way suppliers are joined."""

from __future__ import annotations

from datetime import datetime

import pytest

from registry import queries as Q
from registry import tables

ROWS = {
    "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey long, r_name string"),
    "nation": ([(0, "INDIA", 0), (1, "FRANCE", 1), (2, "NOWHERE", None)], "n_nationkey long, n_name string, n_regionkey long"),
    "customer": (
        [(1, "c1", 0, 1.0, "TOYS"), (2, "c2", 1, 2.0, None), (2, "c2 again", 1, 2.0, "TOYS"), (3, "c3", 2, 3.0, "TOYS")],
        "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string",
    ),
    "supplier": ([(1, "s1", 0, 1.0), (None, "s?", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
    "part": (
        [(1, "bolt", "b1", "SMALL", 1, 10.0), (2, None, "b2", "LARGE", 2, 20.0)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    ),
    "orders": (
        [(k, c, "O", 5.0, datetime(1996, 1, k), "1-HIGH") for k, c in ((1, 1), (2, 2), (3, 3), (4, None))],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    ),
    "lineitem": (
        [
            (o, p, s, n, 2.0, 30.0, 0.1, 0.0, "N", "O", datetime(1996, 2, n))
            for n, (o, p, s) in enumerate([(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 1, 1), (1, 1, None), (None, 1, 1)], 1)
        ],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales"))
    for name, (rows, schema) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_lines_move_without_the_columns_of_customers(spark, folder, monkeypatch, limit):
    monkeypatch.setattr(tables, "BROADCAST_BYTES", limit)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flat = tables.flat_sales(spark, folder)
        text = plan(flat)
        found = sorted((r["OrderID"], r["OrderLine"], r["CustomerName"], r["ProductName"] or "", r["Region"]) for r in flat.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # A line is dealt by its product and its order (and its supplier, if there are many), never by customer after that.
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(l_partkey" in text
    assert ("hashpartitioning(l_suppkey" in text) == (limit == 0)
    customers = text.index("hashpartitioning(o_custkey")
    assert "l_linenumber" not in text[customers : customers + 2000].split("Scan parquet")[1]
    assert found == [
        (1, 1, "c1", "bolt", "ASIA"), (1, 2, "c1", "", "ASIA"),
        (2, 3, "c2", "", "EUROPE"), (2, 3, "c2 again", "", "EUROPE"),
    ]


def test_lines_that_outnumber_products_move_for_their_order_alone(spark, folder, tmp_path):
    many = str(tmp_path)
    for name in ROWS:
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        times = 100 if name == "lineitem" else 1
        rows.crossJoin(spark.range(times).withColumnRenamed("id", "again")).drop("again").coalesce(1).write.parquet(f"{many}/{name}.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flat = tables.flat_sales(spark, many)
        text, found = plan(flat), flat.groupBy("OrderID", "OrderLine", "CustomerName", "ProductName").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(l_partkey" not in text
    assert sorted((r[0], r[1], r[2], r[3] or "", r[4]) for r in found) == [
        (1, 1, "c1", "bolt", 100), (1, 2, "c1", "", 100), (2, 3, "c2", "", 100), (2, 3, "c2 again", "", 100),
    ]


def test_fd_agreement_stores_no_column_that_it_does_not_compare(spark, folder, monkeypatch):
    seen = []
    store = Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df: seen.append(df.columns) or store(df))
    assert Q.fd_agreement(spark, folder).count()
    assert seen == [[*Q.KEYS, *Q.ATTRIBUTES]]


def test_a_question_reads_the_stored_fact_and_joins_no_order(spark, folder):
    text = plan(Q._star(spark, folder).tables["FactSales"])
    assert "Join" not in text and "tablewise-" in text


def test_versions_without_a_key_are_stored_before_they_are_compared(spark, folder, monkeypatch):
    seen = []
    change = Q.V.table_change
    monkeypatch.setattr(Q.V, "table_change", lambda old, new, key: seen.extend([old, new]) or change(old, new, key))
    assert Q.fact_change(spark, folder).first()["rows_added"] >= 0
    assert len(seen) == 2 and not any("Join" in plan(v) for v in seen)
