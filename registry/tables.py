"""The flat sales table every operator works on, in Spark and in plain SQL.

``flat`` has one row per order line, joined to its order, customer, product and supplier.
``dirty`` is ``flat`` with defects planted by arithmetic that is equal in both engines.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.columns import BROADCAST_BYTES, byte_size
from tablewise.sources.dataset import spread

INTEGERS = ["OrderID", "OrderLine", "CustomerID", "ProductID", "SupplierID"]
DATES = ["OrderDate", "ShipDate"]
NUMBERS = ["Quantity", "Revenue", "Cost", "UnitPrice", "DiscountRate"]
FLAT = [
    "OrderID", "OrderLine", "OrderDate", "ShipDate", "CustomerID", "CustomerName", "Segment",
    "Nation", "Region", "ProductID", "ProductName", "Brand", "ProductType", "SupplierID",
    "SupplierName", "Priority", "OrderStatus", "ReturnFlag", "Quantity", "Revenue", "Cost",
    "UnitPrice", "DiscountRate",
]
DIRTY = [*FLAT, "WeightText", "Currency"]
#: Lines of a turn in which the flat table is made where disks are short, and turns at most.
TURN_LINES, MAX_TURNS = 2_000_000, 8
TEXTS = [c for c in DIRTY if c not in (*INTEGERS, *DATES, *NUMBERS)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read(spark, sf_dir, name))


def flat_turns(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The flat table in parts of about ``TURN_LINES`` lines, by a hash of the order, ``MAX_TURNS`` at most.

    What a part moves is all that the disks must hold if one is stored after the other; each reads the tables again.
    """
    turns = max(1, min(MAX_TURNS, -(-read(spark, sf_dir, "lineitem").count() // TURN_LINES)))
    for turn in range(turns):
        yield flat_sales(spark, sf_dir, turn, turns)


def flat_sales(spark: SparkSession, sf_dir: str, turn: int = 0, turns: int = 1) -> DataFrame:
    """Order lines with all that belongs to them, or those of one of some turns.

    Customers join the orders, of which there are fewer than lines, so lines move once for their product and once for
    their order and never with a customer's columns. Suppliers are broadcast if they are counted to be small; they come
    last then and first if not, since the lines are narrowest there. So are products, if lines outnumber the copies of
    them that all cores would read; lines move for their order alone then. The rest is left to Catalyst.
    """
    t = {
        n: read(spark, sf_dir, n)
        for n in ("orders", "customer", "part", "supplier", "nation", "region")
    }
    lines = read(spark, sf_dir, "lineitem")
    if turns > 1:

        def own(key: str) -> Column:
            return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(turns)) == turn

        lines, t["orders"] = lines.where(own("l_orderkey")), t["orders"].where(own("o_orderkey"))
    lines = spread(lines)
    customers = (
        t["customer"]
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    orders = t["orders"].join(customers, F.col("o_custkey") == F.col("c_custkey"))
    suppliers = t["supplier"].select("s_suppkey", "s_name")
    products = t["part"].select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    copies = products.count() * spark.sparkContext.defaultParallelism
    sides = [
        (suppliers, F.col("l_suppkey") == F.col("s_suppkey"), byte_size(suppliers) <= BROADCAST_BYTES),
        (
            products,
            F.col("l_partkey") == F.col("p_partkey"),
            copies < read(spark, sf_dir, "lineitem").count() and byte_size(products) <= BROADCAST_BYTES,
        ),
    ]
    joined = lines
    for side, own, small in sides:
        if not small:
            joined = joined.join(side, own)
    joined = joined.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    for side, own, small in sides:
        if small:
            joined = joined.join(F.broadcast(side), own)
    return joined.select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("l_linenumber").cast("bigint").alias("OrderLine"),
        F.col("o_orderdate").cast("date").alias("OrderDate"),
        F.col("l_shipdate").cast("date").alias("ShipDate"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("c_name").alias("CustomerName"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("n_name").alias("Nation"),
        F.col("r_name").alias("Region"),
        F.col("l_partkey").alias("ProductID"),
        F.col("p_name").alias("ProductName"),
        F.col("p_brand").alias("Brand"),
        F.col("p_type").alias("ProductType"),
        F.col("l_suppkey").alias("SupplierID"),
        F.col("s_name").alias("SupplierName"),
        F.col("o_orderpriority").alias("Priority"),
        F.col("o_orderstatus").alias("OrderStatus"),
        F.col("l_returnflag").alias("ReturnFlag"),
        F.col("l_quantity").alias("Quantity"),
        F.col("l_extendedprice").alias("Revenue"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("Cost"),
        F.try_divide("l_extendedprice", "l_quantity").alias("UnitPrice"),
        F.col("l_discount").alias("DiscountRate"),
    )


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defects(flat_sales(spark, sf_dir))


def with_defects(flat: DataFrame) -> DataFrame:
    """``dirty`` from the flat table: each row by itself, so over a stored one it needs no disk of its own."""
    order, even = F.col("OrderID"), F.col("OrderLine") % 2 == 0
    spaced = F.concat(F.lit(" "), F.lower("ProductType"), F.lit("  "))
    revenue = F.col("Revenue")
    changed = {
        "CustomerID": F.when(order % 97 != 0, F.col("CustomerID")),
        "ProductType": F.when(order % 211 == 1, spaced).otherwise(F.col("ProductType")),
        "Brand": F.when((order % 53 == 0) & (F.col("OrderLine") == 1), "Unknown").otherwise(
            F.col("Brand")
        ),
        "Segment": F.when(order % 13 == 0, F.when(even, "ZZ").otherwise("YY")).otherwise(
            F.col("Segment")
        ),
        "Priority": F.when(order % 101 == 0, "   ").otherwise(F.col("Priority")),
        "Revenue": F.when(order % 307 == 0, -revenue)
        .when(order % 503 == 0, revenue * 100)
        .otherwise(revenue),
        "WeightText": F.when(order % 89 == 0, "n/a").otherwise(
            F.concat(F.col("OrderLine").cast("string"), F.lit(".5"))
        ),
        "Currency": F.lit("EUR"),
    }
    once = flat.withColumns(changed)
    # Planted copies come from the same rows, so the joins above run once.
    copies = F.explode(F.when(order % 499 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return once.select("*", copies.alias("copy")).drop("copy")


FLAT_SQL = """
flat AS MATERIALIZED (
  SELECT l_orderkey AS OrderID, CAST(l_linenumber AS BIGINT) AS OrderLine,
    CAST(o_orderdate AS DATE) AS OrderDate, CAST(l_shipdate AS DATE) AS ShipDate,
    o_custkey AS CustomerID, c_name AS CustomerName, c_mktsegment AS Segment,
    n_name AS Nation, r_name AS Region, l_partkey AS ProductID, p_name AS ProductName,
    p_brand AS Brand, p_type AS ProductType, l_suppkey AS SupplierID, s_name AS SupplierName,
    o_orderpriority AS Priority, o_orderstatus AS OrderStatus, l_returnflag AS ReturnFlag,
    l_quantity AS Quantity, l_extendedprice AS Revenue, l_quantity * p_retailprice AS Cost,
    CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS UnitPrice,
    l_discount AS DiscountRate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

DIRTY_SQL = (
    FLAT_SQL
    + """,
once AS (
  SELECT * REPLACE (
    CASE WHEN OrderID % 97 <> 0 THEN CustomerID END AS CustomerID,
    CASE WHEN OrderID % 211 = 1 THEN ' ' || lower(ProductType) || '  ' ELSE ProductType END
      AS ProductType,
    CASE WHEN OrderID % 53 = 0 AND OrderLine = 1 THEN 'Unknown' ELSE Brand END AS Brand,
    CASE WHEN OrderID % 13 <> 0 THEN Segment WHEN OrderLine % 2 = 0 THEN 'ZZ' ELSE 'YY' END
      AS Segment,
    CASE WHEN OrderID % 101 = 0 THEN '   ' ELSE Priority END AS Priority,
    CASE WHEN OrderID % 307 = 0 THEN -Revenue WHEN OrderID % 503 = 0 THEN Revenue * 100
      ELSE Revenue END AS Revenue),
    CASE WHEN OrderID % 89 = 0 THEN 'n/a' ELSE CAST(OrderLine AS VARCHAR) || '.5' END AS WeightText,
    'EUR' AS Currency
  FROM flat
),
dirty AS MATERIALIZED (
  SELECT * FROM once UNION ALL SELECT * FROM once WHERE OrderID % 499 = 1
)"""
)
