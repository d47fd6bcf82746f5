"""One registered query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.tables import DATES, dirty_sales, flat_sales, flat_turns, read, read_spread, with_defects
from tablewise.functions import text as X
from tablewise.functions.columns import col
from tablewise.operators import checks as V
from tablewise.operators import counts
from tablewise.operators import dependencies as D
from tablewise.operators import fingerprints as FP
from tablewise.operators import metrics as M
from tablewise.operators import profile as P
from tablewise.operators import quality as Q
from tablewise.operators.grain import detect_grain
from tablewise.plans.semantic import Measure, hierarchy_rollup, measure_by, visual_query
from tablewise.plans.star import Relationship, StarDesign, design_star, null_keys, validate_star
from tablewise.sources.dataset import Dataset, materialise, materialise_parts, normalise_dates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The dirty table, stored once per query because the operator reads it several times."""
    return materialise(dirty_sales(spark, d))


def _profiled(spark: SparkSession, d: str, medians: bool = False) -> tuple[DataFrame, P.Profile]:
    df = _stored(spark, d)
    return df, P.profile_table(df, "sales", medians, stored=True)


def _designed(spark: SparkSession, d: str) -> tuple[DataFrame, P.Profile, StarDesign]:
    df, profile = _profiled(spark, d)
    return df, profile, design_star(df, profile)


def _round(c: str, digits: int = 2):  # noqa: ANN202
    return F.round(F.col(c), digits).alias(c)


def _iso(*names: str):  # noqa: ANN202
    return [F.date_format(n, "yyyy-MM-dd").alias(n) for n in names]


# -- profiling --------------------------------------------------------------------------------
@query
def profile_totals(spark: SparkSession, d: str) -> DataFrame:
    return P.table_totals(_stored(spark, d))


@query
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return P.column_counts(dirty_sales(spark, d)).select(
        F.col("column").alias("column_name"),
        F.col("rows").alias("n_rows"),
        "null_count",
        "distinct_count",
        _round("null_ratio", 6),
        _round("distinct_ratio", 6),
    )


@query
def numeric_stats(spark: SparkSession, d: str) -> DataFrame:
    found = P.profile_columns(_stored(spark, d), stored=True)
    return found.filter(F.col("logical_type").isin("integer", "decimal")).select(
        F.col("column").alias("column_name"),
        F.round("min_value", 4).alias("min_value"),
        F.round("max_value", 4).alias("max_value"),
        _round("mean", 4),
        _round("std", 4),
        _round("median", 4),
    )


@query
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    found = counts.value_counts(dirty_sales(spark, d).select("Brand", "CustomerID", "Priority", "ShipDate"))
    return found.select(F.col("column").alias("column_name"), F.col("value").alias("val"), "n")


@query
def top_values(spark: SparkSession, d: str) -> DataFrame:
    df = dirty_sales(spark, d)
    names = [c for c in df.columns if c not in DATES]
    summary = counts.count_summary(df.select(*names))
    texts = [i for i, n in enumerate(names) if df.schema[n].dataType.simpleString() == "string"]
    kept = summary.filter(F.col("idx").isin(texts) | (F.col("distinct") <= P.TOP_MAX_DISTINCT))
    return kept.select(
        counts.name_of(df.select(*names), F.col("idx")).alias("column_name"),
        F.inline("top").alias("rn", "val", "n"),
    ).select("column_name", F.col("rn").cast("bigint").alias("rn"), X.bounded(F.col("val")).alias("val"), "n")


@query
def column_roles(spark: SparkSession, d: str) -> DataFrame:
    found = P.with_roles(P.profile_columns(_stored(spark, d), medians=False, stored=True))
    return found.select(
        F.col("column").alias("column_name"), "logical_type", "role", "reason", "additive", "nullable"
    )


@query
def event_roles(spark: SparkSession, d: str) -> DataFrame:
    found = P.with_roles(P.profile_columns(read_spread(spark, d, "events"), medians=False))
    return found.select(F.col("column").alias("column_name"), "role", "distinct_count", "min", "max")


# -- quality ----------------------------------------------------------------------------------
def _check(spark: SparkSession, d: str, check: Q.Check) -> DataFrame:
    df, profile = _profiled(spark, d)
    return check(df, profile).select(
        "kind",
        "severity",
        F.coalesce("column", F.lit("-")).alias("column_name"),
        "affected_rows",
        "description",
        F.array_join("examples", " | ", "-").alias("examples"),
    )


@query
def quality_missing(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, Q.missing_values)


@query
def quality_blank(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, Q.blank_strings)


@query
def quality_duplicates(spark: SparkSession, d: str) -> DataFrame:
    # Example rows are JSON texts, whose number format is the engine's own.
    return _check(spark, d, Q.duplicate_rows).drop("examples")


@query
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    found = counts.duplicate_groups(_stored(spark, d))
    return found.select("OrderID", "OrderLine", "ProductID", "SupplierID", F.col("__n").alias("copies"))


@query
def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    found = counts.duplicate_groups(read_spread(spark, d, "documents").select("text", "lang"))
    return found.select(F.md5(F.col("text")).alias("text_md5"), "lang", F.col("__n").alias("copies"))


@query
def quality_categories(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, Q.inconsistent_categories).drop("examples")


@query
def category_variants(spark: SparkSession, d: str) -> DataFrame:
    names = ["Brand", "ProductType", "Priority", "Segment", "Region"]
    found = Q.category_variants(dirty_sales(spark, d), names)
    return found.select(
        F.col("column").alias("column_name"),
        "norm",
        "canonical",
        F.array_join("variants", "|").alias("variants"),
        "affected",
    )


@query
def quality_outliers(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, Q.outliers)


@query
def quality_negative(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, Q.negative_values)


@query
def quality_text_types(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, Q.type_mismatch)


@query
def quality_constant(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d, Q.constant_columns)


@query
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    df, profile = _profiled(spark, d)
    return Q.check_quality(df, profile).select(
        "kind", "severity", F.coalesce("column", F.lit("-")).alias("column_name"), "affected_rows"
    )


@query
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    df, profile = _profiled(spark, d)
    return Q.quality_summary(Q.check_quality(df, profile))


# -- metrics ----------------------------------------------------------------------------------
@query
def kpis(spark: SparkSession, d: str) -> DataFrame:
    df, profile = _profiled(spark, d)
    return M.suggest_kpis(df, profile).select(
        F.col("position").cast("bigint").alias("position"),
        F.col("name").alias("kpi"),
        "definition",
        "aggregation",
        "format_hint",
        F.round("value", 4).alias("val"),
        X.format_kpi(F.col("value"), F.col("format_hint")).alias("shown"),
    )


@query
def measure_stats(spark: SparkSession, d: str) -> DataFrame:
    _, profile = _profiled(spark, d, medians=True)
    return M.measure_stats(profile).select(
        F.col("column").alias("column_name"),
        F.round("sum", 2).alias("total"),
        _round("mean", 4),
        _round("median", 4),
        F.round("min", 4).alias("min_value"),
        F.round("max", 4).alias("max_value"),
    )


@query
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    _, profile = _profiled(spark, d)
    found = M.date_ranges(profile)
    return found.select(
        F.col("column").alias("column_name"), F.col("first").alias("first_day"), F.col("last").alias("last_day")
    )


@query
def monthly_totals(spark: SparkSession, d: str) -> DataFrame:
    found = M.monthly_totals(dirty_sales(spark, d), "OrderDate", "Revenue")
    return found.select(*_iso("month"), F.round("value", 2).alias("val"))


@query
def monthly_rows(spark: SparkSession, d: str) -> DataFrame:
    found = M.monthly_totals(read_spread(spark, d, "events"), "ts", None)
    return found.select(*_iso("month"), F.col("value").alias("val"))


@query
def peak_low(spark: SparkSession, d: str) -> DataFrame:
    found = M.peak_and_low(M.monthly_totals(dirty_sales(spark, d), "OrderDate", "Revenue"))
    return found.select(
        "months", *_iso("peak_month", "low_month"), _round("peak_value"), _round("low_value")
    )


@query
def recent_change(spark: SparkSession, d: str) -> DataFrame:
    found = M.recent_change(M.monthly_totals(dirty_sales(spark, d), "OrderDate", "Revenue"))
    return found.select(_round("recent"), _round("prior"), _round("change", 6))


@query
def breakdown_region(spark: SparkSession, d: str) -> DataFrame:
    found = M.breakdown(dirty_sales(spark, d), "Region", "Revenue")
    return found.select("category", F.round("value", 2).alias("val"), _round("share", 6))


@query
def breakdown_customer(spark: SparkSession, d: str) -> DataFrame:
    """A dimension with missing values and without a size limit."""
    found = M.breakdown(dirty_sales(spark, d), "CustomerID", None)
    shown = F.coalesce(F.col("category").cast("string"), F.lit("(blank)")).alias("category")
    return found.select(shown, F.col("value").alias("val"), _round("share", 8))


@query
def top3_share(spark: SparkSession, d: str) -> DataFrame:
    found = M.top_share(M.breakdown(dirty_sales(spark, d), "Nation", "Revenue"))
    return found.select("category", "categories", _round("top_share", 6), _round("top3_share", 6))


@query
def correlations(spark: SparkSession, d: str) -> DataFrame:
    measures = ["Quantity", "Revenue", "Cost", "UnitPrice", "DiscountRate"]
    found = M.correlations(dirty_sales(spark, d), measures)
    return found.select("a", "b", F.round("r", 6).alias("r"), "n")


@query
def missing_table(spark: SparkSession, d: str) -> DataFrame:
    _, profile = _profiled(spark, d)
    return M.missing_table(profile).select(F.col("column").alias("column_name"), "missing")


@query
def insights(spark: SparkSession, d: str) -> DataFrame:
    df, profile = _profiled(spark, d)
    found = M.generate_insights(df, profile, Q.check_quality(df, profile))
    return found.select("title", "detail")


# -- star schema ------------------------------------------------------------------------------
KEYS = ["OrderID", "CustomerID", "ProductID", "SupplierID"]
ATTRIBUTES = [
    "OrderLine", "CustomerName", "Segment", "Nation", "Region", "ProductName", "Brand",
    "ProductType", "SupplierName", "Priority", "OrderStatus", "ReturnFlag", "WeightText", "Currency",
]


@query
def fd_agreement(spark: SparkSession, d: str) -> DataFrame:
    df = materialise(dirty_sales(spark, d).select(*KEYS, *ATTRIBUTES))
    found = D.dependencies(df, KEYS, ATTRIBUTES, counts.CountedTable.of(df, stored=True))
    return found.select(
        F.col("key").alias("key_name"), "attribute", _round("agreement", 8), "conflicting_rows"
    )


def _dependencies(spark: SparkSession, d: str) -> tuple[DataFrame, P.Profile]:
    df, profile = _profiled(spark, d)
    return D.dependencies(df, D.entity_keys(profile), D.attribute_candidates(profile), profile.counted), profile


@query
def dimension_plan(spark: SparkSession, d: str) -> DataFrame:
    found = D.assignments(*_dependencies(spark, d))
    return found.select("attribute", F.col("key").alias("key_name"), "conflicting_rows")


@query
def near_misses(spark: SparkSession, d: str) -> DataFrame:
    found = D.near_misses(*_dependencies(spark, d))
    return found.select(
        "attribute", F.col("key").alias("key_name"), _round("agreement", 8), "conflicting_rows"
    )


@query
def dim_customer(spark: SparkSession, d: str) -> DataFrame:
    return D.build_dimension(
        dirty_sales(spark, d), "CustomerID", ["CustomerName", "Segment", "Nation", "Region"]
    )


@query
def dim_product(spark: SparkSession, d: str) -> DataFrame:
    return D.build_dimension(
        dirty_sales(spark, d), "ProductID", ["ProductName", "Brand", "ProductType"]
    )


@query
def dim_supplier_lines(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent values where nothing is determined: the largest groups and real ties."""
    return D.build_dimension(
        dirty_sales(spark, d), "SupplierID", ["OrderLine", "CustomerName", "ReturnFlag"]
    )


@query
def hierarchies(spark: SparkSession, d: str) -> DataFrame:
    _, _, star = _designed(spark, d)
    rows = [
        (table, " > ".join(chain)) for table, chains in star.hierarchies.items() for chain in chains
    ]
    return spark.createDataFrame(rows, "dimension string, levels string")


@query
def strict_determination(spark: SparkSession, d: str) -> DataFrame:
    levels = ["Region", "Nation", "CustomerName", "Segment", "OrderStatus"]
    pairs = [(c, p) for c in levels for p in levels if c != p]
    df = flat_sales(spark, d)
    strict = D.strict_pairs(df, pairs)
    rows = [(c, p, (c, p) in strict) for c, p in pairs]
    return spark.createDataFrame(rows, "child string, parent string, determined boolean")


@query
def calendar(spark: SparkSession, d: str) -> DataFrame:
    found = D.calendar(D.date_bounds(dirty_sales(spark, d), DATES))
    return found.select(*_iso("Date"), *[c for c in found.columns if c != "Date"])


@query
def fact_sales(spark: SparkSession, d: str) -> DataFrame:
    _, _, star = _designed(spark, d)
    fact = star.tables[star.fact]
    return fact.select(
        *[_round(c, 8) if c in ("Cost", "UnitPrice", "Revenue") else col(c) for c in fact.columns if c not in DATES],
        *_iso(*DATES),
    )


@query
def null_fk(spark: SparkSession, d: str) -> DataFrame:
    plans = [
        D.DimensionPlan("CustomerID", ["CustomerName", "Nation", "Region"]),
        D.DimensionPlan("ProductID", ["ProductName", "Brand", "ProductType"]),
    ]
    found = null_keys(dirty_sales(spark, d), plans)
    return found.select(F.col("key").alias("key_name"), "missing", "with_values")


@query
def conflicts(spark: SparkSession, d: str) -> DataFrame:
    df = _stored(spark, d)
    dim = D.build_dimension(df, "ProductID", ["Brand"])
    found = D.conflicting_rows(df, dim, "ProductID", "Brand")
    return found.select("OrderID", "OrderLine", "ProductID", "SupplierID", "Brand", "kept")


@query
def grain(spark: SparkSession, d: str) -> DataFrame:
    df, profile = _profiled(spark, d)
    columns, unique = detect_grain(df, profile)
    return spark.createDataFrame([(" + ".join(columns), unique)], "grain string, unique_rows boolean")


@query
def star_findings(spark: SparkSession, d: str) -> DataFrame:
    _, _, star = _designed(spark, d)
    return star.findings_frame().select(
        "topic",
        F.col("table").alias("table_name"),
        F.coalesce("column", F.lit("-")).alias("column_name"),
        "affected_rows",
    )


@query
def star_relationships(spark: SparkSession, d: str) -> DataFrame:
    _, _, star = _designed(spark, d)
    return star.relationships_frame()


@query
def star_change(spark: SparkSession, d: str) -> DataFrame:
    """The product dimension before and after the defects."""
    attributes = ["ProductName", "Brand", "ProductType"]
    old = D.build_dimension(flat_sales(spark, d), "ProductID", attributes)
    changed = dirty_sales(spark, d).filter(F.col("ProductID") % 17 != 0)
    new = D.build_dimension(changed, "ProductID", [*attributes, "Currency"])
    bumped = F.when(F.col("ProductID") % 19 == 0, "Rebranded").otherwise(F.col("Brand"))
    # Stored, since a comparison reads each version several times.
    found = V.table_change(materialise(old), materialise(new.withColumn("Brand", bumped)), "ProductID")
    return found.select(
        F.array_join("columns_added", ",").alias("columns_added"),
        F.array_join("columns_removed", ",").alias("columns_removed"),
        "rows_added",
        "rows_removed",
        "rows_changed",
    )


@query
def fact_change(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a table without a key, compared as bags of rows."""
    names = ["OrderID", "OrderLine", "CustomerID", "Segment", "Priority"]
    # Stored, since a comparison reads each version twice and its groups should not share a task with the joins' sorts.
    old, new = (materialise(f(spark, d).select(*names)) for f in (flat_sales, dirty_sales))
    return V.table_change(old, new, None).select("rows_added", "rows_removed", "rows_changed")


# -- checks -----------------------------------------------------------------------------------
def _tampered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The fact and a customer table that lost rows and repeats others."""
    fact = dirty_sales(spark, d)
    customer = read(spark, d, "customer").filter(F.col("c_custkey") % 10 != 3)
    again = F.explode(F.sequence(F.lit(0), F.when(F.col("c_custkey") % 50 == 0, 1).otherwise(0)))
    return fact, customer.select("c_custkey", "c_name", again.alias("copy")).drop("copy")


def _listed(examples: str):  # noqa: ANN202
    return F.array_join(examples, ",").alias(examples)


@query
def key_pair(spark: SparkSession, d: str) -> DataFrame:
    fact, customer = _tampered(spark, d)
    return V.key_pair(fact, "CustomerID", customer, "c_custkey").withColumn(
        "orphan_examples", F.array_join("orphan_examples", ",")
    )


@query
def key_pair_labels(spark: SparkSession, d: str) -> DataFrame:
    labels, documents = read(spark, d, "labels"), read(spark, d, "documents")
    return V.key_pair(labels, "doc_id", documents.filter("doc_id % 3 <> 0"), "doc_id").withColumn(
        "orphan_examples", F.array_join("orphan_examples", ",")
    )


@query
def orphans(spark: SparkSession, d: str) -> DataFrame:
    fact, customer = _tampered(spark, d)
    return V.orphans(fact, "CustomerID", customer, "c_custkey").select("orphan_rows", _listed("examples"))


@query
def referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    fact, customer = _tampered(spark, d)
    found = V.referential_integrity(fact, "CustomerID", customer, "c_custkey")
    return found.select("check", "status", "severity", "object", "message")


@query
def key_unique(spark: SparkSession, d: str) -> DataFrame:
    fact, customer = _tampered(spark, d)
    parts = [
        V.key_state(df, k).withColumn("object", F.lit(k))
        for df, k in ((fact, "CustomerID"), (fact, "OrderID"), (customer, "c_custkey"))
    ]
    return V.union(parts).withColumnRenamed("rows", "n_rows")


@query
def calendar_checks(spark: SparkSession, d: str) -> DataFrame:
    """A whole calendar and one with a missing day."""
    days = materialise(D.calendar(D.date_bounds(dirty_sales(spark, d), DATES)))
    gap = days.filter("Date <> DATE'1996-02-29'")
    parts = [
        V.calendar_state(c, "Date").withColumn("object", F.lit(n))
        for n, c in (("whole", days), ("gap", gap))
    ]
    found = V.union(parts)
    whole = (F.col("days") == F.col("rows")) & (F.col("rows") == F.col("span"))
    return found.select(
        "object",
        F.col("rows").alias("n_rows"),
        F.col("days").alias("n_days"),
        F.date_format("first", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last", "yyyy-MM-dd").alias("last_day"),
        F.col("span").alias("day_span"),
        whole.alias("contiguous"),
    )


@query
def metric_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    """Stored sums against sums of decimals, as they are and with those of two measures edited."""
    df, profile = _profiled(spark, d)
    stats = M.measure_stats(profile)
    edited = F.when(F.col("column") == "Revenue", F.col("sum") + 0.01).when(F.col("column") == "Cost", F.col("sum") * 1.0001)
    cases = {"stored": stats, "edited": stats.withColumn("sum", edited.otherwise(F.col("sum")))}
    found = [V.cross_check(df, s).withColumn("stats", F.lit(n)) for n, s in cases.items()]
    return V.union(found).select("stats", "check", "status", "object")


@query
def findings(spark: SparkSession, d: str) -> DataFrame:
    """The star as stored, with a product missing and a supplier repeated."""
    df, profile, star = _designed(spark, d)
    tables = {n: materialise(t) for n, t in star.tables.items()}
    tables["DimProduct"] = tables["DimProduct"].filter("ProductID <> 7")
    supplier = tables["DimSupplier"]
    again = F.explode(F.sequence(F.lit(0), F.when(F.col("SupplierID") == 5, 1).otherwise(0)))
    tables["DimSupplier"] = supplier.select("*", again.alias("copy")).drop("copy")
    found = validate_star(star, tables, profile.rows)
    return found.select("check", "status", "severity", "object")


@query
def findings_report(spark: SparkSession, d: str) -> DataFrame:
    df, profile, star = _designed(spark, d)
    tables = {n: materialise(t) for n, t in star.tables.items()}
    return V.report(validate_star(star, tables, profile.rows))


@query
def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """Stored results of one table against each other, and against those of another version.

    One of the two is stored, in turns, and the other made from it row by row: the disks would not hold both.
    """
    flat = materialise_parts(flat_turns(spark, d), codec="zstd")
    df = with_defects(flat)
    profile, schema = P.profile_columns(df, medians=False, stored=True), lambda t: P.with_roles(t).select("ordinal", "column")
    other = P.profile_columns(flat, medians=False, stored=True)
    parts = {
        "own": V.stored_result_findings(profile, P.table_totals(df), schema(profile), df.count(), df.count()),
        "other": V.stored_result_findings(profile, P.table_totals(flat), schema(other), df.count(), flat.count()),
    }
    return V.union([p.withColumn("version", F.lit(n)) for n, p in parts.items()]).select("version", "check", "status")


@query
def source_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns and values of a source against what was stored: as it is, cut, edited and gone."""
    source = read_spread(spark, d, "orders")
    rows, columns, values = source.count(), len(source.columns), materialise(FP.fingerprint(source))
    price = F.when(F.col("o_orderkey") % 1000 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    cases = {
        "orders": source,
        "half of orders": source.filter("o_orderkey % 2 = 0"),
        "edited orders": source.withColumn("o_totalprice", price),
        "gone": None,
    }
    found = []
    for name, df in cases.items():
        found += [V.recheck_source(df, rows, columns, name), V.recheck_values(df, values, name)]
    return V.findings(spark, found).select("check", "status", "object")


@query
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a table told apart by their fingerprints alone: which have the same rows?"""
    orders = read_spread(spark, d, "orders")
    one = F.when(F.col("o_orderkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    versions = {
        "shuffled": orders.repartition(7, "o_custkey").select(*reversed(orders.columns)),
        "one cell": orders.withColumn("o_totalprice", one),
        "a row twice": orders.unionAll(orders.filter("o_orderkey = 7")),
        "half": orders.filter("o_orderkey % 2 = 0"),
    }
    known = materialise(FP.fingerprint(orders))
    rows = [(n, not FP.differing(known, FP.fingerprint(v))) for n, v in versions.items()]
    return spark.createDataFrame(rows, "version string, same_rows boolean")


@query
def star_leftovers(spark: SparkSession, d: str) -> DataFrame:
    """Columns that stay in the fact: attributes without a key, and keys without attributes."""
    _, _, star = _designed(spark, d)
    rows = [(c, "no key") for c in star.leftovers] + [(c, "no attributes") for c in star.bare_keys]
    return spark.createDataFrame(rows, "column_name string, reason string")


@query
def event_star(spark: SparkSession, d: str) -> DataFrame:
    """Events carry a time of day: the star gets the day, and its calendar covers it."""
    df = materialise(read_spread(spark, d, "events"))
    star = design_star(df, P.profile_table(df, "events", medians=False, stored=True))
    link = star.active("DimDate").from_column
    fact, days = star.tables[star.fact], star.tables["DimDate"]
    per_day = fact.groupBy(col(link).alias("Date")).agg(F.count("*").alias("events"))
    found = days.join(per_day, "Date", "left").groupBy("Year", "MonthNumber")
    return found.agg(F.count("*").alias("days"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


# -- questions to the star --------------------------------------------------------------------
REVENUE = Measure("revenue", "sum", "Revenue")
COST = Measure("cost", "sum", "Cost")
PROFIT = Measure("profit", "difference", of=("revenue", "cost"))
MARGIN = Measure("margin", "ratio", of=("profit", "revenue"))
ORDERS = Measure("orders", "distinct_count", "OrderID")
LINES = Measure("lines", "count")
QUANTITY = Measure("avg_quantity", "average", "Quantity")
SMALLEST = Measure("min_revenue", "min", "Revenue")
LARGEST = Measure("max_revenue", "max", "Revenue")


def _star(spark: SparkSession, d: str) -> StarDesign:
    """A star over the stored dirty table with fixed dimensions: dimensions, bounds and the question read it."""
    df = _stored(spark, d)
    fact = "FactSales"
    star = StarDesign(fact, tables={fact: df})
    for table, key, attributes in (
        ("DimCustomer", "CustomerID", ["CustomerName", "Nation", "Region"]),
        ("DimProduct", "ProductID", ["ProductName", "ProductType"]),
    ):
        star.tables[table] = materialise(D.build_dimension(df, key, attributes))
        star.relationships.append(Relationship(fact, key, table, key))
    star.tables["DimDate"] = D.calendar(D.date_bounds(df, DATES))
    star.relationships.append(Relationship(fact, "OrderDate", "DimDate", "Date"))
    star.relationships.append(Relationship(fact, "ShipDate", "DimDate", "Date", active=False))
    return star


@query
def star_measures(spark: SparkSession, d: str) -> DataFrame:
    measures = [REVENUE, COST, PROFIT, MARGIN, ORDERS, LINES, QUANTITY, SMALLEST, LARGEST]
    found = measure_by(_star(spark, d), measures, ["DimCustomer[Region]", "DimProduct[ProductType]"])
    rounded = ("revenue", "cost", "profit", "min_revenue", "max_revenue")
    return found.select(
        "Region",
        "ProductType",
        *[_round(c) for c in rounded],
        _round("margin", 6),
        _round("avg_quantity", 6),
        "orders",
        "lines",
    )


@query
def role_playing_dates(spark: SparkSession, d: str) -> DataFrame:
    star = _star(spark, d)
    shipped = [r for r in star.relationships if r.from_column == "ShipDate"]
    found = measure_by(star, [REVENUE, LINES], ["DimDate[Year]", "DimDate[Quarter]"], use=shipped)
    return found.select("Year", "Quarter", _round("revenue"), "lines")


@query
def hierarchy_rollup_geo(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy_rollup(_star(spark, d), [REVENUE, ORDERS], "DimCustomer", ["Region", "Nation"])
    return found.select("Region", "Nation", "level", _round("revenue"), "orders")


@query
def hierarchy_rollup_calendar(spark: SparkSession, d: str) -> DataFrame:
    levels = ["Year", "Quarter", "Month"]
    found = hierarchy_rollup(_star(spark, d), [REVENUE, LINES], "DimDate", levels)
    return found.select(*levels, "level", _round("revenue"), "lines")


@query
def hierarchy_rollup_distinct(spark: SparkSession, d: str) -> DataFrame:
    levels = ["Year", "Quarter", "Month"]
    buyers, goods = Measure("customers", "distinct_count", "CustomerID"), Measure("products", "distinct_count", "ProductID")
    return hierarchy_rollup(_star(spark, d), [LINES, ORDERS, buyers, goods], "DimDate", levels)


@query
def visual(spark: SparkSession, d: str) -> DataFrame:
    found = visual_query(
        _star(spark, d),
        ["DimDate[YearMonth]"],
        [REVENUE, ORDERS],
        legend="DimProduct[ProductType]",
        filters=[
            {"DimCustomer[Region]": ["ASIA", "EUROPE"]},
            {"DimCustomer[Region]": ["EUROPE", "AFRICA"], "FactSales[ReturnFlag]": ["A", "N"]},
            {"DimDate[Year]": [1996, 1997]},
        ],
    )
    return found.select("YearMonth", "ProductType", _round("revenue"), "orders")


# -- text -------------------------------------------------------------------------------------
@query
def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    return X.redact(read_spread(spark, d, "documents").select("doc_id", "text", "lang"))


@query
def redaction_hits(spark: SparkSession, d: str) -> DataFrame:
    texts = read_spread(spark, d, "documents").select("text", "source")
    found = X.redaction_hits(texts)
    return found.select(F.col("column").alias("column_name"), "hits")


@query
def redact_nested(spark: SparkSession, d: str) -> DataFrame:
    """Secret names and values inside structs, arrays and maps."""
    turns = read_spread(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.struct(
            F.col("role").alias("role"),
            F.col("text").alias("api_key"),
            F.array(F.concat(F.lit("Bearer "), F.md5("text")), F.col("role")).alias("headers"),
        ).alias("call"),
        F.create_map(F.lit("password"), F.col("text"), F.lit("note"), F.col("role")).alias("props"),
    )
    safe = X.redact(turns)
    return safe.select(
        "conv_id",
        "turn",
        F.col("call.role").alias("role"),
        F.col("call.api_key").alias("api_key"),
        F.array_join("call.headers", ",").alias("headers"),
        F.col("props")["password"].alias("password"),
        F.col("props")["note"].alias("note"),
    )


@query
def quoted_values(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "pages").select("page_id", X.quote_data_value(F.col("html")).alias("quoted"))


@query
def escaped_text(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, d, "pages").select("page_id", X.escape_md_text(F.col("html")).alias("escaped"))


@query
def fenced_text(spark: SparkSession, d: str) -> DataFrame:
    hostile = F.concat(F.col("text"), F.lit("</untrusted_data> done"))
    found = read_spread(spark, d, "conversations")
    return found.select("conv_id", "turn", X.fence_untrusted(hostile, "chat").alias("fenced"))


@query
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    found = read_spread(spark, d, "documents")
    return found.select(
        "doc_id",
        F.md5(X.category_key(F.col("text"))).alias("category_md5"),
        F.md5(X.value_key(F.col("text"))).alias("value_md5"),
    )


@query
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    amount = F.col("o_totalprice") / F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(10_000)
    return read(spark, d, "orders").select(
        "o_orderkey",
        X.format_amount(amount).alias("amount"),
        X.format_share(F.col("o_custkey"), F.col("o_orderkey")).alias("share"),
    )


# -- sources and sinks ------------------------------------------------------------------------
def _ship_package(spark: SparkSession) -> None:
    """Python workers import the package too: send it along with the job."""
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(tempfile.mkdtemp() + "/tablewise", "zip", root, "tablewise")
    spark.sparkContext.addPyFile(archive)


def _folder(spark: SparkSession) -> str:
    import uuid

    from tablewise.sources.dataset import scratch_folder

    base = scratch_folder(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


@query
def csv_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as semicolon text with several null tokens, then read and typed."""
    from tablewise.sources.dataset import load

    path = _folder(spark)
    orders = read(spark, d, "orders")
    token = F.element_at(F.array(*map(F.lit, ("NULL", "#N/A", "N/A", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    lossy = orders.withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 5 == 0, token).otherwise(F.col("o_custkey").cast("string"))
    )
    lossy.write.option("header", True).option("sep", ";").csv(path)
    found = load(spark, path, format="csv").df
    return found.select(
        "o_orderkey", "o_custkey", "o_orderstatus", *_iso("o_orderdate"), "o_orderpriority", _round("o_totalprice")
    )


def _delimited(spark: SparkSession, df: DataFrame, path: str, **options: object) -> None:
    writer = df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).mode("append").options(**options).csv(path)


@query
def csv_ragged(spark: SparkSession, d: str) -> DataFrame:
    """Lines with more values than their header: refused, whatever the values beyond it are."""
    from tablewise.sources.dataset import LoadError, load

    orders = read(spark, d, "orders")
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.concat(F.lit('"'), "o_orderpriority", F.lit(', x"')))
    beyond = {"whole": F.lit(""), "one": F.lit(",late"), "empty": F.lit(","), "second": F.lit(",,lost"), "short": F.lit("")}
    rows = []
    for name, extra in beyond.items():
        path = _folder(spark)
        text = F.when(F.col("o_orderkey") % 50 == 3, F.concat(line, extra)).otherwise(line)
        if name == "short":
            text = F.when(F.col("o_orderkey") % 50 == 3, F.col("o_orderkey").cast("string")).otherwise(line)
        # One file with the header first.
        head = F.lit("key,status,priority").alias("value")
        body = orders.orderBy("o_orderkey").select(text.alias("value"))
        orders.limit(1).select(head).unionAll(body).coalesce(1).write.text(path)
        try:
            read_ = load(spark, path, format="csv").df
            rows.append((name, False, read_.filter("key % 50 = 3").count(), read_.filter("priority IS NULL").count()))
        except LoadError as refused:
            rows.append((name, True, int(str(refused).split(": ")[1].split(" ")[0]), 0))
    return spark.createDataFrame(rows, "extra string, refused boolean, lines long, without_priority long")


@query
def csv_dialects(spark: SparkSession, d: str) -> DataFrame:
    """A folder whose files differ in delimiter, in the order and in the number of their columns."""
    from tablewise.sources.dataset import load

    path, t = _folder(spark), read(spark, d, "customer")
    name = F.concat_ws(";", "c_name", F.lit("a,b|c")).alias("c_name")
    parts = [["c_custkey", name, "c_acctbal"], [name, "c_mktsegment", "c_custkey"], ["c_acctbal", "c_custkey", name, "c_mktsegment"]]
    for i, columns in enumerate(parts):
        _delimited(spark, t.filter(F.col("c_custkey") % 3 == i).select(*columns), path, sep=",;\t"[i])
    found = load(spark, path, format="csv").df
    return found.select("c_custkey", "c_name", _round("c_acctbal"), "c_mktsegment")


@query
def csv_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with line breaks, quotes and delimiters, written as quoted values and read back."""
    from tablewise.sources.dataset import load

    path = _folder(spark)
    # A carriage return inside a quoted value is read as a line feed.
    text = F.concat(F.lit("> "), F.replace("text", F.lit("\r"), F.lit("")), F.lit('"quoted", once\n'))
    _delimited(spark, read_spread(spark, d, "documents").select("doc_id", text.alias("text"), "lang"), path, quoteAll=True)
    found = load(spark, path, format="csv").df
    return found.select("doc_id", F.md5(F.col("text")).alias("text_md5"), "lang")


@query
def csv_legacy(spark: SparkSession, d: str) -> DataFrame:
    """Texts written in one byte per character, found not to be UTF-8 and read as cp1252."""
    from tablewise.sources.dataset import load

    path = _folder(spark)
    text = F.regexp_replace("text", r"[^\x20-\x7E\xA0-\xFF]", "?")
    marked = F.concat(F.lit("é "), text).alias("text")
    _delimited(spark, read_spread(spark, d, "documents").select("doc_id", marked), path, encoding="ISO-8859-1", quoteAll=True)
    found = load(spark, path, format="csv")
    noted = any("cp1252" in n for n in found.notes)
    return found.df.select("doc_id", F.md5(F.col("text")).alias("text_md5"), F.lit(noted).alias("noted"))


@query
def load_by_extension(spark: SparkSession, d: str) -> DataFrame:
    """The same table in files of each kind, told apart by their extensions alone."""
    from tablewise.sources.dataset import load, source_type

    base, t = _folder(spark), read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    rows = []
    for suffix in ("parquet", "pq", "csv", "tsv", "txt"):
        path = f"{base}/supplier.{suffix}"
        if suffix in ("parquet", "pq"):
            t.write.parquet(path)
        else:
            _delimited(spark, t, path, sep="\t" if suffix == "tsv" else "|" if suffix == "txt" else ",")
        found = load(spark, path)
        sums = found.df.agg(F.count("*"), F.sum("s_suppkey"), F.round(F.sum("s_acctbal"), 2), F.count_distinct("s_name")).first()
        rows.append((suffix, source_type(path), found.name, *sums))
    schema = "suffix string, kind string, name string, n_rows long, keys long, balance double, names long"
    return spark.createDataFrame(rows, schema)


@query
def chart_files(spark: SparkSession, d: str) -> DataFrame:
    """The table behind each chart, written as CSV files by two runs and read back from the current one."""
    from tablewise.sources.sinks import read_tables, verify_run, write_chart_tables

    df, profile = _profiled(spark, d)
    path, tables = _folder(spark), M.chart_tables(df, profile)
    for run in ("first", "second"):
        write_chart_tables(tables, path, run)
    whole = {r["table"]: r["ok"] for r in verify_run(spark, path).collect()}
    parts = []
    for name, t in read_tables(spark, path, list(tables)).items():
        label, value = t.columns[0], t.columns[1]
        shown = F.coalesce(F.substring(col(label), 1, 40), F.lit("-")).alias("label")
        number = F.round(col(value).cast("double"), 2).alias("val")
        parts.append(t.select(F.lit(name).alias("chart"), shown, number, F.lit(whole[name]).alias("whole")))
    return V.union(parts)


@query
def crash_before_publishing(spark: SparkSession, d: str) -> DataFrame:
    """A run that stops after its tables and before the pointer moves: the former one is still read."""
    from unittest import mock

    from tablewise.sources import sinks

    path, t = _folder(spark), read(spark, d, "nation")
    sinks.write_tables({"nation": t}, path, "good")
    with mock.patch.object(sinks, "_replace", side_effect=OSError("stopped")):
        try:
            sinks.write_tables({"nation": t.filter("n_nationkey < 5")}, path, "late")
        except OSError:
            pass
    found = sinks.read_tables(spark, path, ["nation"])["nation"]
    return found.select("n_nationkey", "n_name", F.lit(sinks.current_run(spark, path)).alias("run_id"))


@query
def analysis(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of a table as rows: candidates, key figures, measures, date ranges, issues."""
    from tablewise.plans.analyze import analyze

    found = analyze(_stored(spark, d), "sales")
    text = lambda df, section, name, value: df.select(
        F.lit(section).alias("section"), F.col(name).alias("name"), value.cast("string").alias("shown")
    )
    names = spark.createDataFrame(
        [("dimension", n, "") for n in found.candidate_dimensions] + [("measure", n, "") for n in found.candidate_measures],
        "section string, name string, shown string",
    )
    figure = F.format_string("%.2f", F.col("value"))
    issue = found.quality.withColumn("name", F.concat_ws(" ", "kind", F.coalesce("column", F.lit("-"))))
    parts = [
        names,
        text(found.kpis, "kpi", "name", figure),
        text(found.measures, "median", "column", F.format_string("%.4f", F.col("median"))),
        text(found.date_ranges, "dates", "column", F.concat_ws(" ", "first", "last")),
        text(issue, "issue", "name", F.col("affected_rows")),
        text(found.insights.groupBy().agg(F.count("*").alias("n")).withColumn("what", F.lit("insights")), "count", "what", F.col("n")),
    ]
    return V.union(parts)


@query
def xlsx_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Customers split over workbooks of at most 1000 rows, read back as one table."""
    import pandas as pd

    from tablewise.samples import workbook_bytes
    from tablewise.sources.workbook import parse_workbooks

    _ship_package(spark)
    names = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in pdf[names].itertuples(index=False)]
        content = workbook_bytes(names, rows, "Customers", ("Notes",))
        return pd.DataFrame({"path": [f"part-{key[0]}.xlsx"], "content": [content]})

    numbered = read(spark, d, "customer").select(*names, F.expr("c_custkey div 1000").alias("book"))
    files = numbered.groupBy("book").applyInPandas(pack, "path string, content binary")
    found = parse_workbooks(files).df
    return found.select("c_custkey", "c_name", _round("c_acctbal"), "c_mktsegment")


@query
def midnight_dates(spark: SparkSession, d: str) -> DataFrame:
    """Which timestamp columns carry no time of day."""
    rows = []
    for name in ("orders", "lineitem", "events"):
        found = normalise_dates(Dataset(read(spark, d, name), name))
        rows += [
            (name, f.name, f.dataType.simpleString() == "date")
            for f in found.df.schema.fields
            if f.dataType.simpleString() in ("date", "timestamp", "timestamp_ntz")
        ]
    return spark.createDataFrame(rows, "table_name string, column_name string, is_date boolean")


@query
def table_sql(spark: SparkSession, d: str) -> DataFrame:
    from tablewise.sources.sql import load_sql, register

    register("flat_orders", read(spark, d, "orders"))
    sql = """-- revenue per status; nothing is written
        SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM flat_orders WHERE o_orderstatus <> 'drop;' GROUP BY o_orderstatus;"""
    return load_sql(spark, sql.strip().rstrip(";")).df


@query
def star_sink(spark: SparkSession, d: str) -> DataFrame:
    """Star tables written as one run and read back: rows per table."""
    from tablewise.sources.sinks import read_tables, write_tables

    path, star = _folder(spark), _star(spark, d)
    write_tables(star.tables, path, "run1")
    stored = read_tables(spark, path, list(star.tables))
    sizes = [
        t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, t in stored.items()
    ]
    return V.union(sizes)


@query
def report_sink(spark: SparkSession, d: str) -> DataFrame:
    """Chart tables and a report written by two runs; the current one is read back."""
    from tablewise.sources.sinks import current_run, run_path, write_reports

    path = _folder(spark)
    monthly = monthly_totals(spark, d)
    for run in ("run1", "run2"):
        write_reports({"monthly": monthly}, path, run)
    found = spark.read.json(run_path(path, current_run(spark, path), "monthly"))
    return found.select("month", "val", F.lit(current_run(spark, path)).alias("run_id"))
