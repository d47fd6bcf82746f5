"""Checks over tables and stored results, all reported as findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import col, comparable, model_type, quote
from tablewise.operators.fingerprints import BUCKETS, bucket_of, differing, fingerprint

EXAMPLES = 5
REL_TOLERANCE, ABS_TOLERANCE = 1e-9, 1e-6
PASSED, FAILED, NOT_RUN = "passed", "failed", "not_run"

FINDING_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("check", "status", "severity", "object", "message")]
)


def findings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FINDING_SCHEMA)


def finding(check: str, ok: bool, message: str = "", obj: str = "", severity: str = "error") -> tuple:
    """One finding; the severity says how bad a failure is, a pass is only information."""
    if ok:
        return (check, PASSED, "info", obj, message)
    return (check, FAILED, severity, obj, message)


def not_run(check: str, obj: str, message: str) -> tuple:
    return (check, NOT_RUN, "info", obj, message)


def report(found: DataFrame) -> DataFrame:
    """Counts by status and severity; only a failed error makes the report fail."""
    failed = F.col("status") == FAILED
    errors = F.count_if(failed & (F.col("severity") == "error"))
    return found.agg(
        F.count_if(F.col("status") == PASSED).alias("passed_checks"),
        errors.alias("failed_errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("failed_warnings"),
        F.count_if(F.col("status") == NOT_RUN).alias("not_run"),
        (errors == 0).alias("passed"),
    )


# -- keys and relationships -------------------------------------------------------------------
def _orphan_keys(many: DataFrame, many_col: str, one: DataFrame, one_col: str) -> DataFrame:
    """``(k, n)``: key values missing on the one side with their rows on the many side.

    The many side is counted by key before the join, so a key filling a third of the rows
    is a single record in it and nothing is skewed.
    """
    used = many.select(col(many_col).alias("k")).filter("k IS NOT NULL")
    counted = used.groupBy("k").agg(F.count("*").alias("n"))
    known = one.select(col(one_col).alias("k"))
    return counted.join(known, "k", "left_anti")


def orphans(many: DataFrame, many_col: str, one: DataFrame, one_col: str) -> DataFrame:
    """One row: orphan rows and the five smallest missing keys as text."""
    missing = _orphan_keys(many, many_col, one, one_col)
    rows = missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
    first = missing.orderBy("k").limit(EXAMPLES)
    shown = first.agg(F.transform(F.sort_array(F.collect_list("k")), lambda k: k.cast("string")))
    return rows.withColumn("examples", shown.scalar())


def key_state(df: DataFrame, name: str) -> DataFrame:
    """One row about a key column: rows, nulls, distinct values, repeated rows.

    Repeats count a missing value as one value, the way a set of keys would.
    """
    counted = df.groupBy(col(name).alias("k")).agg(F.count("*").alias("n"))
    missing = F.col("k").isNull()
    zero = F.lit(0)
    return counted.agg(
        F.coalesce(F.sum("n"), zero).alias("rows"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), zero).alias("nulls"),
        F.count_if(~missing).alias("distinct_count"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"),
        (F.coalesce(F.max(F.when(~missing, F.col("n"))), zero) <= 1).alias("values_unique"),
    )


def key_pair(many: DataFrame, many_col: str, one: DataFrame, one_col: str) -> DataFrame:
    """One row judging the relationship ``many[many_col] -> one[one_col]``."""
    types = [model_type(d.schema[c].dataType) for d, c in ((many, many_col), (one, one_col))]
    compatible = types[0] == types[1]
    state = key_state(one, one_col)
    if compatible:
        lost = orphans(many, many_col, one, one_col)
        orphan_rows = lost.select("orphan_rows").scalar()
        examples = lost.select("examples").scalar()
    else:
        orphan_rows, examples = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    blank = many.agg(F.count_if(col(many_col).isNull())).scalar()
    judged = state.select(
        F.lit(compatible).alias("type_compatible"),
        F.col("values_unique").alias("to_side_unique"),
        F.col("nulls").alias("to_side_nulls"),
        orphan_rows.alias("orphan_rows"),
        examples.alias("orphan_examples"),
        blank.alias("null_from_rows"),
    )
    ok = F.col("type_compatible") & F.col("to_side_unique")
    return judged.withColumn(
        "ok", ok & (F.col("to_side_nulls") == 0) & (F.col("orphan_rows") == 0)
    )


def referential_integrity(
    fact: DataFrame, fact_key: str, dimension: DataFrame, dimension_key: str
) -> DataFrame:
    row = orphans(fact, fact_key, dimension, dimension_key).first()
    n, shown = row["orphan_rows"], list(row["examples"])
    message = f"{n:,} orphan rows; e.g. {shown}" if n else ""
    obj = f"{fact_key} -> {dimension_key}"
    return findings(
        fact.sparkSession, [finding("referential_integrity", n == 0, message, obj)]
    )


# -- tables -----------------------------------------------------------------------------------
def table_findings(
    name: str, df: DataFrame, expected: dict[str, str], key: str | None = None
) -> list[tuple]:
    """Columns and types as expected, rows present, key unique and filled."""
    have = {f.name: model_type(f.dataType) for f in df.schema.fields}
    missing = [c for c in expected if c not in have]
    wrong = [
        f"{c}: spec {t}, data {df.schema[c].dataType.simpleString()}"
        for c, t in expected.items()
        if c in have and have[c] != t
    ]
    text = f"missing {missing}; type mismatches {wrong}" if missing or wrong else ""
    rows = [finding("columns_match_data", not text, text, name)]
    if key in have:
        state = key_state(df, key).first()
        count, nulls, repeats = state["rows"], state["nulls"], state["duplicates"]
        rows.append(finding("table_not_empty", count > 0, f"{count:,} rows", name, "warning"))
        bad = nulls or repeats
        text = f"{nulls:,} nulls, {repeats:,} duplicates" if bad else ""
        rows.append(finding("key_unique_not_null", not bad, text, f"{name}[{key}]"))
    else:
        count = df.count()
        rows.append(finding("table_not_empty", count > 0, f"{count:,} rows", name, "warning"))
    return rows


def relationship_findings(
    relation: str, many: DataFrame | None, many_col: str, one: DataFrame | None, one_col: str, to_table: str
) -> list[tuple]:
    if many is None or one is None or many_col not in many.columns or one_col not in one.columns:
        return [not_run("relationship_keys", relation, "table data not available")]
    r = key_pair(many, many_col, one, one_col).first()
    types = [d.schema[c].dataType.simpleString() for d, c in ((many, many_col), (one, one_col))]
    single = r["to_side_unique"] and r["to_side_nulls"] == 0
    lost = ""
    if r["orphan_rows"]:
        lost = (
            f"{r['orphan_rows']:,} fact rows reference keys missing from {to_table}, "
            f"e.g. {list(r['orphan_examples'])}"
        )
    unique = f"{to_table}[{one_col}] must be unique and non-null for many-to-one"
    blank = f"{r['null_from_rows']:,} rows have no {many_col} and show as (Blank)"
    return [
        finding("key_types_compatible", r["type_compatible"], " vs ".join(types), relation),
        finding("cardinality_matches_data", single, unique, relation),
        finding("no_orphan_keys", r["orphan_rows"] == 0, lost, relation),
        finding("no_blank_foreign_keys", r["null_from_rows"] == 0, blank, relation, "warning"),
    ]


def calendar_state(df: DataFrame, key: str) -> DataFrame:
    """One row about a date table: rows, distinct days, first and last day, day span."""
    day = col(key).cast("date")
    return df.agg(
        F.count("*").alias("rows"),
        # A missing day is a value of its own: it breaks contiguity.
        (F.count_distinct(day) + F.when(F.count(day) < F.count("*"), 1).otherwise(0)).alias("days"),
        F.min(day).alias("first"),
        F.max(day).alias("last"),
        (F.datediff(F.max(day), F.min(day)) + 1).cast("bigint").alias("span"),
    )


def calendar_findings(
    name: str, df: DataFrame, key: str | None, facts: list[tuple[str, DataFrame, str]]
) -> list[tuple]:
    """Contiguity of a date table, and that it covers every related fact date."""
    if key is None or key not in df.columns:
        return [finding("date_table_key", False, "date table needs a key date column", name)]
    s = calendar_state(df, key).first()
    if not s["rows"]:
        return [finding("date_table_key", False, "date table needs a key date column", name)]
    if s["first"] is None:
        return [finding("date_table_key", False, "date table key is empty", name)]
    whole = s["days"] == s["rows"] == s["span"]
    text = f"{s['rows']:,} rows for a {s['span']:,}-day range"
    rows = [finding("date_table_contiguous", whole, text, name)]
    for relation, fact, column in facts:
        day = col(column).cast("date")
        lo, hi = fact.agg(F.min(day), F.max(day)).first()
        if lo is not None:
            ok = s["first"] <= lo and hi <= s["last"]
            text = f"facts span {lo}..{hi}, date table {s['first']}..{s['last']}"
            rows.append(finding("date_table_covers_facts", ok, text, relation))
    return rows


# -- stored results ---------------------------------------------------------------------------
def recheck_source(df: DataFrame | None, rows: int, columns: int, name: str) -> DataFrame | tuple:
    """Whether the source still has the profiled shape; ``None`` stands for out of reach."""
    if df is None:
        return not_run("row_count_matches_source", name, "source file not reachable from here")
    have = df.count()
    text = (
        f"source has {have}x{len(df.columns)}, profile says {rows}x{columns}"
        " (re-run analyze if the source changed)"
    )
    return finding("row_count_matches_source", (have, len(df.columns)) == (rows, columns), text, name)


def recheck_values(df: DataFrame | None, stored: DataFrame, name: str) -> tuple:
    """Whether the source still holds the values it had when its fingerprint was ``stored``.

    Counts alone miss a changed cell. One scan; the finding names the share of the source that differs.
    """
    if df is None:
        return not_run("values_match_source", name, "the source is out of reach")
    now = fingerprint(df)
    changed = differing(stored, now)
    text = f"{len(changed)} of {BUCKETS} buckets of rows differ from the stored fingerprint" if changed else ""
    return finding("values_match_source", not changed, text, name)


def cross_check(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Recompute every stored sum by SQL and compare; ``stats`` has ``column`` and ``sum``.

    The profile adds doubles. This path adds exact decimals, so agreement is evidence.
    Values beyond the decimal range fall back to a double sum.
    """
    spark = df.sparkSession
    stored = {r["column"]: r["sum"] for r in stats.filter("sum IS NOT NULL").collect()}
    if not stored:
        return findings(spark, [])
    unknown = [n for n in stored if n not in df.columns]
    if unknown:
        text = f"metrics have unknown columns {unknown}"
        return findings(spark, [finding("metrics_columns_exist", False, text, "metrics")])
    sums = ", ".join(
        f"coalesce(cast(try_sum(try_cast({quote(n)} AS DECIMAL(38, 12))) AS DOUBLE), 0)"
        f" + coalesce(sum(CASE WHEN try_cast({quote(n)} AS DECIMAL(38, 12)) IS NULL"
        f" THEN CAST({quote(n)} AS DOUBLE) END), 0) AS v{i}"
        for i, n in enumerate(stored)
    )
    row = spark.sql(f"SELECT {sums} FROM {{source}}", source=df).first()
    rows = []
    for i, (n, value) in enumerate(stored.items()):
        again = row[f"v{i}"]
        gap = max(REL_TOLERANCE * max(abs(value), abs(again)), ABS_TOLERANCE)
        text = f"stored sum={value}, SQL SUM={again}"
        rows.append(finding("metrics_match_sql", abs(value - again) <= gap, text, f"metrics:{n}"))
    return findings(spark, rows)


def stored_result_findings(
    profile: DataFrame,
    totals: DataFrame,
    schema: DataFrame | None = None,
    quality_rows: int | None = None,
    metrics_rows: int | None = None,
) -> DataFrame:
    """Do stored results agree with each other? All inputs have one row per column or less."""
    t = totals.first()
    columns = profile.orderBy("ordinal").select("column", "rows", "null_count").collect()
    missing = sum(c["null_count"] for c in columns)
    bad = [c["column"] for c in columns if c["null_count"] > c["rows"]]
    rows = [
        finding(
            "profile_column_count",
            t["columns"] == len(columns),
            f"header says {t['columns']}, found {len(columns)} profiles",
            "profile",
        ),
        finding(
            "profile_missing_total",
            t["missing_values"] == missing,
            "total missing cells equals the sum of per-column nulls",
            "profile",
        ),
        finding(
            "null_counts_within_rows",
            not bad,
            f"columns with more nulls than rows: {bad}" if bad else "",
            "profile",
        ),
    ]
    if schema is not None:
        names = [r["column"] for r in schema.orderBy("ordinal").collect()]
        same = names == [c["column"] for c in columns]
        text = "schema and profile describe the same columns in the same order"
        rows.append(finding("schema_matches_profile", same, text, "schema"))
    for check, obj, n in (
        ("quality_matches_profile", "quality", quality_rows),
        ("metrics_match_profile", "metrics", metrics_rows),
    ):
        if n is not None:
            text = f"{obj} covers {n} rows, profile {t['rows']}"
            rows.append(finding(check, n == t["rows"], text, obj))
    return findings(profile.sparkSession, rows)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- change between two versions of a table ----------------------------------------------------
def table_change(old: DataFrame, new: DataFrame, key: str | None) -> DataFrame:
    """One row: columns added and removed; rows added, removed and changed, matched by key.

    Without a key, rows are compared whole as bags and a change shows as one of each. A NULL key
    matches a NULL key; a key that repeats among the rows that differ has no match and is refused. Maps
    are compared by their entries. Both versions are read twice: fingerprints tell which parts differ.
    """
    old, new = comparable(old), comparable(new)
    added = [c for c in new.columns if c not in old.columns]
    removed = [c for c in old.columns if c not in new.columns]
    shared = [c for c in new.columns if c in old.columns]
    names = {"columns_added": sorted(added), "columns_removed": sorted(removed)}
    old, new = (d.select(*[col(c) for c in shared]) for d in (old, new))
    if shared:
        # Only rows of buckets that differ go on; two equal versions shuffle no row.
        keys = None if key is None else [key]
        changed = differing(fingerprint(old, keys), fingerprint(new, keys))
        old, new = (d.filter(bucket_of(d, keys).isin(changed)) if changed else d.limit(0) for d in (old, new))
    if key is None:
        side = lambda d, s: d.select("*", F.lit(s).alias("__s"))
        both = side(old, -1).unionByName(side(new, 1))
        # Bag difference by counting: one shuffle, combined on the map side.
        net = both.groupBy(*[col(c) for c in shared]).agg(F.sum("__s").alias("d"))
        counts = net.agg(
            F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("rows_added"),
            F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("rows_removed"),
            F.lit(0).cast("bigint").alias("rows_changed"),
        )
    else:
        values = [c for c in shared if c != key]
        row = lambda d: d.select(col(key).alias("k"), F.struct(*[col(c) for c in values] or [F.lit(1)]).alias("v"))
        for version in (old, new):
            if not version.groupBy(col(key)).count().filter("count > 1").isEmpty():
                raise ValueError(f"{key!r} repeats, so rows cannot be matched by it")
        before, after = row(old).toDF("k0", "before"), row(new).toDF("k1", "after")
        joined = before.join(after, F.col("k0").eqNullSafe(F.col("k1")), "full")
        unequal = ~F.col("before").eqNullSafe(F.col("after"))
        here, there = F.col("before").isNotNull(), F.col("after").isNotNull()
        counts = joined.agg(
            F.count_if(~here).alias("rows_added"),
            F.count_if(~there).alias("rows_removed"),
            F.count_if(here & there & unequal).alias("rows_changed"),
        )
    listed = [F.array(*[F.lit(c) for c in v]).cast("array<string>").alias(k) for k, v in names.items()]
    return counts.select(*listed, "rows_added", "rows_removed", "rows_changed")

