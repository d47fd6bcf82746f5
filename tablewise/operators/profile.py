"""Profiling: table totals, one row per column, and the analytical role of each column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import columns as C
from tablewise.functions import names
from tablewise.functions.columns import col
from tablewise.functions.text import RENDERED_CHARS
from tablewise.operators import counts
from tablewise.sources.dataset import materialise

TOP_MAX_DISTINCT = 1_000
LOW_CARDINALITY = 50
#: Quantiles that are kept for every measure.
SHARES = (0.25, 0.5, 0.75)
REPEATED_SHARE = 0.5
UNIQUE_LABEL_ROWS = 20

KEY, FOREIGN_KEY, ATTRIBUTE = "key", "foreign_key", "dimension_attribute"
MEASURE, DATE, IDENTIFIER, UNKNOWN = "measure", "date", "identifier", "unknown"
KEYS = (KEY, FOREIGN_KEY)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("physical_type", T.StringType()),
        T.StructField("logical_type", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("blank_count", T.LongType()),
        T.StructField("min", T.StringType()),
        T.StructField("max", T.StringType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("sum", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField(
            "top_values",
            T.ArrayType(
                T.StructType(
                    [T.StructField("value", T.StringType()), T.StructField("n", T.LongType())]
                )
            ),
        ),
    ]
)


def table_totals(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, and rows that repeat an earlier row."""
    missing = [F.count_if(col(n).isNull()) for n in df.columns]
    totals = df.agg(F.count("*").alias("rows"), *[m.alias(f"m{i}") for i, m in enumerate(missing)])
    total_missing = sum((F.col(f"m{i}") for i in range(len(missing))), F.lit(0).cast("bigint"))
    return totals.select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        total_missing.alias("missing_values"),
        F.lit(counts.duplicate_rows(df)).cast("bigint").alias("duplicate_rows"),
    )


def column_counts(df: DataFrame) -> DataFrame:
    """Per column: rows, missing, exact distinct values, and the shares of both."""
    summary = counts.count_summary(df)
    ratio = F.coalesce(F.try_divide(F.col("nulls"), F.col("rows")), F.lit(0.0))
    filled = F.try_divide(F.col("distinct"), F.col("rows") - F.col("nulls"))
    return summary.select(
        counts.name_of(df, F.col("idx")).alias("column"),
        "rows",
        F.col("nulls").alias("null_count"),
        F.col("distinct").alias("distinct_count"),
        ratio.alias("null_ratio"),
        F.coalesce(filled, F.lit(0.0)).alias("distinct_ratio"),
    )


def _iso(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    # ISO text with the fraction only where there is one, six digits wide.
    micros = F.date_format(value, "SSSSSS")
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def _stat_columns(f: T.StructField) -> list[Column]:
    """``(min, max, low, high, sum, mean, std, nans, present)`` of a number or a date."""
    value = col(f.name)
    none = F.lit(None).cast("double")
    if C.logical_type(f.dataType) in C.TEMPORAL:
        ends = [_iso(F.min(value), f.dataType), _iso(F.max(value), f.dataType)]
        return [*ends, none, none, none, none, none, F.lit(0).cast("bigint"), F.count(value)]
    number = value.cast("double")
    # Only these types know a NaN.
    floating = isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ranked = F.when(~F.isnan(number), value) if floating else value
    low, high = F.min(ranked), F.max(ranked)
    return [
        low.cast("string"),
        high.cast("string"),
        low.cast("double"),
        high.cast("double"),
        F.sum(number),
        none,  # follows from the sum
        F.stddev_samp(number),
        F.count_if(F.isnan(number)) if floating else F.lit(0).cast("bigint"),
        F.count(value),
    ]


STATS = 10


def column_stats(df: DataFrame, sketches: bool = True) -> dict[str, tuple]:
    """The one-pass statistics of every number and date column; one scan of those columns.

    The last one brackets the quartiles and the median of a number, see ``counts.sketched``; it costs more than
    all the others and is empty without ``sketches``.
    """
    kinds = C.NUMERIC | C.TEMPORAL
    fields = [f for f in df.schema.fields if C.logical_type(f.dataType) in kinds]
    result: dict[str, tuple] = {}
    for batch in C.batches(fields, 25):
        aggs = []
        for f in batch:
            number = sketches and C.logical_type(f.dataType) in C.NUMERIC
            around = counts.sketched(counts.measure_cell(f.name), SHARES) if number else F.lit(None)
            aggs += [*_stat_columns(f), around]
        row = tuple(df.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggs)]).first())
        for i, f in enumerate(batch):
            own = list(row[STATS * i : STATS * (i + 1)])
            if own[4] is not None:
                own[5] = own[4] / own[8]
            result[f.name] = tuple(own)
    return result


@dataclass(frozen=True)
class Ranks:
    """What is known of the measures' quantiles: bounds, and a bracket around each share."""

    counted: counts.CountedTable
    bounds: dict[str, tuple[int, int, float, float]]
    around: dict[str, list[float] | None]

    @classmethod
    def of(cls, counted: counts.CountedTable, stats: dict[str, tuple]) -> Ranks:
        numeric = [f.name for f in counted.source.schema.fields if C.logical_type(f.dataType) in C.NUMERIC]
        bounds = {n: (stats[n][8], stats[n][7], *map(_clip, stats[n][2:4])) for n in numeric}
        return cls(counted, bounds, {n: stats[n][9] for n in numeric})

    def ranks(self, name: str) -> list[list[int]]:
        """The ranks of each of ``SHARES``: nearest ranks of the quartiles, both middle ones."""
        count = self.bounds[name][0]
        if not count:
            return [[] for _ in SHARES]
        first, third = counts.nearest_ranks(count, (SHARES[0], SHARES[2]))
        return [[first], counts.middle_ranks(count), [third]]

    def values(self, names: list[str]) -> dict[tuple[str, int], float]:
        """The exact values at the ranks of some measures: one pass over their counted values."""
        wanted, around = {}, {}
        self._sketch([n for n in names if self.bounds[n][0] and not self.around[n]])
        for n in names:
            ranks = self.ranks(n)
            wanted[n] = sorted({r for own in ranks for r in own})
            for i, own in enumerate(ranks):
                if self.around[n]:
                    around |= {(n, r): tuple(self.around[n][2 * i : 2 * i + 2]) for r in own}
        cells = counts.counted_measures(self.counted, names)
        return counts.order_statistics(cells, wanted, self.bounds, around)


    def _sketch(self, names: list[str]) -> None:
        """Brackets of measures that the profile did without, from one scan of these."""
        for batch in C.batches(names, 25):
            sketches = [counts.sketched(counts.measure_cell(n), SHARES).alias(f"q{i}") for i, n in enumerate(batch)]
            self.around.update(zip(batch, self.counted.source.agg(*sketches).first(), strict=True))


def _clean(value: float | None) -> float | None:
    return value if value is not None and abs(value) < float("inf") else None


def _clip(value: float | None) -> float | None:
    return None if value is None else max(-counts.LARGEST, min(value, counts.LARGEST))


def profile_columns(df: DataFrame, medians: bool = True, stored: bool = False) -> DataFrame:
    """One row per column. The result is a bounded local table: computing it runs the jobs.

    Two scans: one aggregate for all statistics, and one that counts all values, column by column if the
    table is ``stored``. Distinct and most frequent values and exact medians, which a caller that needs roles and counts only can leave out,
    read the stored counts. Values are ranked only in the columns whose most frequent ones are kept.
    """
    return _profiled(df, medians, stored)[0]


def _keeps_top(f: T.StructField, distinct: int) -> bool:
    kind = C.logical_type(f.dataType)
    return kind in (C.STRING, C.BOOLEAN) or (distinct <= TOP_MAX_DISTINCT and kind not in C.TEMPORAL)


def _profiled(df: DataFrame, medians: bool, stored: bool) -> tuple[DataFrame, Ranks, dict]:
    spark = df.sparkSession
    C.check_names(df)
    stats = column_stats(df, medians)
    table = counts.CountedTable.of(df, stored)
    known = Ranks.of(table, stats)
    counted = {r["idx"]: r for r in counts.count_totals(table).collect()}
    shown = [i for i, f in enumerate(df.schema.fields) if i in counted and _keeps_top(f, counted[i]["distinct"])]
    best = {r["idx"]: r["top"] for r in counts.most_frequent(table, shown).collect()} if shown else {}
    values, median = {}, {}
    if medians and known.bounds:
        values = known.values(list(known.bounds))
        median = counts.median_values(values, {n: known.ranks(n)[1] for n in known.bounds})
    rows = []
    for i, f in enumerate(df.schema.fields):
        least, greatest, low, high, total, mean, std, *_ = stats.get(f.name, [None] * STATS)
        seen, kind = counted.get(i), C.logical_type(f.dataType)
        distinct = seen["distinct"] if seen else 0
        top = []
        for entry in best.get(i, []):
            text = entry["value"]
            cut = text if len(text) <= RENDERED_CHARS else text[: RENDERED_CHARS - 1] + "…"
            top.append((cut, entry["n"]))
        rows.append(
            (
                i,
                f.name,
                f.dataType.simpleString(),
                kind,
                seen["rows"] if seen else 0,
                seen["nulls"] if seen else 0,
                distinct,
                seen["blanks"] if seen else 0,
                least,
                greatest,
                _clean(low),
                _clean(high),
                total,
                _clean(mean),
                _clean(std),
                _clean(median.get(f.name)),
                top,
            )
        )
    return spark.createDataFrame(rows, PROFILE_SCHEMA), known, values


# -- roles -----------------------------------------------------------------------------------
def with_roles(profile: DataFrame) -> DataFrame:
    """Adds ``role``, ``reason``, ``additive`` and ``nullable``; the first rule that fits wins."""
    present = F.col("rows") - F.col("null_count")
    name, kind, distinct = F.trim(F.col("column")), F.col("logical_type"), F.col("distinct_count")
    unique = distinct == present
    text, number = kind == C.STRING, kind.isin(*C.NUMERIC)
    repeated = (distinct <= LOW_CARDINALITY) | (
        F.try_divide(distinct, present) <= REPEATED_SHARE
    )
    id_like = name.rlike(names.ID_SNAKE) | name.rlike(names.ID_CAMEL)
    label = (kind == C.INTEGER) & F.col("column").rlike(names.INTEGER_LABEL)
    # Roles and their reasons.
    rules = [
        (present == 0, UNKNOWN, "column is entirely empty"),
        (kind.isin(*C.TEMPORAL), DATE, "date/datetime type"),
        (id_like & unique, KEY, "id-like name, unique values"),
        (id_like, FOREIGN_KEY, "id-like name, repeated values"),
        (kind == C.BOOLEAN, ATTRIBUTE, "boolean flag"),
        (label, ATTRIBUTE, "integer label (name suggests a code/period)"),
        (number, MEASURE, "numeric values"),
        (text & unique & (present >= UNIQUE_LABEL_ROWS), IDENTIFIER, "text with a unique value per row"),
        (text & repeated, ATTRIBUTE, "text with repeated values"),
        (text, IDENTIFIER, "high-cardinality text"),
    ]
    role, reason = F.when(*_arm(rules[0], 1)), F.when(*_arm(rules[0], 2))
    for rule in rules[1:]:
        role, reason = role.when(*_arm(rule, 1)), reason.when(*_arm(rule, 2))
    unsupported = F.concat(F.lit("unsupported type "), F.col("physical_type"))
    additive = F.when(F.col("role") == MEASURE, ~F.col("column").rlike(names.NON_ADDITIVE))
    averaged = "; non-additive (price/rate): average instead of sum"
    return (
        profile.withColumn("role", role.otherwise(UNKNOWN))
        .withColumn("additive", additive)
        .withColumn("reason", reason.otherwise(unsupported))
        .withColumn(
            "reason",
            F.when(F.col("additive") == F.lit(False), F.concat("reason", F.lit(averaged))).otherwise(
                F.col("reason")
            ),
        )
        .withColumn("nullable", F.col("null_count") > 0)
    )


def _arm(rule: tuple, part: int) -> tuple:
    return rule[0], F.lit(rule[part])


@dataclass
class Profile:
    """Bounded facts about a table: its totals and one row per column."""

    name: str
    source: DataFrame
    rows: int
    frame: DataFrame
    columns: list = field(default_factory=list)
    ranks: Ranks | None = None
    quantiles: dict[tuple[str, int], float] = field(default_factory=dict)

    @cached_property
    def counted(self) -> counts.CountedTable:
        """The stored value counts of the source, shared by all that reads values."""
        return self.ranks.counted if self.ranks else counts.CountedTable.of(self.source)

    def quartiles(self, names: list[str]) -> dict[str, tuple[float, float]]:
        """Exact first and third quartile per measure with values (nearest ranks)."""
        known = self.ranks or Ranks.of(self.counted, column_stats(self.source.select(*[col(n) for n in names])))
        new = [n for n in names if any((n, r) not in self.quantiles for own in known.ranks(n) for r in own)]
        if new:
            self.quantiles |= known.values(new)
        ends = {n: known.ranks(n) for n in names}
        return {n: (self.quantiles[n, r[0][0]], self.quantiles[n, r[2][0]]) for n, r in ends.items() if r[0]}

    @cached_property
    def duplicates(self) -> DataFrame:
        """Rows that occur more than once, with their number ``__n``; found and stored once."""
        return materialise(counts.duplicate_groups(self.source))

    @cached_property
    def duplicate_rows(self) -> int:
        """Rows that repeat an earlier row; counted when first asked for."""
        if not self.rows:
            return 0
        return int(self.duplicates.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0])

    def by_role(self, *roles: str) -> list:
        return [c for c in self.columns if c["role"] in roles]

    def names(self, *roles: str) -> list[str]:
        return [c["column"] for c in self.by_role(*roles)]

    def column(self, name: str):
        return next((c for c in self.columns if c["column"] == name), None)

    @property
    def missing_values(self) -> int:
        return sum(c["null_count"] for c in self.columns)

    @property
    def measures(self) -> list[str]:
        return self.names(MEASURE)

    @property
    def additive(self) -> list[str]:
        return [c["column"] for c in self.by_role(MEASURE) if c["additive"]]

    @property
    def non_additive(self) -> list[str]:
        return [c["column"] for c in self.by_role(MEASURE) if not c["additive"]]


def profile_table(df: DataFrame, name: str = "table", medians: bool = True, stored: bool = False) -> Profile:
    """Profile with roles; only one row per column is collected. ``stored`` tables are counted column by column."""
    facts, ranks, quantiles = _profiled(df, medians, stored)
    columns = with_roles(facts).orderBy("ordinal").collect()
    rows = columns[0]["rows"] if columns else df.count()
    frame = df.sparkSession.createDataFrame(columns, with_roles_schema())
    return Profile(name, df, rows, frame, columns, ranks, quantiles)


def with_roles_schema() -> T.StructType:
    extra = [
        T.StructField("role", T.StringType()),
        T.StructField("additive", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
    ]
    return T.StructType([*PROFILE_SCHEMA.fields, *extra])
