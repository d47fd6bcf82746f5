"""Counting: how often each value occurs, how many rows are distinct, exact quantiles.

Everything here aggregates on the map side first, so one value, row or key that fills a
third of the table costs one record per task, and no group is held whole in any task.

The values of a table with their counts are a table of their own (``CountedTable``), counted
in one scan, or column by column where the table is stored, and stored. Profiles, quantiles and checks read that table, never the source again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewise.functions.columns import batches, col, comparable
from tablewise.functions.text import is_blank
from tablewise.sources.dataset import materialise

TOP = 5
# Suspect row hashes that may be broadcast: at 8 bytes each this is at most 16 MB.
BROADCAST_HASHES = 2_000_000
QUANTILE_BUCKETS = 2_048
# A sketch's ranks are off by at most one part in so many; brackets take twice that on both sides.
SKETCH_PARTS = 1_000
# Values inside brackets that are settled on the driver at most (24 bytes each).
SETTLED_VALUES = 100_000
LARGEST = 1.7976931348623157e308


# -- value counts ----------------------------------------------------------------------------
SLOTS = {"l": "bigint", "d": "double", "s": "string"}


def _slot(field: T.StructField) -> tuple[str, Column]:
    """The slot of a column's type, and its value there."""
    value, kind = col(field.name), field.dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "l", value.cast("bigint")
    if isinstance(kind, T.DateType):
        return "l", F.unix_date(value).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return "l", F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        # Microseconds of the wall-clock reading; the session zone plays no part.
        day = F.unix_date(value.cast("date")).cast("bigint")
        clock = F.extract(F.lit("SECOND"), value) + (F.hour(value) * 60 + F.minute(value)) * 60
        return "l", day * 86_400_000_000 + (clock * 1_000_000).cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "d", value.cast("double")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return "s", F.to_json(value)
    return "s", value.cast("string")


def _slots(slot: str, value: Column) -> list[Column]:
    """A value as (long, double, string), exactly one of which holds it.

    Typed slots let columns of any type share a single pass and shuffle without turning
    numbers into text, and keep the column's own ordering for breaking ties.
    """
    return [value if n == slot else F.lit(None).cast(t) for n, t in SLOTS.items()]


def slot_counts(df: DataFrame, stored: bool = False) -> DataFrame:
    """``(idx, l, d, s, n)``: occurrences of every value of every column, NULLs included.

    Columns of a ``stored`` table are read and counted one by one, each by its own slot alone, which spares a record
    per cell and two empty keys a value; any other table is computed once.
    """
    df = comparable(df)
    fields = list(enumerate(df.schema.fields))
    parts = []
    if stored and fields:
        for i, f in fields:
            slot, value = _slot(f)
            own = df.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("n"))
            keys = [c.alias(n) for c, n in zip(_slots(slot, F.col("v")), SLOTS, strict=True)]
            m = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
            parts.append(own.select(F.lit(i).alias("idx"), *keys, "n", m.alias("m")))
        return reduce(DataFrame.unionByName, parts)
    for batch in batches(fields):
        cells = [c for i, f in batch for c in (F.lit(i), *_slots(*_slot(f)))]
        parts.append(df.select(F.stack(F.lit(len(batch)), *cells).alias("idx", "l", "d", "s")))
    cells = reduce(DataFrame.unionByName, parts)
    # ``m`` counts the present cells of the group: ``n`` for a value, 0 for NULL.
    present = F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
    return cells.groupBy("idx", "l", "d", "s").agg(
        F.count("*").alias("n"), F.count_if(present).alias("m")
    )


@dataclass(frozen=True)
class CountedTable:
    """The stored value counts of a table: ``(idx, l, d, s, n, m)``, see ``slot_counts``.

    Files are ordered by column, so a filter on ``idx`` skips the pages of the other columns. Those of a
    ``stored`` table hold one column each as they are and need no sorting.
    """

    source: DataFrame
    cells: DataFrame

    @classmethod
    def of(cls, df: DataFrame, stored: bool = False) -> CountedTable:
        cells = slot_counts(df, stored)
        return cls(df, materialise(cells if stored else cells.sortWithinPartitions("idx")))

    def index(self, name: str) -> int:
        return self.source.columns.index(name)

    def present(self, names: list[str]) -> DataFrame:
        """Counted values of some columns, missing ones left out."""
        wanted = [self.index(n) for n in names]
        return self.cells.filter(F.col("idx").isin(wanted) & (F.col("m") > 0))


def cell_number() -> Column:
    """A counted number as a double."""
    return F.coalesce(F.col("l").cast("double"), F.col("d"), F.col("s").try_cast("double"))


def name_of(df: DataFrame, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in df.columns]), idx + 1)


def render(df: DataFrame) -> Column:
    """The counted value as text, in the way its column's type is printed."""
    special = []
    for i, f in enumerate(df.schema.fields):
        kind = f.dataType
        if isinstance(kind, T.BooleanType):
            special.append((i, (F.col("l") == 1).cast("string")))
        elif isinstance(kind, T.DateType):
            special.append((i, F.date_from_unix_date(F.col("l").cast("int")).cast("string")))
        elif isinstance(kind, T.TimestampType):
            special.append((i, F.timestamp_micros(F.col("l")).cast("string")))
        elif isinstance(kind, T.TimestampNTZType):
            seconds = "make_dt_interval(0, 0, 0, CAST(l AS DECIMAL(20, 0)) / 1000000)"
            special.append((i, F.expr(f"CAST(TIMESTAMP_NTZ'1970-01-01' + {seconds} AS STRING)")))
    plain = F.coalesce(F.col("s"), F.col("l").cast("string"), F.col("d").cast("string"))
    text = plain
    for i, value in special:
        text = F.when(F.col("idx") == i, value).otherwise(text)
    return text


def value_counts(df: DataFrame | CountedTable) -> DataFrame:
    """``(column, value, n)`` with values as text; a NULL value counts the missing cells."""
    counts, df = (df.cells, df.source) if isinstance(df, CountedTable) else (slot_counts(df), df)
    return counts.select(name_of(df, F.col("idx")).alias("column"), render(df).alias("value"), "n")


def count_summary(df: DataFrame | CountedTable, top: int = TOP) -> DataFrame:
    """``(idx, rows, nulls, distinct, blanks, top)``, ``top`` an array of ``(rn, value, n)``.

    Both branches read the same counted exchange, which Spark runs once, or the stored counts.
    For that, neither may push a filter below it: presence is an aggregate, and the join is
    null-safe.
    """
    counts, df = (df.cells, df.source) if isinstance(df, CountedTable) else (slot_counts(df), df)
    best = _most_frequent(counts, df, top).withColumnRenamed("idx", "top_idx")
    joined = _count_totals(counts).join(best, F.col("idx").eqNullSafe(F.col("top_idx")), "left")
    return joined.drop("top_idx")


def count_totals(table: CountedTable) -> DataFrame:
    """``(idx, rows, nulls, distinct, blanks)`` without ranking any value."""
    return _count_totals(table.cells)


def most_frequent(table: CountedTable, columns: list[int], top: int = TOP) -> DataFrame:
    """``(idx, top)`` as in ``count_summary``, for some columns; values of the others are not ranked."""
    return _most_frequent(table.cells.filter(F.col("idx").isin(columns)), table.source, top)


def _count_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("idx").agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - F.col("m")).alias("nulls"),
        F.count_if(F.col("m") > 0).alias("distinct"),
        F.sum(F.when(is_blank(F.col("s")), F.col("n")).otherwise(0)).alias("blanks"),
    )


def _most_frequent(counts: DataFrame, df: DataFrame, top: int) -> DataFrame:
    decimals = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.DecimalType)]
    as_number = F.when(F.col("idx").isin(decimals), F.expr("try_cast(s AS DECIMAL(38, 18))"))
    order = [F.desc("n"), F.asc("l"), F.asc("d"), as_number.asc(), F.asc("s")]
    ranked = (
        counts.filter("m > 0")
        .withColumn("rn", F.row_number().over(Window.partitionBy("idx").orderBy(*order)))
        .filter(F.col("rn") <= top)
    )
    entry = F.struct("rn", render(df).alias("value"), "n")
    return ranked.groupBy("idx").agg(F.sort_array(F.collect_list(entry)).alias("top"))


# -- distinct rows ---------------------------------------------------------------------------
def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[col(n) for n in df.columns])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Rows occurring more than once, with their count in ``__n``; exact, NULLs equal.

    A first pass counts 8-byte row hashes instead of shuffling whole rows. Only rows
    whose hash repeats can be duplicates; those few are then compared in full. When
    suspects are too many to broadcast, whole rows are grouped directly.
    """
    df = comparable(df)
    hashes = df.select(_row_hash(df).alias("__h")).groupBy("__h").count()
    # One more than the bound is enough to know that the bound is exceeded; stored, so that
    # the counting above runs once.
    repeated = materialise(hashes.filter("count > 1").select("__h").limit(BROADCAST_HASHES + 1))
    suspects = repeated.count()
    rows = df
    if suspects == 0:
        rows = df.filter(F.lit(False))
    elif suspects <= BROADCAST_HASHES:
        rows = df.withColumn("__h", _row_hash(df))
        rows = rows.join(F.broadcast(repeated), "__h", "left_semi").select(
            *[col(n) for n in df.columns]
        )
    groups = rows.groupBy(*[col(n) for n in df.columns]).agg(F.count("*").alias("__n"))
    return groups.filter("__n > 1")


def duplicate_rows(df: DataFrame) -> int:
    """Rows that repeat an earlier row: rows minus distinct rows."""
    if not df.columns:
        return 0
    total = duplicate_groups(df).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)))
    return int(total.first()[0])


# -- exact quantiles -------------------------------------------------------------------------
def _rankable(value: Column) -> Column:
    top = F.lit(LARGEST)
    return F.when(~F.isnan(value), F.greatest(F.least(value, top), -top))


def measure_cell(name: str) -> Column:
    """A measure as a rankable double: NaN is left out, infinities clip to the largest double."""
    return _rankable(col(name).cast("double"))


def measure_bounds(df: DataFrame, names: list[str]) -> dict[str, tuple[int, int, float, float]]:
    """Per measure: values, NaNs among them, least and greatest rankable value."""
    aggs = []
    for name in names:
        cell = measure_cell(name)
        nan = F.count_if(F.isnan(col(name).cast("double")))
        aggs += [F.count(col(name)), nan, F.min(cell), F.max(cell)]
    row = tuple(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())
    return {name: row[4 * i : 4 * i + 4] for i, name in enumerate(names)}


def sketched(cell: Column, shares: tuple[float, ...]) -> Column:
    """Values around each share from a mergeable sketch: ``(low, high)`` after ``(low, high)``."""
    margin = 2 / SKETCH_PARTS
    around = [x for p in shares for x in (max(0.0, p - margin), min(1.0, p + margin))]
    return F.percentile_approx(cell, around, SKETCH_PARTS)


def measure_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """``(name, v, n)``: the rankable values of measures straight from the rows, each once."""
    cells = [x for name in names for x in (F.lit(name), measure_cell(name))]
    rows = df.select(F.stack(F.lit(len(names)), *cells).alias("name", "v"))
    return rows.filter("v IS NOT NULL").withColumn("n", F.lit(1).cast("bigint"))


def counted_measures(table: CountedTable, names: list[str]) -> DataFrame:
    """``(name, v, n)``: the rankable values of measures with their counts."""
    named = name_of(table.source, F.col("idx")).alias("name")
    return table.present(names).select(named, _rankable(cell_number()).alias("v"), "n").filter("v IS NOT NULL")


Bounds = dict[str, tuple[int, int, float, float]]


def order_statistics(
    df: DataFrame,
    ranks: dict[str, list[int]],
    bounds: Bounds,
    around: dict[tuple[str, int], tuple[float, float]] | None = None,
) -> dict[tuple[str, int], float]:
    """The exact value at each 0-based ascending rank, for many columns at once.

    ``df`` holds the measures as columns, or is ``(name, v, n)``. Two passes over it, whatever
    the values are: sketches bracket every rank (``around``, if a scan before has done that), then one
    pass counts what lies below each bracket and keeps the counted values inside, a few thousandths
    of the table. The rest is settled on these: on the driver if they are few, else by counting buckets. No
    column is sorted, and a bracket that a sketch got wrong is only wider the next time.
    """
    found: dict[tuple[str, int], float] = {}
    spans: dict[tuple[str, int], tuple[float, float]] = {}
    for name, wanted in ranks.items():
        count, nans, low, high = bounds[name]
        for rank in wanted:
            if rank >= count - nans:
                found[name, rank] = math.nan  # NaN sorts after every number
            elif low == high:
                found[name, rank] = low
            else:
                spans[name, rank] = (low, high)
    if not spans:
        return found
    names = list(dict.fromkeys(name for name, _ in spans))
    cells = df if df.columns == ["name", "v", "n"] else measure_cells(df, names)
    if around is None:
        around = _bracketed(cells, list(spans), bounds)
    kept = {key: around.get(key, whole) for key, whole in spans.items()}
    while kept:
        kept = _settled(cells, kept, bounds, found)
    return found


def _bracketed(cells: DataFrame, keys: list[tuple[str, int]], bounds: Bounds) -> dict:
    """A bracket for every rank of every measure, from one scan."""
    shares = {}
    for name, rank in keys:
        rows = bounds[name][0] - bounds[name][1]
        shares.setdefault(name, {})[rank] = rank / max(rows - 1, 1)
    aggs = []
    for i, (name, ranks) in enumerate(shares.items()):
        own = F.when(F.col("name") == name, F.col("v"))
        aggs.append(sketched(own, tuple(ranks.values())).alias(f"q{i}"))
    row = cells.agg(*aggs).first()
    result = {}
    for (name, ranks), ends in zip(shares.items(), row, strict=True):
        for i, rank in enumerate(ranks):
            result[name, rank] = (ends[2 * i], ends[2 * i + 1])
    return result


def _settled(cells: DataFrame, spans: dict, bounds: Bounds, found: dict) -> dict:
    """Find the ranks whose bracket holds them; what is returned gets the whole range as bracket."""
    keys = list(spans)
    by_name: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(keys):
        by_name.setdefault(name, []).append(i)
    entry = lambda i: F.struct(F.lit(i).alias("i"), *[F.lit(float(x)).alias(e) for x, e in zip(spans[keys[i]], ("lo", "hi"))])
    each = F.when(F.lit(False), F.array(entry(0)))
    for name, own in by_name.items():
        each = each.when(F.col("name") == name, F.array(*[entry(i) for i in own]))
    rows = cells.select("v", "n", F.explode(each).alias("b")).filter("v <= b.hi")
    inside = F.when(F.col("v") >= F.col("b.lo"), F.col("v"))
    # What is below a bracket is one record, the values inside are counted.
    held = materialise(rows.groupBy(F.col("b.i").alias("i"), inside.alias("v")).agg(F.sum("n").alias("n")))
    few = held.count() <= SETTLED_VALUES
    rows = held.collect() if few else held.filter("v IS NULL").collect()
    below = {r["i"]: r["n"] for r in rows if r["v"] is None}
    open_ = {i: (*spans[key], key[1] - below.get(i, 0)) for i, key in enumerate(keys)}
    missed = {keys[i]: bounds[keys[i][0]][2:4] for i, (*_, rank) in open_.items() if rank < 0}
    open_ = {i: span for i, span in open_.items() if span[2] >= 0}
    if few:
        values: dict[int, list[tuple[float, int]]] = {}
        for r in rows:
            if r["v"] is not None:
                values.setdefault(r["i"], []).append((r["v"], r["n"]))
        for i, (_, _, rank) in open_.items():
            value = _value_at(sorted(values.get(i, [])), rank)
            if value is None:
                missed[keys[i]] = bounds[keys[i][0]][2:4]
            else:
                found[keys[i]] = value
        return missed
    held = held.filter("v IS NOT NULL")
    while open_:
        counted = _bucket_counts(held, open_)
        for i, (_, _, rank) in list(open_.items()):
            del open_[i]
            for count, least, greatest in counted.get(i, []):
                if rank >= count:
                    rank -= count
                    continue
                if least == greatest:
                    found[keys[i]] = least
                else:
                    open_[i] = (least, greatest, rank)
                break
            else:
                missed[keys[i]] = bounds[keys[i][0]][2:4]
    return missed


def _value_at(values: list[tuple[float, int]], rank: int) -> float | None:
    """The value at a rank of counted values in order; None beyond them."""
    for value, n in values:
        if rank < n:
            return value
        rank -= n
    return None


def _bucket_counts(held: DataFrame, spans: dict[int, tuple[float, float, int]]) -> dict[int, list]:
    """Per span its filled buckets in order: ``(n, least, greatest)``."""
    last = QUANTILE_BUCKETS - 1
    bucket = F.lit(None).cast("int")
    v = F.col("v")
    for i, (lo, hi, _) in spans.items():
        if math.isfinite(hi - lo) and hi > lo:
            share = (v - F.lit(lo)) / F.lit(hi - lo)
        elif hi > lo:
            share = (v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        else:
            share = F.lit(0.0)
        inside = (F.col("i") == i) & (v >= F.lit(lo)) & (v <= F.lit(hi))
        bucket = F.when(inside, F.floor(share * last).cast("int")).otherwise(bucket)
    rows = (
        held.select("i", bucket.alias("bucket"), "v", "n")
        .filter("bucket IS NOT NULL")
        .groupBy("i", "bucket")
        .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    result: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["bucket"])):
        result.setdefault(r["i"], []).append((r["n"], r["lo"], r["hi"]))
    return result


def nearest_ranks(count: int, shares: tuple[float, ...]) -> list[int]:
    """Nearest rank of each share among ``count`` values; a tie of one half goes up."""
    return [math.floor(p * (count - 1) + 0.5) for p in shares]


def middle_ranks(count: int) -> list[int]:
    """The two middle ranks of ``count`` values, one if they coincide."""
    return sorted({(count - 1) // 2, count // 2}) if count else []


def medians(df: DataFrame, bounds: Bounds) -> dict[str, float | None]:
    """Exact median per measure: the mean of the two middle values."""
    ranks = {n: middle_ranks(b[0]) for n, b in bounds.items()}
    return median_values(order_statistics(df, ranks, bounds), ranks)


def median_values(
    values: dict[tuple[str, int], float], ranks: dict[str, list[int]]
) -> dict[str, float | None]:
    return {n: (values[n, r[0]] + values[n, r[-1]]) / 2 if r else None for n, r in ranks.items()}
