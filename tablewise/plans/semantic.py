"""Questions asked of a star: measures by attributes, roll-ups, and filtered visuals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import BROADCAST_BYTES, byte_size, col
from tablewise.operators.distinct import distinct_rollup
from tablewise.plans.star import Relationship, StarDesign
from tablewise.sources.dataset import materialise

AGGREGATES = ("sum", "count", "min", "max", "average", "distinct_count", "difference", "ratio")


@dataclass(frozen=True)
class Measure:
    """A named aggregate of a fact column, or arithmetic between two other measures.

    ``column`` is the fact column (``None`` counts rows). ``difference`` and ``ratio`` name
    two measures of the same query in ``of``; a ratio by zero is NULL.
    """

    name: str
    aggregate: str
    column: str | None = None
    of: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        if self.aggregate not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.aggregate!r}")


def _partial(m: Measure, rows: Column | None = None) -> dict[str, Column]:
    value = col(m.column).cast("double") if m.column else F.lit(1)
    value = F.when(rows, value) if rows is not None else value
    forms = {
        "sum": {"sum": F.sum(value)},
        "count": {"count": F.count(value)},
        "min": {"min": F.min(value)},
        "max": {"max": F.max(value)},
        "average": {"sum": F.sum(value), "count": F.count(value)},
    }
    return forms[m.aggregate]


def _final(m: Measure) -> Column:
    part = lambda kind: col(f"{m.name}:{kind}")
    if m.aggregate == "sum":
        return F.coalesce(F.sum(part("sum")), F.lit(0.0))
    if m.aggregate == "count":
        return F.coalesce(F.sum(part("count")), F.lit(0))
    if m.aggregate == "average":
        return F.try_divide(F.sum(part("sum")), F.sum(part("count")))
    return F.min(part("min")) if m.aggregate == "min" else F.max(part("max"))


def _split(field: str) -> tuple[str, str]:
    """``"DimCustomer[Region]"`` as table and column."""
    table, _, column = field.partition("[")
    if not column.endswith("]"):
        raise ValueError(f"expected Table[Column], got {field!r}")
    return table, column[:-1]


def measure_by(
    star: StarDesign,
    measures: list[Measure],
    by: list[str] = (),
    filters: dict[str, list] | None = None,
    use: list[Relationship] = (),
    rollup: bool = False,
) -> DataFrame:
    """Measures per combination of attributes; fact rows without a match group as NULL.

    ``by`` and the keys of ``filters`` are ``Table[Column]``. A date table joins over its
    active relationship unless ``use`` names another one.

    Dimensions are counted first, filters applied. Those that are small enough are broadcast and joined
    to the rows of the fact before these are grouped: their filters cut the fact where it is read, and
    what moves is one row per combination of attributes and task. Foreign keys of the larger ones are grouped
    first and joined then, so a key holding a third of the fact is one row per task. Distinct counts
    come from the same grouping, which keeps the counted value as well, so the fact is read once.
    Roll-ups count distinct values of any number of columns in that one reading: bitmaps of values are made
    for the most detailed groups and merged from level to level.
    """
    filters = dict(filters or {})
    fields = [_split(f) for f in by]
    tables = list(dict.fromkeys(t for t, _ in [*fields, *map(_split, filters)]))
    joins = {t: _relation(star, t, use) for t in tables if t != star.fact}
    fact = star.tables[star.fact]
    for field, allowed in filters.items():
        table, column = _split(field)
        if table == star.fact:
            fact = fact.filter(col(column).isin(list(allowed)))
    dims = {t: _needed(star, t, r, fields, filters) for t, r in joins.items()}
    limited = {_split(f)[0] for f in filters}
    small = [t for t, dim in dims.items() if byte_size(dim) <= BROADCAST_BYTES]
    # Filtered dimensions first: every later join meets fewer rows.
    for t in sorted(small, key=lambda t: t not in limited):
        fact = _joined(fact, F.broadcast(dims[t]), t, joins[t], t in limited)
    large = {t: r for t, r in joins.items() if t not in small}
    kept = [c if t == star.fact else f"{t}.{c}" for t, c in fields if t == star.fact or t in small]
    group = list(dict.fromkeys([*(r.from_column for r in large.values()), *kept]))
    plain = [m for m in measures if m.aggregate not in ("distinct_count", "difference", "ratio")]
    counted = [m for m in measures if m.aggregate == "distinct_count"]
    labels = _labels(fields)

    results = []
    if rollup and counted:
        rows = _grouped_with_values(fact, group, plain, counted)
        for t, r in large.items():
            rows = _joined(rows, dims[t], t, r, t in limited)
        results = _rolled_up(star, materialise(rows), fields, plain, counted)
    for i, m in enumerate([] if results else counted or [None]):
        own = plain if i == 0 else []
        aggs = [v.alias(f"{p.name}:{k}") for p in own for k, v in _partial(p).items()]
        finals = [_final(p).alias(p.name) for p in own]
        keys = [col(g) for g in group]
        if m is not None:
            # Distinct values do not add up: there is a row for each of them.
            keys.append(col(m.column).alias("__v"))
            # Without a join to follow, the groups are those of the result and hold each value once.
            finals.append((F.count_distinct("__v") if large else F.count("__v")).alias(m.name))
        rows = _aggregate(fact.groupBy(*keys), aggs)
        for t, r in large.items():
            rows = _joined(rows, dims[t], t, r, t in limited)
        results.append(_by(star, rows, fields, finals, rollup))
    result = results[0]
    for other in results[1:]:
        # Both sides hold one row per output group, joined NULL-safely.
        on = [*labels, "level"] if rollup else labels
        match = F.lit(True)
        for label in on:
            match = match & result[label].eqNullSafe(other[label])
        keep = [result[c] for c in result.columns]
        added = [other[c] for c in other.columns if c not in on]
        if rollup:  # groups without any value have no bitmap
            added = [F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(added, other.columns[len(on) :], strict=True)]
        result = result.join(other, match, "left" if rollup else "inner").select(*keep, *added)
    for m in measures:
        if m.aggregate == "difference":
            result = result.withColumn(m.name, col(m.of[0]) - col(m.of[1]))
        elif m.aggregate == "ratio":
            result = result.withColumn(m.name, F.try_divide(col(m.of[0]), col(m.of[1])))
    tail = ["level"] if rollup else []
    return result.select(*[col(c) for c in (*labels, *tail, *[m.name for m in measures])])


def _labels(fields: list[tuple[str, str]]) -> list[str]:
    """Output names: the column's, or ``Table[Column]`` where two fields share it."""
    names = [c.lower() for _, c in fields]
    return [c if names.count(c.lower()) == 1 else f"{t}[{c}]" for t, c in fields]


def _aggregate(grouped, aggs: list[Column]) -> DataFrame:  # noqa: ANN001
    return grouped.agg(*aggs) if aggs else grouped.agg(F.count("*").alias("__rows"))


def _grouped_with_values(fact: DataFrame, group: list[str], plain: list[Measure], counted: list[Measure]) -> DataFrame:
    """The fact grouped once, with a row per counted column and value; plain parts are in those of the first column."""
    values = [
        F.struct(F.lit(i).alias("i"), *[(col(m.column) if i == j else F.lit(None)).alias(f"v{j}") for j, m in enumerate(counted)])
        for i in range(len(counted))
    ]
    rows = fact.withColumn("__value", F.explode(F.array(*values)))
    first = F.col("__value.i") == 0
    parts = [v.alias(f"{p.name}:{k}") for p in plain for k, v in _partial(p, first).items()]
    return _aggregate(rows.groupBy(*[col(g) for g in group], F.col("__value").alias("__value")), parts)


def _rolled_up(star: StarDesign, rows: DataFrame, fields: list, plain: list[Measure], counted: list[Measure]) -> list[DataFrame]:
    """Plain measures of all levels, then a table of distinct counts per column."""
    finals = [_final(p).alias(p.name) for p in plain]
    results = [_by(star, rows.where("__value.i = 0"), fields, finals, True)]
    names = _labels(fields)
    shown = [col(c if t == star.fact else f"{t}.{c}").alias(n) for (t, c), n in zip(fields, names, strict=True)]
    for i, m in enumerate(counted):
        values = rows.where(F.col("__value.i") == i).select(*shown, F.col(f"__value.v{i}").alias("__v"))
        results.append(distinct_rollup(values, names, "__v", m.name))
    return results


def _relation(star: StarDesign, table: str, use: list[Relationship]) -> Relationship:
    chosen = next((r for r in use if r.to_table == table), None) or star.active(table)
    if chosen is None:
        raise ValueError(f"{star.fact} has no relationship to {table}")
    return chosen


def _needed(star: StarDesign, table: str, relation: Relationship, fields: list, filters: dict) -> DataFrame:
    """A dimension's key and wanted columns, named so that they cannot clash, filters applied."""
    dim = star.tables[table]
    for field, allowed in filters.items():
        t, column = _split(field)
        if t == table:
            dim = dim.filter(col(column).isin(list(allowed)))
    wanted = [c for t, c in fields if t == table]
    return dim.select(
        col(relation.to_column).alias(f"__key:{table}"), *[col(c).alias(f"{table}.{c}") for c in dict.fromkeys(wanted)]
    )


def _joined(rows: DataFrame, dim: DataFrame, table: str, relation: Relationship, limited: bool) -> DataFrame:
    # A filtered dimension also filters the fact; otherwise unmatched rows show as blank.
    match = rows[_q(relation.from_column)] == dim[_q(f"__key:{table}")]
    return rows.join(dim, match, "inner" if limited else "left").drop(f"__key:{table}")


def _by(star, rows, fields, finals, rollup) -> DataFrame:  # noqa: ANN001
    names = _labels(fields)
    labels = [
        col(c if t == star.fact else f"{t}.{c}").alias(n) for (t, c), n in zip(fields, names, strict=True)
    ]
    if rollup:
        level = F.grouping_id().cast("bigint").alias("level")
        return rows.rollup(*labels).agg(level, *finals)
    return rows.groupBy(*labels).agg(*finals)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def hierarchy_rollup(star: StarDesign, measures: list[Measure], table: str, levels: list[str], **kw) -> DataFrame:  # noqa: ANN003
    """Subtotals along a hierarchy. ``level`` is the grouping id: 0 is the most detailed row."""
    return measure_by(star, measures, [f"{table}[{c}]" for c in levels], rollup=True, **kw)


def visual_query(
    star: StarDesign,
    category: list[str],
    values: list[Measure],
    legend: str | None = None,
    filters: list[dict[str, list]] = (),
) -> DataFrame:
    """The data of one visual: categories and an optional legend by values.

    Report and page filters are ``{field: allowed values}``; all of them must hold.
    """
    merged: dict[str, list] = {}
    for one in filters:
        for field, allowed in one.items():
            if not allowed:
                continue  # an empty list means the filter is not set
            merged[field] = [v for v in merged.get(field, allowed) if v in set(allowed)]
    fields = [*category, *([legend] if legend else [])]
    return measure_by(star, values, fields, merged)
