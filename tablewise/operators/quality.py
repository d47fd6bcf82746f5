"""Data-quality checks. Each takes ``(df, profile)`` and returns a DataFrame of issues.

Data is reported, never changed. Counts are exact. Examples are ordered by value, because a
distributed table has no row order.

Checks of single values are ``CountedCheck``s: they declare which counted values to add up and which to
show, and ``run_counted`` answers all of them with one aggregate over the stored counts and one more
for the examples. Any other function of ``(df, profile)`` is a check as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewise.functions import columns as C
from tablewise.functions.columns import col
from tablewise.functions.text import bounded, category_key, share_text, trim_u
from tablewise.operators import counts
from tablewise.operators.profile import ATTRIBUTE, KEYS, MEASURE, Profile

EXAMPLES = 5
IQR_FACTOR = 3.0
OUTLIER_ROWS = 20
PARSED_SHARE = 0.95
CATEGORY_MAX_DISTINCT = 1_000

ERROR, WARNING, INFO = "error", "warning", "info"

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("affected_rows", T.LongType()),
        T.StructField("description", T.StringType()),
        T.StructField("examples", T.ArrayType(T.StringType())),
    ]
)

# Texts that are numbers, and the date formats tried, each with its shape.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}


def _issues(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)


def missing_values(df: DataFrame, profile: Profile) -> DataFrame:
    is_key = F.col("role").isin(*KEYS)
    share = F.concat(F.format_number(F.try_divide("null_count", "rows") * 100, 1), F.lit("%"))
    text = F.concat(
        F.col("column"),
        F.lit(" is empty in "),
        F.format_number("null_count", 0),
        F.lit(" rows, "),
        share,
        F.when(is_key, " of all. As a key it leads these rows nowhere.").otherwise(" of all."),
    )
    return profile.frame.filter("null_count > 0").select(
        F.lit("missing_values").alias("kind"),
        F.when(is_key, ERROR).otherwise(WARNING).alias("severity"),
        "column",
        F.col("null_count").alias("affected_rows"),
        text.alias("description"),
        F.array().cast("array<string>").alias("examples"),
    )


def blank_strings(df: DataFrame, profile: Profile) -> DataFrame:
    text = F.concat(
        F.col("column"),
        F.lit(" holds nothing but blanks in "),
        F.format_number("blank_count", 0),
        F.lit(" rows."),
    )
    return profile.frame.filter("blank_count > 0").select(
        F.lit("blank_strings").alias("kind"),
        F.lit(WARNING).alias("severity"),
        "column",
        F.col("blank_count").alias("affected_rows"),
        text.alias("description"),
        F.array().cast("array<string>").alias("examples"),
    )


def constant_columns(df: DataFrame, profile: Profile) -> DataFrame:
    single = (F.col("distinct_count") == 1) & (F.col("rows") > 1) & (F.size("top_values") > 0)
    quote_ = F.when(F.col("logical_type") == C.STRING, "'").otherwise("")
    text = F.concat(
        F.col("column"),
        F.lit(" is "),
        quote_,
        F.when(F.col("logical_type") == C.BOOLEAN, F.initcap(F.col("top_values")[0]["value"])).otherwise(
            F.col("top_values")[0]["value"]
        ),
        quote_,
        F.lit(" wherever it is filled."),
    )
    return profile.frame.filter(single).select(
        F.lit("constant_column").alias("kind"),
        F.lit(INFO).alias("severity"),
        "column",
        F.lit(0).cast("bigint").alias("affected_rows"),
        text.alias("description"),
        F.array().cast("array<string>").alias("examples"),
    )


def duplicate_rows(df: DataFrame, profile: Profile) -> DataFrame:
    repeated = profile.duplicate_rows
    if not repeated:
        return _issues(df, [])
    groups = profile.duplicates
    order = [col(n) for n in df.columns]
    rendered = [
        bounded(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name)
        for f in C.comparable(df).schema.fields
    ]
    examples = groups.orderBy(*order).limit(EXAMPLES).select(F.to_json(F.struct(*rendered)).alias("j"))
    return examples.agg(F.sort_array(F.collect_list("j")).alias("examples")).select(
        F.lit("duplicate_rows").alias("kind"),
        F.lit(WARNING).alias("severity"),
        F.lit(None).cast("string").alias("column"),
        F.lit(repeated).cast("bigint").alias("affected_rows"),
        F.lit(f"{repeated:,} rows repeat another one in every column.").alias("description"),
        "examples",
    )


def category_variants(df: DataFrame | counts.CountedTable, names: list[str]) -> DataFrame:
    """Groups of spellings that differ only by case or blanks, one row per group.

    ``(column, norm, canonical, variants, affected)``; the canonical spelling is the most
    frequent one, ties going to the smallest.
    """
    if isinstance(df, counts.CountedTable):
        values = counts.value_counts(counts.CountedTable(df.source, df.present(names)))
    else:
        values = counts.value_counts(df.select(*[col(n) for n in names])).filter("value IS NOT NULL")
    spelled = values.withColumn("norm", category_key(F.col("value")))
    entry = F.struct((-F.col("n")).alias("m"), F.col("value").alias("raw"))
    # Spellings of one category are few: the columns hold at most 1000 values each.
    groups = spelled.groupBy("column", "norm").agg(
        F.sort_array(F.collect_list(entry)).alias("spellings")
    )
    first = F.col("spellings")[0]["raw"]
    rest = F.slice("spellings", F.lit(2), F.size("spellings"))
    return groups.filter(F.size("spellings") > 1).select(
        "column",
        "norm",
        first.alias("canonical"),
        F.transform(rest, lambda s: s["raw"]).alias("variants"),
        F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, s: a - s["m"]).alias("affected"),
    )


def inconsistent_categories(df: DataFrame, profile: Profile) -> DataFrame:
    names = [
        c["column"]
        for c in profile.by_role(ATTRIBUTE)
        if c["logical_type"] == C.STRING and c["distinct_count"] <= CATEGORY_MAX_DISTINCT
    ]
    if not names:
        return _issues(df, [])
    cut = F.struct(
        bounded(F.col("canonical")).alias("canonical"),
        F.transform("variants", lambda v: bounded(v)).alias("variants"),
    )
    example = F.struct("norm", F.to_json(cut).alias("text"))
    found = category_variants(profile.counted, names).groupBy("column").agg(
        F.sum("affected").alias("affected_rows"),
        F.count("*").alias("groups"),
        F.slice(F.sort_array(F.collect_list(example)), 1, EXAMPLES).alias("first"),
    )
    text = F.concat(
        F.col("groups").cast("string"),
        F.lit(" categories of "),
        F.col("column"),
        F.lit(" are spelled in several ways (case, blanks); "),
        F.format_number("affected_rows", 0),
        F.lit(" rows have one of the rarer spellings."),
    )
    return found.select(
        F.lit("inconsistent_categories").alias("kind"),
        F.lit(WARNING).alias("severity"),
        "column",
        "affected_rows",
        text.alias("description"),
        F.transform("first", lambda e: e["text"]).alias("examples"),
    )


def outlier_fences(profile: Profile) -> dict[str, tuple[float, float]]:
    """Per measure the exact lower and upper fence, three interquartile ranges out."""
    names = [
        c["column"] for c in profile.by_role(MEASURE) if c["rows"] - c["null_count"] >= OUTLIER_ROWS
    ]
    fences = {}
    for n, (q1, q3) in (profile.quartiles(names) if names else {}).items():
        if q1 != q3:
            spread = IQR_FACTOR * (q3 - q1)
            fences[n] = (q1 - spread, q3 + spread)
    return fences


# -- checks of counted values -----------------------------------------------------------------
Totals = dict[str, dict[str, int]]


@dataclass(frozen=True)
class Shown:
    """Examples wanted: counted values of ``columns`` passing ``test``, the first by number or by text."""

    columns: list[str]
    test: Column
    number: Column | None = None
    text: Column | None = None


class CountedCheck:
    """A check that follows from the counted values of its columns.

    ``sums`` names the rows to be counted, ``{label: (columns, test)}``, from the profile alone; ``shown`` asks
    for examples once these are known; ``rows`` writes the issues. Tests read a cell ``(l, d, s)`` and
    its trimmed text ``t``.
    """

    name = ""

    def sums(self, profile: Profile) -> dict[str, tuple[list[str], Column]]:
        raise NotImplementedError

    def shown(self, profile: Profile, totals: Totals) -> Shown | None:
        return None

    def rows(self, profile: Profile, totals: Totals, examples: dict[str, list]) -> list[tuple]:
        raise NotImplementedError

    def __call__(self, df: DataFrame, profile: Profile) -> DataFrame:
        return _issues(df, run_counted([self], profile)[self.name])


def _by_column(table: counts.CountedTable, values: dict[str, float], missing: float) -> Column:
    """A literal of each column, picked by the cell's ``idx``."""
    out = F.lit(missing)
    for name, value in values.items():
        out = F.when(F.col("idx") == table.index(name), F.lit(value)).otherwise(out)
    return out


def _tallied(table: counts.CountedTable, wanted: dict[str, tuple[list[str], Column]]) -> Totals:
    """Rows passing each test, by label and column: one aggregate over the counted values."""
    names = list(dict.fromkeys(n for columns, _ in wanted.values() for n in columns))
    if not names:
        return {label: {} for label in wanted}
    aggs = []
    for i, (columns, test) in enumerate(wanted.values()):
        own = F.col("idx").isin([table.index(n) for n in columns]) if columns else F.lit(False)
        aggs.append(F.sum(F.when(own & test, F.col("n"))).alias(f"x{i}"))
    cells = table.present(names).withColumn("t", trim_u(F.col("s")))
    found = {r["idx"]: r for r in cells.groupBy("idx").agg(*aggs).collect()}
    result: Totals = {}
    for i, (label, (columns, _)) in enumerate(wanted.items()):
        rows = {n: found.get(table.index(n)) for n in columns}
        result[label] = {n: (r[f"x{i}"] or 0) if r else 0 for n, r in rows.items()}
    return result


def _examples(table: counts.CountedTable, wanted: dict[str, Shown]) -> dict[str, dict[str, list]]:
    """The first values asked for by each check and column, with their number of rows."""
    result: dict[str, dict[str, list]] = {name: {} for name in wanted}
    names = list(dict.fromkeys(n for s in wanted.values() for n in s.columns))
    if not names:
        return result
    picks = []
    for name, ask in wanted.items():
        own = F.col("idx").isin([table.index(n) for n in ask.columns])
        entry = F.struct(
            F.lit(name).alias("check"),
            (ask.number if ask.number is not None else F.lit(None).cast("double")).alias("number"),
            (ask.text if ask.text is not None else F.lit(None).cast("string")).alias("text"),
        )
        picks.append(F.when(own & ask.test, entry))
    cells = table.present(names).withColumn("t", trim_u(F.col("s")))
    each = cells.select("idx", "n", F.explode(F.array_compact(F.array(*picks))).alias("e"))
    values = each.groupBy("e.check", "idx", "e.number", "e.text").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("check", "idx").orderBy("number", "text"))
    first = values.withColumn("rn", rank).filter(F.col("rn") <= EXAMPLES)
    shown = first.select("check", "idx", "rn", "number", bounded(F.col("text")).alias("text"), "n")
    for r in sorted(shown.collect(), key=lambda r: (r["check"], r["idx"], r["rn"])):
        own = result[r["check"]].setdefault(table.source.columns[r["idx"]], [])
        own.append((r["number"] if r["text"] is None else r["text"], r["n"]))
    return result


def run_counted(checks: list[CountedCheck], profile: Profile) -> dict[str, list[tuple]]:
    """Issues of all ``checks`` by name: their sums are one aggregate, their examples another."""
    wanted = {c.name: c.sums(profile) for c in checks}
    flat = {f"{name}/{label}": ask for name, sums in wanted.items() for label, ask in sums.items()}
    tallied = _tallied(profile.counted, flat) if flat else {}
    totals = {n: {label: tallied[f"{n}/{label}"] for label in sums} for n, sums in wanted.items()}
    asked = {c.name: c.shown(profile, totals[c.name]) for c in checks if wanted[c.name]}
    found = _examples(profile.counted, {n: ask for n, ask in asked.items() if ask is not None and ask.columns})
    return {c.name: c.rows(profile, totals[c.name], found.get(c.name, {})) for c in checks}


def _repeated(found: list[tuple[float, int]], sign: int = 1) -> list[str | None]:
    """Example numbers, each as often as it occurs."""
    shown = [sign * v for v, n in found for _ in range(min(n, EXAMPLES))]
    return [str(v) if abs(v) < float("inf") else None for v in shown[:EXAMPLES]]


class Outliers(CountedCheck):
    name = "outliers"

    def _outside(self, profile: Profile) -> tuple[dict, Column]:
        fences = outlier_fences(profile)
        low = _by_column(profile.counted, {n: f[0] for n, f in fences.items()}, float("-inf"))
        high = _by_column(profile.counted, {n: f[1] for n, f in fences.items()}, float("inf"))
        value = counts.cell_number()
        return fences, (value < low) | (value > high)

    def sums(self, profile: Profile) -> dict[str, tuple[list[str], Column]]:
        fences, outside = self._outside(profile)
        return {"outside": (list(fences), outside)} if fences else {}

    def shown(self, profile: Profile, totals: Totals) -> Shown:
        hit = [n for n, count in totals["outside"].items() if count]
        return Shown(hit, self._outside(profile)[1], number=-counts.cell_number())

    def rows(self, profile: Profile, totals: Totals, examples: dict[str, list]) -> list[tuple]:
        result = []
        for n, (low, high) in outlier_fences(profile).items():
            affected = totals["outside"][n]
            if affected:
                text = (
                    f"{affected:,} rows have a {n} beyond {low:,.2f} to {high:,.2f}, which is three "
                    "interquartile ranges out. They are still in the data."
                )
                result.append((self.name, INFO, n, affected, text, _repeated(examples[n], -1)))
        return result


class NegativeValues(CountedCheck):
    name = "negative_values"

    def sums(self, profile: Profile) -> dict[str, tuple[list[str], Column]]:
        # The profile already knows each minimum.
        names = [c["column"] for c in profile.by_role(MEASURE) if c["min"] and c["min"].startswith("-")]
        return {"below": (names, counts.cell_number() < 0)} if names else {}

    def shown(self, profile: Profile, totals: Totals) -> Shown:
        hit = [n for n, count in totals["below"].items() if count]
        return Shown(hit, counts.cell_number() < 0, number=counts.cell_number())

    def rows(self, profile: Profile, totals: Totals, examples: dict[str, list]) -> list[tuple]:
        result = []
        for n, affected in totals.get("below", {}).items():
            if affected:
                text = f"{affected:,} rows have a {n} below zero. Find out whether they are returns or mistakes."
                result.append((self.name, INFO, n, affected, text, _repeated(examples[n])))
        return result


def _as_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).rlike(NUMBER)


def _as_date(text: Column, fmt: str) -> Column:
    # Parsing raises and catches inside on failure, so only texts of the right shape try.
    return F.coalesce(
        F.when(text.rlike(DATE_FORMATS[fmt]), F.try_to_date(text, fmt).isNotNull()), F.lit(False)
    )


class TypeMismatch(CountedCheck):
    """Text columns that are at least 95% numbers, or dates of one format; each value is parsed once."""

    name = "type_mismatch"

    def sums(self, profile: Profile) -> dict[str, tuple[list[str], Column]]:
        names = [
            c["column"]
            for c in profile.columns
            if c["logical_type"] == C.STRING and c["role"] not in KEYS and c["distinct_count"]
        ]
        if not names:
            return {}
        t = F.col("t")
        filled, digit = t != "", t.rlike(r"^\d")
        dates = {f: (names, filled & digit & _as_date(t, f)) for f in DATE_FORMATS}
        return {"filled": (names, filled), "numbers": (names, filled & _as_number(t)), **dates}

    def types(self, totals: Totals) -> dict[str, tuple[str, str, int, int]]:
        """``(target, format, parsed, filled)`` per column that is no text."""
        result = {}
        for n, filled in totals.get("filled", {}).items():
            best = max(DATE_FORMATS, key=lambda f: totals[f][n])
            if filled and totals["numbers"][n] / filled >= PARSED_SHARE:
                result[n] = ("numbers", "", totals["numbers"][n], filled)
            elif filled and totals[best][n] / filled >= PARSED_SHARE:
                result[n] = ("dates", best, totals[best][n], filled)
        return result

    def shown(self, profile: Profile, totals: Totals) -> Shown:
        t, bad, hit = F.col("t"), F.lit(False), []
        for n, (target, fmt, parsed, filled) in self.types(totals).items():
            if parsed < filled:
                ok = _as_number(t) if target == "numbers" else _as_date(t, fmt)
                bad = bad | ((F.col("idx") == profile.counted.index(n)) & ~ok)
                hit.append(n)
        return Shown(hit, (t != "") & bad, text=t)

    def rows(self, profile: Profile, totals: Totals, examples: dict[str, list]) -> list[tuple]:
        result = []
        for n, (target, _, parsed, filled) in self.types(totals).items():
            bad = filled - parsed
            text = (
                f"{share_text(parsed, filled)} of the texts in {n} are {target}; the other {bad:,} "
                "cannot be read as such."
            )
            result.append((self.name, WARNING, n, bad, text, [v for v, _ in examples.get(n, [])]))
        return result


outliers, negative_values, type_mismatch = Outliers(), NegativeValues(), TypeMismatch()

Check = Callable[[DataFrame, Profile], DataFrame]
CHECKS: dict[str, Check] = {
    "missing_values": missing_values,
    "blank_strings": blank_strings,
    "duplicate_rows": duplicate_rows,
    "inconsistent_categories": inconsistent_categories,
    "outliers": outliers,
    "negative_values": negative_values,
    "type_mismatch": type_mismatch,
    "constant_columns": constant_columns,
}


def check_quality(
    df: DataFrame, profile: Profile, checks: dict[str, Check] | None = None
) -> DataFrame:
    """All issues with their ``position``: by severity, then rows affected, then check order.

    Checks of counted values are run as one. Issues are bounded by columns times checks.
    """
    wanted = checks or CHECKS
    counted = run_counted([c for c in wanted.values() if isinstance(c, CountedCheck)], profile)
    order = {c["column"]: c["ordinal"] for c in profile.columns}
    rows = []
    for check in wanted.values():
        if isinstance(check, CountedCheck):
            found = counted[check.name]
        else:
            found = check(df, profile).select(*ISSUE_SCHEMA.fieldNames()).collect()
        rows += sorted((tuple(r) for r in found), key=lambda r: order.get(r[2], -1))
    weight = {ERROR: 0, WARNING: 1, INFO: 2}
    rows.sort(key=lambda r: (weight[r[1]], -r[3]))
    schema = T.StructType([T.StructField("position", T.IntegerType()), *ISSUE_SCHEMA.fields])
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], schema)


def quality_summary(issues: DataFrame) -> DataFrame:
    """Issues per severity, and whether the table passes (it has no error)."""
    n = {s: F.count_if(F.col("severity") == s).alias(s + "s") for s in (ERROR, WARNING, INFO)}
    return issues.agg(*n.values()).withColumn("passed", F.col("errors") == 0)
