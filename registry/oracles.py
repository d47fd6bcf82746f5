"""The SQL twin of each registered query, for DuckDB over the same tables."""

from __future__ import annotations

from registry.tables import DATES, DIRTY, DIRTY_SQL, FLAT, FLAT_SQL, INTEGERS, NUMBERS, TEXTS

ORACLES: dict[str, str] = {}

DIRTY_WITH = f"WITH {DIRTY_SQL}"
FLAT_WITH = f"WITH {FLAT_SQL}"
# White_Space characters; RE2 has no Unicode class for them.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
GAP = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ID_LIKE = (
    r"regexp_matches(column_name, '(?i)(^|[_\s\-])(id|key|code|no|num|number)$') OR "
    r"regexp_matches(column_name, '[a-z0-9](ID|Id|Key|Code|No|Num|Number)$')"
)


def trim_u(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def category_key(c: str) -> str:
    return f"lower(regexp_replace({trim_u(c)}, '{WS}+', ' ', 'g'))"


def value_key(c: str) -> str:
    return f"lower({trim_u(c)})"


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def kind(c: str) -> str:
    if c in INTEGERS:
        return "integer"
    return "date" if c in DATES else "decimal" if c in NUMBERS else "string"


# -- profiling --------------------------------------------------------------------------------
_nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in DIRTY)
ORACLES["profile_totals"] = f"""{DIRTY_WITH}
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST({len(DIRTY)} AS BIGINT) AS "columns",
  CAST({_nulls} AS BIGINT) AS missing_values,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS BIGINT) AS duplicate_rows
FROM dirty"""

_counts = union(
    [
        f"SELECT {i} AS ord, '{c}' AS column_name, '{kind(c)}' AS logical_type, count(*) AS n_rows, "
        f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM dirty"
        for i, c in enumerate(DIRTY)
    ]
)
ORACLES["profile_columns"] = f"""{DIRTY_WITH}, c AS ({_counts})
SELECT column_name, n_rows, null_count, distinct_count, round(null_count / n_rows, 6) AS null_ratio,
  round(distinct_count / (n_rows - null_count), 6) AS distinct_ratio FROM c"""

ORACLES["numeric_stats"] = f"{DIRTY_WITH} " + union(
    [
        f"SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 4) AS min_value, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max_value, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, round(CAST(median({c}) AS DOUBLE), 4) AS median FROM dirty"
        for c in (*INTEGERS, *NUMBERS)
    ]
)
ORACLES["value_counts"] = f"{DIRTY_WITH} " + union(
    [
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS val, count(*) AS n FROM dirty GROUP BY {c}"
        for c in ("Brand", "CustomerID", "Priority", "ShipDate")
    ]
)
_cut = "CASE WHEN length(val) > 100 THEN left(val, 99) || '…' ELSE val END"
ORACLES["top_values"] = f"{DIRTY_WITH}, t AS (" + union(
    [
        f"SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn, "
        f"CAST({c} AS VARCHAR) AS val, count(*) AS n, count(*) OVER () AS size FROM dirty "
        f"WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in DIRTY
        if c not in DATES
    ]
) + f""")
SELECT column_name, rn, {_cut} AS val, n FROM t WHERE rn <= 5
  AND (size <= 1000 OR column_name IN ({", ".join(f"'{c}'" for c in TEXTS)}))"""

ROLES = rf"""r AS (SELECT *, n_rows - null_count AS filled, {ID_LIKE} AS id_like,
  distinct_count = n_rows - null_count AS uniq FROM c),
roles AS (SELECT *, CASE WHEN filled = 0 THEN 'unknown' WHEN logical_type IN ('date', 'datetime') THEN 'date'
  WHEN id_like THEN CASE WHEN uniq THEN 'key' ELSE 'foreign_key' END
  WHEN logical_type = 'integer' AND regexp_matches(column_name, '(?i)(year|month|quarter|week|day|hour|zip|postal|postcode|phone|rank|level|rating|line|seq|sequence|index|position|sort)')
    THEN 'dimension_attribute'
  WHEN logical_type IN ('integer', 'decimal') THEN 'measure'
  WHEN uniq AND filled >= 20 THEN 'identifier'
  WHEN distinct_count <= 50 OR distinct_count / filled <= 0.5 THEN 'dimension_attribute'
  ELSE 'identifier' END AS role FROM r)"""
ORACLES["column_roles"] = rf"""{DIRTY_WITH}, c AS ({_counts}), {ROLES}
SELECT column_name, logical_type, role, CASE
  WHEN role = 'date' THEN 'date/datetime type'
  WHEN role = 'key' THEN 'id-like name, unique values'
  WHEN role = 'foreign_key' THEN 'id-like name, repeated values'
  WHEN role = 'measure' AND regexp_matches(column_name, '(?i)(price|rate|pct|percent|ratio|avg|average|margin|score|per_?unit)')
    THEN 'numeric values; non-additive (price/rate): average instead of sum'
  WHEN role = 'measure' THEN 'numeric values'
  WHEN logical_type = 'integer' THEN 'integer label (name suggests a code/period)'
  WHEN role = 'dimension_attribute' THEN 'text with repeated values'
  WHEN uniq AND filled >= 20 THEN 'text with a unique value per row'
  ELSE 'high-cardinality text' END AS reason,
  CASE WHEN role = 'measure' THEN NOT regexp_matches(column_name, '(?i)(price|rate|pct|percent|ratio|avg|average|margin|score|per_?unit)') END AS additive,
  null_count > 0 AS nullable
FROM roles"""
_iso_micro = (
    "CASE WHEN date_part('microsecond', {0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END"
)
ORACLES["event_roles"] = f"""
SELECT 'event_id' AS column_name, 'key' AS role, count(DISTINCT event_id) AS distinct_count,
  CAST(min(event_id) AS VARCHAR) AS "min", CAST(max(event_id) AS VARCHAR) AS "max" FROM events
UNION ALL SELECT 'ts', 'date', count(DISTINCT ts), {_iso_micro.format('min(ts)')},
  {_iso_micro.format('max(ts)')} FROM events
UNION ALL SELECT 'user_id', CASE WHEN count(DISTINCT user_id) = count(*) THEN 'key' ELSE 'foreign_key' END,
  count(DISTINCT user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR) FROM events
UNION ALL SELECT 'event_type', 'dimension_attribute', count(DISTINCT event_type), NULL, NULL FROM events
UNION ALL SELECT 'value', 'measure', count(DISTINCT value), CAST(min(value) AS VARCHAR),
  CAST(max(value) AS VARCHAR) FROM events
UNION ALL SELECT 'props', CASE WHEN count(DISTINCT props) <= greatest(50, 0.5 * count(*))
  THEN 'dimension_attribute' ELSE 'identifier' END, count(DISTINCT props), NULL, NULL FROM events"""

# -- quality ----------------------------------------------------------------------------------
MISSING = union(
    [
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n, count(*) AS total FROM dirty"
        for c in DIRTY
    ]
)
_is_key = "column_name LIKE '%ID'"
ORACLES["quality_missing"] = f"""{DIRTY_WITH}, m AS ({MISSING})
SELECT 'missing_values' AS kind, CASE WHEN {_is_key} THEN 'error' ELSE 'warning' END AS severity,
  column_name, n AS affected_rows,
  column_name || format(' is empty in {{:,}} rows, {{:.1f}}%', n, n / total * 100)
  || CASE WHEN {_is_key} THEN ' of all. As a key it leads these rows nowhere.' ELSE ' of all.' END
  AS description, '' AS examples FROM m WHERE n > 0"""
BLANK = union(
    [f"SELECT '{c}' AS column_name, count(*) FILTER ({trim_u(c)} = '') AS n FROM dirty" for c in TEXTS]
)
ORACLES["quality_blank"] = f"""{DIRTY_WITH}, b AS ({BLANK})
SELECT 'blank_strings' AS kind, 'warning' AS severity, column_name, n AS affected_rows,
  column_name || format(' holds nothing but blanks in {{:,}} rows.', n) AS description,
  '' AS examples FROM b WHERE n > 0"""
DUPES = "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n FROM dirty"
ORACLES["quality_duplicates"] = f"""{DIRTY_WITH}, d AS ({DUPES})
SELECT 'duplicate_rows' AS kind, 'warning' AS severity, '-' AS column_name, n AS affected_rows,
  format('{{:,}} rows repeat another one in every column.', n) AS description FROM d WHERE n > 0"""
ORACLES["duplicate_groups"] = f"""{DIRTY_WITH}
SELECT OrderID, OrderLine, ProductID, SupplierID, n AS copies FROM
  (SELECT *, count(*) AS n FROM dirty GROUP BY ALL) WHERE n > 1"""
ORACLES["duplicate_documents"] = """SELECT md5(text) AS text_md5, lang, count(*) AS copies
FROM documents GROUP BY text, lang HAVING count(*) > 1"""


def variants(names: list[str]) -> str:
    values = union(
        [
            f"SELECT '{c}' AS column_name, {c} AS raw, {category_key(c)} AS norm, count(*) AS n "
            f"FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in names
        ]
    )
    return f"""v AS ({values}), k AS (SELECT *, row_number() OVER (PARTITION BY column_name, norm
  ORDER BY n DESC, raw) AS rn, count(*) OVER (PARTITION BY column_name, norm) AS size,
  count(*) OVER (PARTITION BY column_name) AS width FROM v)"""


ORACLES["category_variants"] = f"""{DIRTY_WITH}, {variants(["Brand", "ProductType", "Priority", "Segment", "Region"])}
SELECT column_name, norm, max(raw) FILTER (rn = 1) AS canonical,
  string_agg(raw, '|' ORDER BY rn) FILTER (rn > 1) AS variants,
  CAST(sum(n) FILTER (rn > 1) AS BIGINT) AS affected FROM k WHERE size > 1 GROUP BY column_name, norm"""
# Text columns that are dimension attributes by the role rule, at most 1000 values each.
CATEGORIES = f"""{variants(TEXTS)}, cat AS (SELECT column_name, CAST(sum(n) FILTER (rn > 1) AS BIGINT) AS n,
  count(DISTINCT norm) AS groups FROM k WHERE size > 1 AND width <= 1000 GROUP BY column_name)"""
ORACLES["quality_categories"] = f"""{DIRTY_WITH}, {CATEGORIES}
SELECT 'inconsistent_categories' AS kind, 'warning' AS severity, column_name, n AS affected_rows,
  format('{{}} categories of ', groups) || column_name
  || format(' are spelled in several ways (case, blanks); {{:,}} rows have one of the rarer spellings.', n)
  AS description FROM cat"""


def outlier_parts() -> str:
    parts = []
    for c in NUMBERS:
        parts.append(
            f"o_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS rk, count(*) OVER () AS n "
            f"FROM dirty WHERE {c} IS NOT NULL), "
            f"q_{c} AS (SELECT max(v) FILTER (rk = CAST(floor(0.25 * (n - 1) + 0.5) AS BIGINT)) AS q1, "
            f"max(v) FILTER (rk = CAST(floor(0.75 * (n - 1) + 0.5) AS BIGINT)) AS q3 FROM o_{c}), "
            f"f_{c} AS (SELECT q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi FROM q_{c} WHERE q1 <> q3), "
            f"x_{c} AS (SELECT v, lo, hi, row_number() OVER (ORDER BY v DESC) AS rn FROM o_{c}, f_{c} "
            f"WHERE v < lo OR v > hi)"
        )
    rows = union(
        [
            f"SELECT '{c}' AS column_name, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, "
            f"string_agg(round(v, 2), ' | ' ORDER BY rn) FILTER (rn <= 5) AS examples FROM x_{c} HAVING count(*) > 0"
            for c in NUMBERS
        ]
    )
    return ", ".join(parts) + f", outl AS ({rows})"


ORACLES["quality_outliers"] = f"""{DIRTY_WITH}, {outlier_parts()}
SELECT 'outliers' AS kind, 'info' AS severity, column_name, n AS affected_rows,
  format('{{:,}} rows have a ', n) || column_name
  || format(' beyond {{:,.2f}} to {{:,.2f}}, which is three interquartile ranges out. They are still in the data.', lo, hi)
  AS description, examples FROM outl"""
NEGATIVE = union(
    [
        f"SELECT '{c}' AS column_name, count(*) AS n, string_agg(CAST(v AS VARCHAR), ' | ' ORDER BY v) "
        f"FILTER (rn <= 5) AS examples FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS rn "
        f"FROM dirty WHERE {c} < 0) HAVING count(*) > 0"
        for c in NUMBERS
    ]
)
ORACLES["quality_negative"] = f"""{DIRTY_WITH}, neg AS ({NEGATIVE})
SELECT 'negative_values' AS kind, 'info' AS severity, column_name, n AS affected_rows,
  format('{{:,}} rows have a ', n) || column_name
  || ' below zero. Find out whether they are returns or mistakes.'
  AS description, examples FROM neg"""
_number = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
TYPED = union(
    [
        f"SELECT '{c}' AS column_name, count(*) FILTER (t <> '') AS filled, "
        f"count(*) FILTER (t <> '' AND regexp_matches(replace(t, ',', ''), '{_number}')) AS ok, "
        f"array_to_string(list_sort(list(DISTINCT t) FILTER (t <> '' AND NOT regexp_matches(replace(t, ',', ''), '{_number}')))[1:5], ' | ') "
        f"AS examples FROM (SELECT {trim_u(c)} AS t FROM dirty)"
        for c in TEXTS
    ]
)
ORACLES["quality_text_types"] = f"""{DIRTY_WITH}, t AS ({TYPED})
SELECT 'type_mismatch' AS kind, 'warning' AS severity, column_name, filled - ok AS affected_rows,
  format('{{:.1f}}% of the texts in ', ok / filled * 100) || column_name
  || format(' are numbers; the other {{:,}} cannot be read as such.', filled - ok)
  AS description, examples FROM t WHERE filled > 0 AND ok / filled >= 0.95"""
CONSTANT = union(
    [
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS v, count(DISTINCT {c}) AS n FROM dirty"
        for c in DIRTY
        if c not in DATES
    ]
)
ORACLES["quality_constant"] = f"""{DIRTY_WITH}, k AS ({CONSTANT})
SELECT 'constant_column' AS kind, 'info' AS severity, column_name, CAST(0 AS BIGINT) AS affected_rows,
  column_name || ' is ''' || v || ''' wherever it is filled.' AS description,
  '' AS examples FROM k WHERE n = 1"""
ISSUES = f"""m AS ({MISSING}), b AS ({BLANK}), dd AS ({DUPES}), {CATEGORIES}, {outlier_parts()},
neg AS ({NEGATIVE}), t AS ({TYPED}), ct AS ({CONSTANT}), issues AS (
SELECT 'missing_values' AS kind, CASE WHEN {_is_key} THEN 'error' ELSE 'warning' END AS severity,
  column_name, n AS affected_rows FROM m WHERE n > 0
UNION ALL SELECT 'blank_strings', 'warning', column_name, n FROM b WHERE n > 0
UNION ALL SELECT 'duplicate_rows', 'warning', '-', n FROM dd WHERE n > 0
UNION ALL SELECT 'inconsistent_categories', 'warning', column_name, n FROM cat
UNION ALL SELECT 'outliers', 'info', column_name, n FROM outl
UNION ALL SELECT 'negative_values', 'info', column_name, n FROM neg
UNION ALL SELECT 'type_mismatch', 'warning', column_name, filled - ok FROM t WHERE filled > 0 AND ok / filled >= 0.95
UNION ALL SELECT 'constant_column', 'info', column_name, 0 FROM ct WHERE n = 1)"""
ORACLES["quality_report"] = f"""{DIRTY_WITH}, {ISSUES}
SELECT kind, severity, column_name, CAST(affected_rows AS BIGINT) AS affected_rows FROM issues"""
ORACLES["quality_summary"] = f"""{DIRTY_WITH}, {ISSUES}
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS passed FROM issues"""

# -- metrics ----------------------------------------------------------------------------------
_shown = (
    "CASE WHEN format_hint = 'percent' THEN format('{:,.1f}%', v * 100) "
    "WHEN format_hint = 'integer' OR v = floor(v) THEN format('{:,.0f}', v) "
    "WHEN abs(v) < 1 THEN format('{:,.4f}', v) ELSE format('{:,.2f}', v) END"
)
KPIS = """s AS (SELECT sum(Quantity) AS q, sum(Revenue) AS r, sum(Cost) AS c,
  avg(UnitPrice) AS u, avg(DiscountRate) AS dr, CAST(count(DISTINCT OrderID) AS DOUBLE) AS o FROM dirty),
kp AS (SELECT 1 AS position, 'Total Quantity' AS kpi, 'Sum of Quantity' AS definition, 'sum' AS aggregation,
  'number' AS format_hint, q AS v FROM s
UNION ALL SELECT 2, 'Total Revenue', 'Sum of Revenue', 'sum', 'number', r FROM s
UNION ALL SELECT 3, 'Total Cost', 'Sum of Cost', 'sum', 'number', c FROM s
UNION ALL SELECT 4, 'Average UnitPrice', 'Average of UnitPrice (non-additive, so not summed)', 'average', 'number', u FROM s
UNION ALL SELECT 5, 'Average DiscountRate', 'Average of DiscountRate (non-additive, so not summed)', 'average', 'number', dr FROM s
UNION ALL SELECT 6, 'Total Profit', 'Revenue minus Cost', 'difference', 'number', r - c FROM s
UNION ALL SELECT 7, 'Profit Margin', 'Profit divided by revenue', 'ratio', 'percent', (r - c) / r FROM s
UNION ALL SELECT 8, 'Orders', 'Distinct count of OrderID', 'distinct_count', 'integer', o FROM s
UNION ALL SELECT 9, 'Average Order Value', 'Revenue divided by distinct OrderID', 'ratio', 'number', r / o FROM s)"""
ORACLES["kpis"] = f"""{DIRTY_WITH}, {KPIS}
SELECT CAST(position AS BIGINT) AS position, kpi, definition, aggregation, format_hint,
  round(v, 4) AS val, {_shown} AS shown FROM kp"""
ORACLES["measure_stats"] = f"{DIRTY_WITH} " + union(
    [
        f"SELECT '{c}' AS column_name, round(sum({c}), 2) AS total, round(avg({c}), 4) AS mean, "
        f"round(median({c}), 4) AS median, round(min({c}), 4) AS min_value, round(max({c}), 4) AS max_value FROM dirty"
        for c in NUMBERS
    ]
)
ORACLES["date_ranges"] = f"{DIRTY_WITH} " + union(
    [
        f"SELECT '{c}' AS column_name, strftime(min({c}), '%Y-%m-%d') AS first_day, "
        f"strftime(max({c}), '%Y-%m-%d') AS last_day FROM dirty"
        for c in DATES
    ]
)
MONTHLY = "mon AS (SELECT date_trunc('month', OrderDate) AS m, sum(Revenue) AS v FROM dirty GROUP BY 1)"
ORACLES["monthly_totals"] = f"""{DIRTY_WITH}, {MONTHLY}
SELECT strftime(m, '%Y-%m-%d') AS month, round(v, 2) AS val FROM mon"""
ORACLES["monthly_rows"] = """SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month,
  CAST(count(*) AS DOUBLE) AS val FROM events GROUP BY 1"""
ORACLES["peak_low"] = f"""{DIRTY_WITH}, {MONTHLY}
SELECT count(*) AS months, (SELECT strftime(m, '%Y-%m-%d') FROM mon ORDER BY v DESC, m LIMIT 1) AS peak_month,
  (SELECT strftime(m, '%Y-%m-%d') FROM mon ORDER BY v, m LIMIT 1) AS low_month,
  round(max(v), 2) AS peak_value, round(min(v), 2) AS low_value FROM mon HAVING count(*) >= 3"""
_recent = """rk AS (SELECT v, row_number() OVER (ORDER BY m DESC) AS rn FROM mon),
rc AS (SELECT sum(v) FILTER (rn <= 3) AS recent, sum(v) FILTER (rn BETWEEN 4 AND 6) AS prior FROM rk)"""
ORACLES["recent_change"] = f"""{DIRTY_WITH}, {MONTHLY}, {_recent}
SELECT round(recent, 2) AS recent, round(prior, 2) AS prior, round(recent / prior - 1, 6) AS change FROM rc"""
ORACLES["breakdown_region"] = f"""{DIRTY_WITH}
SELECT Region AS category, round(sum(Revenue), 2) AS val,
  round(sum(Revenue) / (SELECT sum(Revenue) FROM dirty), 6) AS share FROM dirty GROUP BY Region"""
ORACLES["breakdown_customer"] = f"""{DIRTY_WITH}
SELECT coalesce(CAST(CustomerID AS VARCHAR), '(blank)') AS category, CAST(count(*) AS DOUBLE) AS val,
  round(count(*) / (SELECT count(*) FROM dirty), 8) AS share FROM dirty GROUP BY CustomerID"""


def leader(c: str, name: str) -> str:
    return f"""{name} AS (SELECT {c} AS category, sum(Revenue) / (SELECT sum(Revenue) FROM dirty) AS share,
  row_number() OVER (ORDER BY sum(Revenue) DESC, {c} NULLS LAST) AS rn, count(*) OVER () AS size
  FROM dirty GROUP BY {c})"""


ORACLES["top3_share"] = f"""{DIRTY_WITH}, {leader("Nation", "l")}
SELECT max(category) FILTER (rn = 1) AS category, max(size) AS categories,
  round(max(share) FILTER (rn = 1), 6) AS top_share, round(sum(share) FILTER (rn <= 3), 6) AS top3_share FROM l"""
ORACLES["correlations"] = f"{DIRTY_WITH} " + union(
    [
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM dirty"
        for i, a in enumerate(NUMBERS)
        for b in NUMBERS[i + 1 :]
    ]
)
ORACLES["missing_table"] = f"{DIRTY_WITH}, m AS ({MISSING}) SELECT column_name, n AS missing FROM m WHERE n > 0"

_fmt = "CASE WHEN abs({0}) >= 100 THEN format('{{:,.0f}}', {0}) ELSE format('{{:,.2f}}', {0}) END"
_additive = ["Quantity", "Revenue", "Cost"]
_leaders = ", ".join(leader(c, f"l_{c}") for c in TEXTS)
_insight_dims = union(
    [
        f"""SELECT '{c}' AS dim, (SELECT count(DISTINCT {c}) FROM dirty) AS distinct_count,
  format('`{{}}` leads `{c}` with {{:.1f}}% of `Revenue`', coalesce(nullif(trim(max(category) FILTER (rn = 1)), ''), '(blank)'), 100 * max(share) FILTER (rn = 1))
  || CASE WHEN max(size) > 3 THEN format('; the first three of {{}} hold {{:.1f}}%', max(size), 100 * sum(share) FILTER (rn <= 3)) ELSE '' END
  || '.' AS detail FROM l_{c}"""
        for c in TEXTS
    ]
)
_pairs = union(
    [
        f"SELECT {i * 10 + j} AS pos, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM dirty"
        for i, a in enumerate(_additive)
        for j, b in enumerate(_additive)
        if i < j
    ]
)
ORACLES["insights"] = f"""{DIRTY_WITH}, {ISSUES}, {MONTHLY}, {_recent}, {_leaders}, dims AS ({_insight_dims}),
c AS ({_counts}), {ROLES},
best AS (SELECT dims.* FROM dims JOIN roles ON dim = column_name WHERE role = 'dimension_attribute'
  AND dims.distinct_count BETWEEN 2 AND 50 ORDER BY dims.distinct_count, dim LIMIT 4),
pairs AS ({_pairs})
SELECT 'Size' AS title, format('The table has {{:,}} rows in {len(DIRTY)} columns, from {{}} to {{}} by `OrderDate`.',
  count(*), strftime(min(OrderDate), '%Y-%m-%d'), strftime(max(OrderDate), '%Y-%m-%d')) AS detail FROM dirty
UNION ALL SELECT 'Revenue by month', (SELECT format('The best month for `Revenue` is {{}} with {{}}', strftime(m, '%Y-%m'), {_fmt.format("v")}) FROM mon ORDER BY v DESC, m LIMIT 1)
  || (SELECT format(', the weakest {{}} with {{}}.', strftime(m, '%Y-%m'), {_fmt.format("v")}) FROM mon ORDER BY v, m LIMIT 1)
  || (SELECT format(' The last three months changed by {{:+.1f}}% against the three before.', 100 * (recent / prior - 1)) FROM rc)
UNION ALL SELECT 'Revenue by ' || dim, detail FROM best
UNION ALL SELECT a || ' goes with ' || b, format('`{{}}` and `{{}}` correlate with r = {{:.2f}} over {{:,}} rows. ', a, b, r, n)
  || CASE WHEN abs(r) >= 0.98 THEN 'One may well be computed from the other.' ELSE 'Neither need be the cause.' END
  FROM (SELECT * FROM pairs WHERE abs(r) >= 0.7 ORDER BY pos LIMIT 3)
UNION ALL SELECT 'Audit', format('The audit lists {{}} errors, {{}} warnings and {{}} remarks.',
  count(*) FILTER (severity = 'error'), count(*) FILTER (severity = 'warning'), count(*) FILTER (severity = 'info')) FROM issues"""

# -- star schema ------------------------------------------------------------------------------
KEYS = ["OrderID", "CustomerID", "ProductID", "SupplierID"]
ATTRIBUTES = ["OrderLine", *TEXTS]


def dependency(k: str, a: str) -> str:
    norm = value_key(a) if a in TEXTS else a
    keep = f"FROM dirty WHERE {k} IS NOT NULL AND {a} IS NOT NULL"
    return f"""SELECT '{k}' AS key_name, '{a}' AS attribute, (SELECT sum(m) FROM (SELECT max(n) AS m FROM
  (SELECT {k} AS k, count(*) AS n {keep} GROUP BY {k}, {norm}) GROUP BY k)) / (SELECT count(*) {keep}) AS agreement,
  CAST((SELECT count(*) {keep}) - (SELECT sum(m) FROM (SELECT max(n) AS m FROM
  (SELECT {k} AS k, count(*) AS n {keep} GROUP BY {k}, {a}) GROUP BY k)) AS BIGINT) AS conflicting_rows"""


DEPS = union([dependency(k, a) for k in KEYS for a in ATTRIBUTES])
ORACLES["fd_agreement"] = f"""{DIRTY_WITH}, deps AS ({DEPS})
SELECT key_name, attribute, round(agreement, 8) AS agreement, conflicting_rows FROM deps"""
_sizes = "sizes AS (" + union(
    [f"SELECT '{k}' AS k, count(DISTINCT {k}) AS size, count(*) AS total FROM dirty" for k in KEYS]
) + "), usable AS (SELECT deps.*, size FROM deps JOIN sizes ON key_name = k WHERE size < 0.9 * total)"
PLAN = f"""deps AS ({DEPS}), {_sizes}, plan AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY attribute ORDER BY size, key_name) AS rn FROM usable WHERE agreement >= 0.99) WHERE rn = 1)"""
ORACLES["dimension_plan"] = f"""{DIRTY_WITH}, {PLAN} SELECT attribute, key_name, conflicting_rows FROM plan"""
_near = """near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attribute
  ORDER BY agreement DESC, key_name DESC) AS rn FROM usable) WHERE rn = 1 AND agreement >= 0.9 AND agreement < 0.99)"""
ORACLES["near_misses"] = f"""{DIRTY_WITH}, {PLAN}, {_near}
SELECT attribute, key_name, round(agreement, 8) AS agreement, conflicting_rows FROM near"""


def dimension(k: str, attributes: list[str], source: str = "dirty", where: str = "TRUE") -> str:
    """The modal value of each attribute per key, by ranking counted values."""
    modal = "".join(
        f" LEFT JOIN (SELECT k, v FROM (SELECT {k} AS k, {a} AS v, row_number() OVER (PARTITION BY {k} "
        f"ORDER BY count(*) DESC, {a}) AS rn FROM {source} WHERE {where} AND {k} IS NOT NULL AND {a} IS NOT NULL "
        f"GROUP BY {k}, {a}) WHERE rn = 1) m{i} ON m{i}.k = d.k"
        for i, a in enumerate(attributes)
    )
    picked = ", ".join(f"m{i}.v AS {a}" for i, a in enumerate(attributes))
    return (
        f"SELECT d.k AS {k}, {picked} FROM (SELECT DISTINCT {k} AS k FROM {source} "
        f"WHERE {where} AND {k} IS NOT NULL) d{modal}"
    )


CUSTOMER = dimension("CustomerID", ["CustomerName", "Nation", "Region"])
PRODUCT = dimension("ProductID", ["ProductName", "ProductType"])
ORACLES["dim_customer"] = f"{DIRTY_WITH} " + dimension(
    "CustomerID", ["CustomerName", "Segment", "Nation", "Region"]
)
ORACLES["dim_product"] = f"{DIRTY_WITH} " + dimension("ProductID", ["ProductName", "Brand", "ProductType"])
ORACLES["dim_supplier_lines"] = f"{DIRTY_WITH} " + dimension(
    "SupplierID", ["OrderLine", "CustomerName", "ReturnFlag"]
)


def strict(child: str, parent: str, source: str) -> str:
    return (
        f"(SELECT count(*) = count(DISTINCT c) FROM (SELECT DISTINCT {child} AS c, {parent} AS p FROM {source} "
        f"WHERE {child} IS NOT NULL AND {parent} IS NOT NULL))"
    )


_levels = ["Region", "Nation", "CustomerName", "Segment", "OrderStatus"]
ORACLES["strict_determination"] = f"{FLAT_WITH} " + union(
    [
        f"SELECT '{c}' AS child, '{p}' AS parent, {strict(c, p, 'flat')} AS determined"
        for c in _levels
        for p in _levels
        if c != p
    ]
)
ORACLES["hierarchies"] = f"""{DIRTY_WITH}, cust AS MATERIALIZED ({CUSTOMER})
SELECT 'DimCustomer' AS dimension, 'Region > Nation > CustomerName' AS levels
  WHERE {strict("Nation", "Region", "cust")} AND {strict("CustomerName", "Nation", "cust")}
UNION ALL SELECT 'DimDate', 'Year > Quarter > Month > Date'"""
CALENDAR = """cal AS (SELECT CAST(unnest(generate_series(date_trunc('year', lo), date_trunc('year', hi)
  + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS Date FROM
  (SELECT least(min(OrderDate), min(ShipDate)) AS lo, greatest(max(OrderDate), max(ShipDate)) AS hi FROM dirty))"""
_month = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(Date)]"
_weekday = "['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(Date)]"
ORACLES["calendar"] = f"""{DIRTY_WITH}, {CALENDAR}
SELECT strftime(Date, '%Y-%m-%d') AS Date, year(Date) AS Year, 'Q' || quarter(Date) AS Quarter,
  month(Date) AS MonthNumber, {_month} AS Month, strftime(Date, '%Y-%m') AS YearMonth, day(Date) AS Day,
  isodow(Date) AS WeekdayNumber, {_weekday} AS Weekday FROM cal"""
# Attributes that the plan moves out of the fact at every scale of the given tables.
FACT = [
    "OrderID", "OrderLine", "OrderDate", "ShipDate", "CustomerID", "Segment", "ProductID", "SupplierID",
    "ReturnFlag", "Quantity", "Revenue", "Cost", "UnitPrice", "DiscountRate", "WeightText",
]
ORACLES["fact_sales"] = f"{DIRTY_WITH} SELECT " + ", ".join(
    f"strftime({c}, '%Y-%m-%d') AS {c}"
    if c in DATES
    else f"round({c}, 8) AS {c}"
    if c in ("Cost", "UnitPrice", "Revenue")
    else c
    for c in FACT
) + " FROM dirty"
ORACLES["null_fk"] = f"""{DIRTY_WITH}
SELECT 'CustomerID' AS key_name, count(*) FILTER (CustomerID IS NULL) AS missing,
  count(*) FILTER (CustomerID IS NULL AND coalesce(CustomerName, Nation, Region) IS NOT NULL) AS with_values FROM dirty
UNION ALL SELECT 'ProductID', count(*) FILTER (ProductID IS NULL),
  count(*) FILTER (ProductID IS NULL AND coalesce(ProductName, Brand, ProductType) IS NOT NULL) FROM dirty"""
ORACLES["conflicts"] = f"""{DIRTY_WITH}, p AS ({dimension("ProductID", ["Brand"])})
SELECT OrderID, OrderLine, dirty.ProductID, SupplierID, dirty.Brand, p.Brand AS kept
FROM dirty JOIN p ON dirty.ProductID = p.ProductID WHERE dirty.Brand <> p.Brand"""


def grain_search() -> str:
    """Every combination of the candidates in the order they are tried."""
    from itertools import combinations

    candidates = ["OrderLine", "OrderID", "CustomerID", "ProductID", "SupplierID", "OrderDate", "ShipDate"]
    arms = []
    for size in (1, 2, 3):
        for combo in combinations(candidates, size):
            if set(combo) & set(INTEGERS) - {"OrderLine"}:
                filled = " AND ".join(f"{c} IS NOT NULL" for c in combo)
                arms.append(
                    f"WHEN (SELECT count(*) FROM (SELECT DISTINCT {', '.join(combo)} FROM dirty)) = r.n "
                    f"AND (SELECT bool_and({filled}) FROM dirty) "
                    f"THEN '{' + '.join(c for c in DIRTY if c in combo)}'"
                )
    return "\n  ".join(arms)


ORACLES["grain"] = f"""{DIRTY_WITH}, r AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM dirty)),
g AS (SELECT CASE {grain_search()} ELSE '' END AS grain, r.n = (SELECT count(*) FROM dirty) AS same FROM r)
SELECT grain, grain <> '' AND same AS unique_rows FROM g"""
_tables = "CASE key_name WHEN 'OrderID' THEN 'DimOrder' WHEN 'ProductID' THEN 'DimProduct' WHEN 'CustomerID' THEN 'DimCustomer' ELSE 'DimSupplier' END"
ORACLES["star_findings"] = f"""{DIRTY_WITH}, {PLAN}, {_near}, dd AS ({DUPES})
SELECT 'grain' AS topic, 'FactSales' AS table_name, '-' AS column_name, n AS affected_rows FROM dd WHERE n > 0
UNION ALL SELECT 'near_dependency', 'FactSales', attribute, conflicting_rows FROM near
UNION ALL SELECT 'attribute_conflicts', {_tables}, attribute, conflicting_rows FROM plan WHERE conflicting_rows > 0
UNION ALL SELECT 'null_foreign_keys', 'FactSales', 'CustomerID', count(*) FROM dirty WHERE CustomerID IS NULL"""
ORACLES["star_relationships"] = f"""{DIRTY_WITH}, {PLAN}
SELECT DISTINCT 'FactSales' AS from_table, key_name AS from_column, {_tables} AS to_table, key_name AS to_column,
  TRUE AS is_active FROM plan
UNION ALL SELECT 'FactSales', 'OrderDate', 'DimDate', 'Date', TRUE
UNION ALL SELECT 'FactSales', 'ShipDate', 'DimDate', 'Date', FALSE"""
_p3 = ["ProductName", "Brand", "ProductType"]
ORACLES["star_change"] = f"""{DIRTY_WITH}, o AS ({dimension("ProductID", _p3, "flat")}),
n AS (SELECT * REPLACE (CASE WHEN ProductID % 19 = 0 THEN 'Rebranded' ELSE Brand END AS Brand) FROM
  ({dimension("ProductID", _p3, "dirty", "ProductID % 17 <> 0")}))
SELECT 'Currency' AS columns_added, '' AS columns_removed, count(*) FILTER (o.ProductID IS NULL) AS rows_added,
  count(*) FILTER (n.ProductID IS NULL) AS rows_removed, count(*) FILTER (o.ProductID IS NOT NULL AND n.ProductID IS NOT NULL
  AND (o.ProductName IS DISTINCT FROM n.ProductName OR o.Brand IS DISTINCT FROM n.Brand OR o.ProductType IS DISTINCT FROM n.ProductType)) AS rows_changed
FROM o FULL JOIN n ON o.ProductID = n.ProductID"""
_bag = "SELECT OrderID, OrderLine, CustomerID, Segment, Priority FROM"
ORACLES["fact_change"] = f"""{DIRTY_WITH}
SELECT (SELECT count(*) FROM ({_bag} dirty EXCEPT ALL {_bag} flat)) AS rows_added,
  (SELECT count(*) FROM ({_bag} flat EXCEPT ALL {_bag} dirty)) AS rows_removed, CAST(0 AS BIGINT) AS rows_changed"""

# -- checks -----------------------------------------------------------------------------------
_cust = """cust AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3 UNION ALL
  SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 50 = 0),
lost AS (SELECT CustomerID AS k, count(*) AS n FROM dirty WHERE CustomerID IS NOT NULL
  AND CustomerID NOT IN (SELECT c_custkey FROM cust) GROUP BY 1)"""
_first = "(SELECT coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') FROM (SELECT k FROM lost ORDER BY k LIMIT 5))"
ORACLES["key_pair"] = f"""{DIRTY_WITH}, {_cust}
SELECT TRUE AS type_compatible, count(*) = count(DISTINCT c_custkey) AS to_side_unique,
  count(*) - count(c_custkey) AS to_side_nulls, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM lost) AS orphan_rows,
  {_first} AS orphan_examples, (SELECT count(*) FROM dirty WHERE CustomerID IS NULL) AS null_from_rows, FALSE AS ok FROM cust"""
ORACLES["key_pair_labels"] = """WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0),
lost AS (SELECT doc_id AS k, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM d) GROUP BY 1)
SELECT TRUE AS type_compatible, count(*) = count(DISTINCT doc_id) AS to_side_unique, CAST(0 AS BIGINT) AS to_side_nulls,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM lost) AS orphan_rows,
  (SELECT coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') FROM (SELECT k FROM lost ORDER BY k LIMIT 5)) AS orphan_examples,
  (SELECT count(*) FROM labels WHERE doc_id IS NULL) AS null_from_rows,
  count(*) = count(DISTINCT doc_id) AND (SELECT count(*) FROM lost) = 0 AS ok FROM d"""
ORACLES["orphans"] = f"""{DIRTY_WITH}, {_cust}
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS orphan_rows, {_first} AS examples FROM lost"""
_quoted = "(SELECT string_agg('''' || CAST(k AS VARCHAR) || '''', ', ' ORDER BY k) FROM (SELECT k FROM lost ORDER BY k LIMIT 5))"
ORACLES["referential_integrity"] = f"""{DIRTY_WITH}, {_cust}
SELECT 'referential_integrity' AS "check", CASE WHEN sum(n) > 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN sum(n) > 0 THEN 'error' ELSE 'info' END AS severity, 'CustomerID -> c_custkey' AS object,
  CASE WHEN sum(n) > 0 THEN format('{{:,}} orphan rows; e.g. [{{}}]', CAST(sum(n) AS BIGINT), {_quoted}) ELSE '' END AS message FROM lost"""
_state = (
    "SELECT '{0}' AS object, count(*) AS n_rows, count(*) - count({0}) AS nulls, count(DISTINCT {0}) AS distinct_count, "
    "count(*) - count(DISTINCT {0}) - CASE WHEN count({0}) < count(*) THEN 1 ELSE 0 END AS duplicates, "
    "count({0}) = count(DISTINCT {0}) AS values_unique FROM {1}"
)
ORACLES["key_unique"] = f"{DIRTY_WITH}, {_cust} " + union(
    [_state.format(k, t) for k, t in (("CustomerID", "dirty"), ("OrderID", "dirty"), ("c_custkey", "cust"))]
)
_cal = """SELECT '{0}' AS object, count(*) AS n_rows, count(DISTINCT Date) AS n_days,
  strftime(min(Date), '%Y-%m-%d') AS first_day, strftime(max(Date), '%Y-%m-%d') AS last_day,
  date_diff('day', min(Date), max(Date)) + 1 AS day_span,
  count(*) = date_diff('day', min(Date), max(Date)) + 1 AS contiguous FROM cal {1}"""
ORACLES["calendar_checks"] = f"{DIRTY_WITH}, {CALENDAR} " + union(
    [_cal.format("whole", ""), _cal.format("gap", "WHERE Date <> DATE '1996-02-29'")]
)
# The tolerance is relative 1e-9 or absolute 1e-6, against a sum of exact decimals.
_exact = "CAST(sum(CAST({c} AS DECIMAL(38, 12))) AS DOUBLE)"


def _crosscheck(c: str, stats: str, stored: str) -> str:
    exact = _exact.format(c=c)
    gap = f"greatest(1e-9 * greatest(abs({stored}), abs({exact})), 1e-6)"
    return (
        f"SELECT '{stats}' AS stats, 'metrics_match_sql' AS \"check\", CASE WHEN abs({stored} - {exact}) <= {gap} "
        f"THEN 'passed' ELSE 'failed' END AS status, 'metrics:{c}' AS object FROM dirty"
    )


_edited = {"Revenue": "sum(Revenue) + 0.01", "Cost": "sum(Cost) * 1.0001"}
ORACLES["metric_crosscheck"] = f"{DIRTY_WITH} " + union(
    [_crosscheck(c, "stored", f"sum({c})") for c in NUMBERS]
    + [_crosscheck(c, "edited", _edited.get(c, f"sum({c})")) for c in NUMBERS]
)
_dims = {"CustomerID": "DimCustomer", "OrderID": "DimOrder", "ProductID": "DimProduct", "SupplierID": "DimSupplier"}
_links = [
    *[(f"FactSales[{k}] -> {t}[{k}]", k, t) for k, t in _dims.items()],
    *[(f"FactSales[{c}] -> DimDate[Date]", c, "DimDate") for c in DATES],
]


def _found(check: str, obj: str, ok: str, severity: str = "error") -> str:
    return (
        f"SELECT '{check}' AS \"check\", CASE WHEN {ok} THEN 'passed' ELSE 'failed' END AS status, "
        f"CASE WHEN {ok} THEN 'info' ELSE '{severity}' END AS severity, '{obj}' AS object"
    )


_checks = []
for _t in ("FactSales", *_dims.values(), "DimDate"):
    _checks.append(_found("table_data_present", _t, "TRUE"))
    _checks.append(_found("columns_match_data", _t, "TRUE"))
    _checks.append(_found("table_not_empty", _t, "(SELECT count(*) FROM dirty) > 0"))
for _k, _t in _dims.items():
    _ok = "(SELECT count(*) FROM dirty WHERE SupplierID = 5) = 0" if _k == "SupplierID" else "TRUE"
    _checks.append(_found("key_unique_not_null", f"{_t}[{_k}]", _ok))
_checks.append(_found("key_unique_not_null", "DimDate[Date]", "TRUE"))
for _label, _k, _t in _links:
    _one = "(SELECT count(*) FROM dirty WHERE SupplierID = 5) = 0" if _t == "DimSupplier" else "TRUE"
    _lost = "(SELECT count(*) FROM dirty WHERE ProductID = 7) = 0" if _t == "DimProduct" else "TRUE"
    _checks.append(_found("key_types_compatible", _label, "TRUE"))
    _checks.append(_found("cardinality_matches_data", _label, _one))
    _checks.append(_found("no_orphan_keys", _label, _lost))
    _blank = f"(SELECT count(*) FROM dirty WHERE {_k} IS NULL) = 0"
    _checks.append(_found("no_blank_foreign_keys", _label, _blank, "warning"))
_checks.append(_found("date_table_contiguous", "DimDate", "TRUE"))
_checks += [_found("date_table_covers_facts", label, "TRUE") for label, _, t in _links if t == "DimDate"]
_checks.append(_found("fact_rows_match_source", "FactSales", "TRUE"))
ORACLES["findings"] = f"{DIRTY_WITH} " + union(_checks)
ORACLES["findings_report"] = f"""{DIRTY_WITH}
SELECT CAST({len(_checks)} - CASE WHEN b > 0 THEN 1 ELSE 0 END AS BIGINT) AS passed_checks, CAST(0 AS BIGINT) AS failed_errors,
  CAST(CASE WHEN b > 0 THEN 1 ELSE 0 END AS BIGINT) AS failed_warnings, CAST(0 AS BIGINT) AS not_run, TRUE AS passed
FROM (SELECT count(*) AS b FROM dirty WHERE CustomerID IS NULL)"""
def _missing_in(source: str, columns: list[str]) -> str:
    return "(SELECT " + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns) + f" FROM {source})"


def _stored_case(version: str, source: str, columns: list[str]) -> str:
    rows = lambda t: f"(SELECT count(*) FROM {t})"
    checks = {
        "profile_column_count": f"{len(columns)} = {len(DIRTY)}",
        "profile_missing_total": f"{_missing_in(source, columns)} = {_missing_in('dirty', DIRTY)}",
        "null_counts_within_rows": f"{_missing_in('dirty', DIRTY)} <= {len(DIRTY)} * {rows('dirty')}",
        "schema_matches_profile": "TRUE" if columns == DIRTY else "FALSE",
        "quality_matches_profile": f"{rows('dirty')} = {rows(source)}",
        "metrics_match_profile": f"{rows(source)} = {rows(source)}",
    }
    return union(
        [
            f"SELECT '{version}' AS version, '{c}' AS \"check\", CASE WHEN {ok} THEN 'passed' ELSE 'failed' END AS status"
            for c, ok in checks.items()
        ]
    )


ORACLES["stored_results"] = f"{DIRTY_WITH} {_stored_case('own', 'dirty', DIRTY)} UNION ALL {_stored_case('other', 'flat', FLAT)}"
# Versions of a table as SQL; bags of rows are compared with EXCEPT ALL in both directions.
_price = "CASE WHEN {w} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice"
_versions = {
    "orders": "SELECT * FROM orders",
    "half of orders": "SELECT * FROM orders WHERE o_orderkey % 2 = 0",
    "edited orders": f"SELECT * REPLACE ({_price.format(w='o_orderkey % 1000 = 1')}) FROM orders",
}


def same_rows(version: str) -> str:
    return (
        f"(SELECT count(*) FROM (SELECT * FROM orders EXCEPT ALL {version})) + "
        f"(SELECT count(*) FROM ({version} EXCEPT ALL SELECT * FROM orders)) = 0"
    )


ORACLES["source_recheck"] = union(
    [
        f"SELECT 'row_count_matches_source' AS \"check\", CASE WHEN (SELECT count(*) FROM ({v})) = (SELECT count(*) FROM orders) "
        f"THEN 'passed' ELSE 'failed' END AS status, '{n}' AS object"
        for n, v in _versions.items()
    ]
    + [
        f"SELECT 'values_match_source', CASE WHEN {same_rows(v)} THEN 'passed' ELSE 'failed' END, '{n}'"
        for n, v in _versions.items()
    ]
    + [f"SELECT '{c}', 'not_run', 'gone'" for c in ("row_count_matches_source", "values_match_source")]
)
ORACLES["table_fingerprint"] = union(
    [
        f"SELECT '{n}' AS version, {same_rows(v)} AS same_rows"
        for n, v in {
            "shuffled": "SELECT * FROM orders",
            "one cell": f"SELECT * REPLACE ({_price.format(w='o_orderkey = 7')}) FROM orders",
            "a row twice": "SELECT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey = 7)",
            "half": "SELECT * FROM orders WHERE o_orderkey % 2 = 0",
        }.items()
    ]
)
ORACLES["star_leftovers"] = f"""{DIRTY_WITH}, {PLAN}, c AS ({_counts}), {ROLES}
SELECT column_name, 'no key' AS reason FROM roles WHERE role IN ('dimension_attribute', 'identifier')
  AND column_name NOT IN (SELECT attribute FROM plan)
UNION ALL SELECT column_name, 'no attributes' FROM roles WHERE role IN ('key', 'foreign_key') AND distinct_count > 0
  AND distinct_count < 0.9 * n_rows AND column_name NOT IN (SELECT key_name FROM plan)"""
ORACLES["event_star"] = """WITH days AS (SELECT unnest(generate_series(date_trunc('year', (SELECT min(ts) FROM events)),
  date_trunc('year', (SELECT max(ts) FROM events)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day),
n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1)
SELECT year(days.day) AS Year, month(days.day) AS MonthNumber, count(*) AS days, CAST(coalesce(sum(events), 0) AS BIGINT) AS events
FROM days LEFT JOIN n ON CAST(days.day AS DATE) = n.day GROUP BY 1, 2"""

# -- questions to the star --------------------------------------------------------------------
STAR = f"""cust AS ({CUSTOMER}), prod AS ({PRODUCT}), f AS (SELECT dirty.* EXCLUDE (CustomerName, Nation, Region, ProductName, ProductType),
  cust.Region, cust.Nation, prod.ProductType FROM dirty LEFT JOIN cust ON dirty.CustomerID = cust.CustomerID
  LEFT JOIN prod ON dirty.ProductID = prod.ProductID)"""
ORACLES["star_measures"] = f"""{DIRTY_WITH}, {STAR}
SELECT Region, ProductType, round(sum(Revenue), 2) AS revenue, round(sum(Cost), 2) AS cost,
  round(sum(Revenue) - sum(Cost), 2) AS profit, round(min(Revenue), 2) AS min_revenue, round(max(Revenue), 2) AS max_revenue,
  round((sum(Revenue) - sum(Cost)) / nullif(sum(Revenue), 0), 6) AS margin, round(avg(Quantity), 6) AS avg_quantity,
  count(DISTINCT OrderID) AS orders, count(*) AS lines FROM f GROUP BY Region, ProductType"""
ORACLES["role_playing_dates"] = f"""{DIRTY_WITH}
SELECT year(ShipDate) AS Year, 'Q' || quarter(ShipDate) AS Quarter, round(sum(Revenue), 2) AS revenue,
  count(*) AS lines FROM dirty GROUP BY 1, 2"""
ORACLES["hierarchy_rollup_geo"] = f"""{DIRTY_WITH}, {STAR}
SELECT Region, Nation, GROUPING(Region, Nation) AS level, round(sum(Revenue), 2) AS revenue,
  count(DISTINCT OrderID) AS orders FROM f GROUP BY ROLLUP (Region, Nation)"""
ORACLES["hierarchy_rollup_calendar"] = f"""{DIRTY_WITH}, t AS (SELECT year(OrderDate) AS Year,
  'Q' || quarter(OrderDate) AS Quarter, {_month.replace("Date", "OrderDate")} AS Month, Revenue FROM dirty)
SELECT Year, Quarter, Month, GROUPING(Year, Quarter, Month) AS level, round(sum(Revenue), 2) AS revenue,
  count(*) AS lines FROM t GROUP BY ROLLUP (Year, Quarter, Month)"""
ORACLES["hierarchy_rollup_distinct"] = f"""{DIRTY_WITH}, t AS (SELECT year(OrderDate) AS Year,
  'Q' || quarter(OrderDate) AS Quarter, {_month.replace("Date", "OrderDate")} AS Month, * FROM dirty)
SELECT Year, Quarter, Month, GROUPING(Year, Quarter, Month) AS level, count(*) AS lines, count(DISTINCT OrderID) AS orders,
  count(DISTINCT CustomerID) AS customers, count(DISTINCT ProductID) AS products FROM t GROUP BY ROLLUP (Year, Quarter, Month)"""
ORACLES["visual"] = f"""{DIRTY_WITH}, {STAR}
SELECT strftime(OrderDate, '%Y-%m') AS YearMonth, ProductType, round(sum(Revenue), 2) AS revenue,
  count(DISTINCT OrderID) AS orders FROM f WHERE Region = 'EUROPE' AND ReturnFlag IN ('A', 'N')
  AND year(OrderDate) IN (1996, 1997) GROUP BY 1, 2"""

# -- text -------------------------------------------------------------------------------------
_SPACE = GAP
_SECRETS = [
    rf"(?i)Bearer{_SPACE}+[A-Za-z0-9\-._~+/]+=*",
    rf"(?i)(password|pwd){_SPACE}*={_SPACE}*[^;]+",
    r"sk-[A-Za-z0-9_\-]{16,}",
]


def redacted(c: str) -> str:
    for p in _SECRETS:
        c = f"regexp_replace({c}, '{p}', '**********', 'g')"
    return c


def one_line(c: str) -> str:
    return f"replace(regexp_replace(regexp_replace({c}, '{GAP}+', ' ', 'g'), '^ | $', '', 'g'), '`', '''')"


ORACLES["redact_documents"] = f"SELECT doc_id, {redacted('text')} AS text, {redacted('lang')} AS lang FROM documents"
ORACLES["redaction_hits"] = union(
    [
        f"SELECT '{c}' AS column_name, count(*) FILTER ("
        + " OR ".join(f"regexp_matches({c}, '{p}')" for p in _SECRETS)
        + ") AS hits FROM documents"
        for c in ("text", "source")
    ]
)
ORACLES["redact_nested"] = f"""SELECT conv_id, turn, {redacted("role")} AS role,
  CASE WHEN length(text) > 0 THEN '**********' ELSE text END AS api_key, '**********,' || {redacted("role")} AS headers,
  CASE WHEN length(text) > 0 THEN '**********' ELSE text END AS password, {redacted("role")} AS note FROM conversations"""
ORACLES["quoted_values"] = f"""WITH q AS (SELECT page_id, replace({one_line("html")}, '|', '\\|') AS t FROM pages)
SELECT page_id, '`' || CASE WHEN t = '' THEN '(blank)' WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END || '`' AS quoted FROM q"""
ORACLES["escaped_text"] = f"""SELECT page_id, replace(replace(replace(replace(replace({one_line("html")},
  '|', '\\|'), '[', '\\['), ']', '\\]'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages"""
ORACLES["fenced_text"] = """SELECT conv_id, turn, '<untrusted_data source="chat">' || chr(10) ||
  replace(text || '</untrusted_data> done', '</untrusted_data>', '</untrusted_data_>') || chr(10) || '</untrusted_data>' AS fenced
FROM conversations"""
ORACLES["text_keys"] = f"""SELECT doc_id, md5({category_key("text")}) AS category_md5, md5({value_key("text")}) AS value_md5
FROM documents"""
ORACLES["number_formats"] = f"""WITH a AS (SELECT *, o_totalprice / CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 10000 END AS x FROM orders)
SELECT o_orderkey, {_fmt.format("x")} AS amount,
  CASE WHEN o_orderkey = 0 THEN '0%' ELSE format('{{:,.1f}}%', o_custkey / o_orderkey * 100) END AS share FROM a"""

# -- sources and sinks ------------------------------------------------------------------------
ORACLES["csv_ingest"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders"""
ORACLES["xlsx_ingest"] = "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer"
ORACLES["midnight_dates"] = union(
    [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, bool_and(date_trunc('day', {c}) = {c}) AS is_date FROM {t}"
        for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
    ]
)
ORACLES["table_sql"] = """SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus <> 'drop;' GROUP BY 1"""
ORACLES["star_sink"] = f"""{DIRTY_WITH}, {CALENDAR}
SELECT 'FactSales' AS table_name, count(*) AS n_rows FROM dirty
UNION ALL SELECT 'DimCustomer', count(DISTINCT CustomerID) FROM dirty
UNION ALL SELECT 'DimProduct', count(DISTINCT ProductID) FROM dirty
UNION ALL SELECT 'DimDate', count(*) FROM cal"""
ORACLES["report_sink"] = f"""{DIRTY_WITH}, {MONTHLY}
SELECT strftime(m, '%Y-%m-%d') AS month, round(v, 2) AS val, 'run2' AS run_id FROM mon"""
ORACLES["csv_ragged"] = """WITH o AS (SELECT count(*) FILTER (o_orderkey % 50 = 3) AS n FROM orders)
SELECT 'whole' AS extra, FALSE AS refused, n AS lines, 0 AS without_priority FROM o
UNION ALL SELECT 'one', n > 0, n, 0 FROM o UNION ALL SELECT 'empty', n > 0, n, 0 FROM o
UNION ALL SELECT 'second', n > 0, n, 0 FROM o UNION ALL SELECT 'short', FALSE, n, n FROM o"""
ORACLES["csv_dialects"] = """SELECT c_custkey, c_name || ';a,b|c' AS c_name,
  CASE WHEN c_custkey % 3 <> 1 THEN round(c_acctbal, 2) END AS c_acctbal,
  CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer"""
ORACLES["csv_quoted"] = """SELECT doc_id, md5('> ' || replace(text, chr(13), '') || '"quoted", once' || chr(10)) AS text_md5, lang FROM documents"""
ORACLES["csv_legacy"] = r"""SELECT doc_id, md5('é ' || regexp_replace(text, '[^\x20-\x7E\x{A0}-\x{FF}]', '?', 'g')) AS text_md5,
  TRUE AS noted FROM documents"""
ORACLES["load_by_extension"] = union(
    [
        f"SELECT '{s}' AS suffix, '{k}' AS kind, 'supplier' AS name, count(*) AS n_rows, CAST(sum(s_suppkey) AS BIGINT) AS keys, "
        "round(sum(s_acctbal), 2) AS balance, count(DISTINCT s_name) AS names FROM supplier"
        for s, k in (("parquet", "parquet"), ("pq", "parquet"), ("csv", "csv"), ("tsv", "csv"), ("txt", "csv"))
    ]
)
_chart_dims = union(
    [
        f"SELECT '{c}' AS dim, 'breakdown_{c.lower()}' AS chart, CAST({c} AS VARCHAR) AS label, sum(Revenue) AS v, "
        f"row_number() OVER (ORDER BY sum(Revenue) DESC, {c} NULLS LAST) AS rn, (SELECT count(DISTINCT {c}) FROM dirty) AS width "
        f"FROM dirty GROUP BY {c}"
        for c in TEXTS
    ]
)
ORACLES["chart_files"] = f"""{DIRTY_WITH}, {MONTHLY}, m AS ({MISSING}), cd AS ({_chart_dims}), c AS ({_counts}), {ROLES},
best AS (SELECT column_name FROM roles WHERE role = 'dimension_attribute' AND logical_type = 'string'
  AND distinct_count BETWEEN 2 AND 50 ORDER BY distinct_count, column_name LIMIT 4)
SELECT 'trend_revenue' AS chart, strftime(m, '%Y-%m-%d') AS label, round(v, 2) AS val, TRUE AS whole FROM mon
UNION ALL SELECT chart, coalesce(nullif(substr(label, 1, 40), ''), '-'), round(v, 2), TRUE FROM cd
  WHERE dim IN (SELECT column_name FROM best) AND rn <= 10
UNION ALL SELECT 'missing_values', column_name, CAST(n AS DOUBLE), TRUE FROM m WHERE n > 0"""
ORACLES["crash_before_publishing"] = "SELECT n_nationkey, n_name, 'good' AS run_id FROM nation"
ORACLES["analysis"] = f"""{DIRTY_WITH}, {ISSUES}, c AS ({_counts}), {ROLES}, {KPIS}
SELECT CASE WHEN role = 'measure' THEN 'measure' ELSE 'dimension' END AS section, column_name AS name, '' AS shown FROM roles
  WHERE role IN ('measure', 'dimension_attribute', 'date', 'foreign_key')
UNION ALL SELECT 'kpi', kpi, format('{{:.2f}}', v) FROM kp
UNION ALL SELECT 'median', column_name, format('{{:.4f}}', median) FROM ({ORACLES["measure_stats"]})
UNION ALL SELECT 'dates', column_name, first_day || ' ' || last_day FROM ({ORACLES["date_ranges"]})
UNION ALL SELECT 'issue', kind || ' ' || column_name, CAST(affected_rows AS VARCHAR) FROM issues
UNION ALL SELECT 'count', 'insights', (SELECT CAST(count(*) AS VARCHAR) FROM ({ORACLES["insights"]}))"""
