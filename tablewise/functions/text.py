"""Text operators as column expressions: normalising, redacting, quoting, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import col

# The mask, and the patterns of secret names and secret values.
MASK = "*" * 10
SECRET_NAME = (
    r"(?iu)(secret|password|passwd|pwd|token|api[_-]?key|credential|authorization|"
    r"conn(ection)?_?str)"
)
SECRET_VALUES = [
    r"(?iu)Bearer[\s\x{1c}-\x{1f}\x{85}\p{Z}]+[A-Za-z0-9\-._~+/]+=*",
    r"(?iu)(password|pwd)[\s\x{1c}-\x{1f}\x{85}\p{Z}]*=[\s\x{1c}-\x{1f}\x{85}\p{Z}]*[^;]+",
    r"sk-[A-Za-z0-9_\-]{16,}",
]
QUOTED_CHARS = 80
RENDERED_CHARS = 100

# Spark's trim() strips only U+0020, so the edges are matched by a Unicode class.
_EDGES = r"(?U)^\s+|\s+$"
_BLANKS = r"(?U)\s+"
# Text shown to people also treats the four ASCII separators as blanks.
_WORD_GAP = r"(?U)[\s\x{1c}-\x{1f}]+"


def trim_u(value: Column) -> Column:
    # Most values begin and end with a visible ASCII character: comparing two characters spares them the pattern.
    bare = F.left(value, F.lit(1)).between("!", "~") & F.right(value, F.lit(1)).between("!", "~")
    return F.when(bare, value).otherwise(F.regexp_replace(value, _EDGES, ""))


def is_blank(value: Column) -> Column:
    return value.rlike(r"(?U)^\s*$")


def category_key(value: Column) -> Column:
    """Spelling-insensitive form of a category: trimmed, single blanks, lower case."""
    return F.lower(F.regexp_replace(trim_u(value), _BLANKS, " "))


def value_key(value: Column) -> Column:
    """Form compared by dependency strength: trimmed and lower case, inner blanks kept."""
    return F.lower(trim_u(value))


def bounded(value: Column, limit: int = RENDERED_CHARS) -> Column:
    """A string cut to ``limit`` characters, the last of them an ellipsis when cut."""
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit - 1)), F.lit("…"))).otherwise(
        value
    )


# -- redaction -----------------------------------------------------------------------------
def redact_text(value: Column) -> Column:
    for pattern in SECRET_VALUES:
        value = F.regexp_replace(value, pattern, MASK)
    return value


def has_secret(value: Column) -> Column:
    found = F.lit(False)
    for pattern in SECRET_VALUES:
        found = found | F.coalesce(value.rlike(pattern), F.lit(False))
    return found


def _is_secret_name(name: str) -> bool:
    import re

    return re.search(SECRET_NAME.replace("(?iu)", "(?i)"), name) is not None


def _truthy(value: Column, dtype: T.DataType) -> Column:
    """Whether a value would be masked under a secret name: empty and zero ones are kept."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.length(value) > 0
    if isinstance(dtype, T.BooleanType):
        return value
    if isinstance(dtype, T.NumericType):
        return value != F.lit(0)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.size(value) > 0
    return value.isNotNull()


def _masked(value: Column, dtype: T.DataType) -> Column:
    """Masked value. Only strings can hold the mask; other types become a NULL of their type."""
    hidden = F.lit(MASK) if isinstance(dtype, T.StringType) else F.lit(None).cast(dtype)
    return F.when(F.coalesce(_truthy(value, dtype), F.lit(False)), hidden).otherwise(value)


def _walk(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return redact_text(value)
    if isinstance(dtype, T.ArrayType) and _holds_text(dtype):
        return F.transform(value, lambda v: _walk(v, dtype.elementType))
    if isinstance(dtype, T.MapType) and _holds_text(dtype):

        def entry(key: Column, item: Column) -> Column:
            safe = _walk(item, dtype.valueType)
            if not isinstance(dtype.keyType, T.StringType):
                return safe
            return F.when(key.rlike(SECRET_NAME), _masked(item, dtype.valueType)).otherwise(safe)

        return F.transform_values(value, entry)
    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            inner = value.getField(field.name)
            new = (
                _masked(inner, field.dataType)
                if _is_secret_name(field.name)
                else _walk(inner, field.dataType)
            )
            value = value.withField(f"`{field.name}`", new)
        return value
    return value


def _holds_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return True
    return isinstance(dtype, (T.StringType, T.StructType))


def redact(df: DataFrame) -> DataFrame:
    """Mask secret-looking values in every text, at any depth, and fields with secret names."""
    out = []
    for field in df.schema.fields:
        value = col(field.name)
        hide = _is_secret_name(field.name)
        new = _masked(value, field.dataType) if hide else _walk(value, field.dataType)
        out.append(new.alias(field.name))
    return df.select(*out)


def redaction_hits(df: DataFrame) -> DataFrame:
    """Rows per text column that hold at least one secret-looking value."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counts = df.agg(*[F.count_if(has_secret(col(n))).alias(n) for n in names])
    pairs = [x for n in names for x in (F.lit(n), col(n))]
    return counts.select(F.stack(F.lit(len(names)), *pairs).alias("column", "hits"))


# -- rendering data as inert text ------------------------------------------------------------
def _one_line(value: Column) -> Column:
    text = F.regexp_replace(value, _WORD_GAP, " ")
    return F.replace(F.regexp_replace(text, "^ | $", ""), F.lit("`"), F.lit("'"))


def quote_data_value(value: Column, limit: int = QUOTED_CHARS) -> Column:
    """A data value as a bounded Markdown code span that cannot be broken out of."""
    text = F.replace(_one_line(value.cast("string")), F.lit("|"), F.lit("\\|"))
    text = bounded(F.coalesce(text, F.lit("None")), limit)
    return F.concat(F.lit("`"), F.when(text == "", "(blank)").otherwise(text), F.lit("`"))


def escape_md_text(value: Column) -> Column:
    text = F.regexp_replace(_one_line(value.cast("string")), r"([|\[\]])", r"\\$1")
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fence_untrusted(value: Column, source: str = "user data") -> Column:
    """Text wrapped in a tag that marks it as data; a closing tag inside is neutralised."""
    safe = F.replace(value, F.lit("</untrusted_data>"), F.lit("</untrusted_data_>"))
    head = f'<untrusted_data source="{source}">\n'
    return F.concat(F.lit(head), safe, F.lit("\n</untrusted_data>"))


# -- number formats --------------------------------------------------------------------------
def format_amount(value: Column) -> Column:
    """No decimals from 100 upwards, else two."""
    return F.when(F.abs(value) >= 100, F.format_number(value, 0)).otherwise(
        F.format_number(value, 2)
    )


def format_share(part: Column, whole: Column) -> Column:
    share = F.format_number(F.try_divide(part, whole) * 100, 1)
    return F.coalesce(F.concat(share, F.lit("%")), F.lit("0%"))


def format_kpi(value: Column, hint: Column) -> Column:
    small = F.when(F.abs(value) < 1, F.format_number(value, 4)).otherwise(F.format_number(value, 2))
    whole = (hint == "integer") | (value == F.floor(value))
    text = (
        F.when(hint == "percent", F.concat(F.format_number(value * 100, 1), F.lit("%")))
        .when(whole, F.format_number(value, 0))
        .otherwise(small)
    )
    return F.coalesce(text, F.lit("-"))


# The same two formats for the bounded summaries that reach the driver.
def amount_text(value: float) -> str:
    return f"{value:,.{0 if abs(value) >= 100 else 2}f}"


def share_text(part: float, whole: float) -> str:
    return f"{part / whole:.1%}" if whole else "0%"


def quoted(value: object) -> str:
    text = " ".join(str(value).split()).replace("`", "'").replace("|", "\\|")
    text = text if len(text) <= QUOTED_CHARS else f"{text[: QUOTED_CHARS - 1]}…"
    return f"`{text or '(blank)'}`"
