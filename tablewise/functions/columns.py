"""Column access by untrusted name, and the two type systems laid over Spark types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, DECIMAL, STRING, BOOLEAN = "integer", "decimal", "string", "boolean"
DATE, DATETIME, UNKNOWN = "date", "datetime", "unknown"
NUMERIC = {INTEGER, DECIMAL}
TEMPORAL = {DATE, DATETIME}

#: A table is broadcast if its values are at most so many bytes, counted before.
BROADCAST_BYTES = 32 << 20


def quote(name: str) -> str:
    """A column name as a Spark identifier; names come from data and may hold anything."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def logical_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return INTEGER
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return DECIMAL
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.DateType):
        return DATE
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    return UNKNOWN


def model_type(dtype: T.DataType) -> str:
    """Type name used by the star schema; dates and datetimes are one type there."""
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    names = {
        INTEGER: "int64",
        DECIMAL: "double",
        BOOLEAN: "boolean",
        DATE: "dateTime",
        DATETIME: "dateTime",
    }
    return names.get(logical_type(dtype), "string")


def logical_types(df: DataFrame) -> dict[str, str]:
    return {f.name: logical_type(f.dataType) for f in df.schema.fields}


def check_names(df: DataFrame) -> None:
    """Column matching ignores case, so names equal ignoring case cannot be told apart."""
    seen: dict[str, str] = {}
    for name in df.columns:
        other = seen.setdefault(name.lower(), name)
        if other is not name:
            raise ValueError(f"columns {other!r} and {name!r} differ only by case")


def comparable(df: DataFrame) -> DataFrame:
    """Maps have no equality in Spark; replace them by their sorted entries."""
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    if not maps:
        return df
    return df.select(
        *[F.array_sort(F.map_entries(col(n))).alias(n) if n in maps else col(n) for n in df.columns]
    )


def batches(items: list, size: int = 100) -> list[list]:
    """Very wide tables are handled in several narrower passes to keep generated code small."""
    return [items[i : i + size] for i in range(0, len(items), size)]


def byte_size(df: DataFrame) -> int:
    """Size of a table's values as text, with a little for each row."""
    width = sum((F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    return int(df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()[0])
