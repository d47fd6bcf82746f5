"""Read-only SQL sources: registered tables, or a database over JDBC."""

from __future__ import annotations

import os
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tablewise.functions.columns import quote
from tablewise.sources.dataset import Dataset, LoadError, normalise_dates

#: What parts a statement is read in: comments, texts and quoted names are skipped whole.
_SKIP = {
    "spark": r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`""",
    "standard": r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`""",
}
_WORD = r"[^\W\d]\w*"
#: Words that change something or leave the statement, wherever they stand outside quotes.
CHANGES = frozenset(
    "alter attach call copy create delete drop exec execute grant insert merge pragma revoke truncate update vacuum".split()
)


def check_read_only(query: str, dialect: str = "spark") -> None:
    """Refuse anything but one SELECT or WITH statement. A guard against mistakes only.

    One scan from left to right knows comments, texts and quoted names, so none of them can hide
    another. ``standard`` takes a backslash in a text as a character like others.
    """
    words: list[str] = []
    ended = False
    for token in re.finditer(f"(?P<skip>{_SKIP[dialect]})|(?P<word>{_WORD})|(?P<end>;)|(?P<open>['\"`])|\\S", query, re.S):
        kind = token.lastgroup
        if kind == "open":
            raise LoadError("a quote is left open")
        if kind == "end":
            ended = ended or bool(words)
        elif kind != "skip" or token[0][0] in "'\"`":
            if ended:
                raise LoadError("only a single SQL statement is allowed")
            words.append(token[0].lower() if kind == "word" else "")
    if not any(words):
        raise LoadError("there is no statement to run")
    if words[0] not in ("select", "with"):
        raise LoadError(f"a statement that reads begins with SELECT or WITH, not {words[0].upper() or 'this'}")
    bad = next((w for w in words if w in CHANGES), None)
    if bad:
        raise LoadError(f"{bad.upper()} is not for reading")


def register(name: str, df: DataFrame) -> None:
    if not name.isidentifier():
        raise LoadError(f"invalid table name: {name!r}")
    df.createOrReplaceTempView(name)


def query_tables(spark: SparkSession, query: str) -> DataFrame:
    """Run one read-only statement over registered tables."""
    check_read_only(query)
    try:
        return spark.sql(query)
    except PySparkException as exc:
        raise LoadError(f"query failed: {exc.getCondition() or type(exc).__name__}") from None


def load_sql(
    spark: SparkSession,
    query: str,
    *,
    name: str = "query",
    connection_env: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options,
) -> Dataset:
    """A read-only query as a dataset.

    With ``connection_env`` the query runs in the database whose JDBC URL that environment
    variable holds; the URL never shows in messages. A ``partition_column`` with its
    ``bounds`` reads in parallel. Without it the query runs over registered tables.
    """
    check_read_only(query, "spark" if connection_env is None else "standard")
    if connection_env is None:
        return normalise_dates(Dataset(query_tables(spark, query), name))
    url = os.environ.get(connection_env)
    if not url:
        raise LoadError(f"environment variable {connection_env} is not set")
    reader = spark.read.format("jdbc").options(**options).option("url", url)
    if partition_column:
        inner = query.strip().rstrip(";")
        reader = (
            reader.option("dbtable", f"({inner}) source")
            .option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    else:
        reader = reader.option("query", query.strip().rstrip(";"))
    try:
        return normalise_dates(Dataset(reader.load(), name))
    except Exception as exc:  # the driver's own error may carry the URL
        raise LoadError(f"query failed: {type(exc).__name__}") from None


quote_identifier = quote
