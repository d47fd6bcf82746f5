"""Delimited text: delimiter, encoding, null tokens and column types found from the data."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import batches, col
from tablewise.operators.quality import DATE_FORMATS
from tablewise.sources.dataset import Dataset, LoadError

# Texts read as NULL ("NA" is a value), and the delimiters that are detected.
NULL_TOKENS = ["", "NULL", "null", "#N/A", "N/A"]
DELIMITERS = ",;\t|"

_INTEGER = r"^-?\d+$"
_FLOAT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$|^[-+]?inf$|^NaN$"
_BOOLEAN = r"(?i)^(true|false)$"
_DATETIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"
_ZONED = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"
# Eight bare digits are a number in a file, so that date format does not apply.
_DATES = [f for f in DATE_FORMATS if f != "yyyyMMdd"]


def _delimiters_in(line: Column, delimiter: str) -> Column:
    """How many delimiters stand outside quoted values.

    Lines with quotes are followed piece by piece: a quote opens a value only as its first character, and
    the value ends with the piece that makes the quotes even. (A pattern for quoted values would
    recurse with their length.)
    """
    quotes = lambda text: F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))

    def step(state: Column, piece: Column) -> Column:
        odd = quotes(piece) % 2 == 1
        inside = F.when(state["open"], ~odd).otherwise(F.startswith(piece, F.lit('"')) & odd)
        return F.struct(inside.alias("open"), (state["n"] + F.when(state["open"], 0).otherwise(1)).alias("n"))

    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("n"))
    followed = F.aggregate(F.split(line, re.escape(delimiter)), start, step, lambda s: s["n"] - 1)
    plain = F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))
    return F.when(F.contains(line, F.lit('"')), followed).otherwise(plain)


def choose_delimiter(scores: dict[str, tuple[int, int, float]]) -> str:
    """The delimiter of a file from ``(in the header, in most lines, variance)`` of each candidate.

    Best is one that most lines hold as often as the header, then the steadiest, then the most frequent.
    """
    found = [d for d in DELIMITERS if scores[d][0]]
    rank = lambda d: (scores[d][0] != scores[d][1], scores[d][2], -scores[d][1], DELIMITERS.index(d))
    return min(found, key=rank, default=",")


def load_csv(
    spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str | None = None
) -> Dataset:
    """CSV as a typed table. Types hold for every row, not only for the first ones.

    Files of a folder are matched by column name; names that a file lacks are NULL there. Every file
    has a delimiter of its own, found from all of its lines. A line with more values than its header is
    an error, whatever these values are; with fewer it is filled up with NULL. Only files that
    hold a quoted line break are read whole.

    Passes: one text scan for headers, delimiters, encoding and quoted line breaks, one for lines
    of another length than the header, one for all column types.
    """
    name = PurePosixPath(path).name
    notes: list[str] = []
    try:
        layouts, utf8 = _layouts(spark.read.text(path), delimiter)
    except PySparkException as exc:
        raise LoadError(f"cannot read {name}: {exc.getCondition() or type(exc).__name__}") from None
    if delimiter is None:
        detected = dict.fromkeys(d for _, d, _ in layouts)
        if list(detected) != [","] and detected:
            notes.append(f"Detected delimiter {', '.join(map(repr, detected))}.")
    given = (encoding or "utf-8").lower()
    legacy = given in ("cp1252", "windows-1252")
    if given in ("utf-8", "utf8", "utf-8-sig") and not utf8:
        legacy = True
        notes.append("File is not valid UTF-8; decoded as cp1252. Verify special characters.")
    charset = "ISO-8859-1" if legacy else ("UTF-8" if "utf" in given and "16" not in given else given)
    parts = []
    try:
        for multiline, separator, files in layouts or [(False, delimiter or ",", [path])]:
            reader = (
                spark.read.option("header", True)
                .option("sep", separator)
                .option("encoding", charset)
                .option("escape", '"')
                .option("multiLine", multiline)
            )
            part = reader.csv(files)
            if part.columns:
                parts.append(_whole_lines(reader, part, files, separator, name))
    except LoadError:
        raise
    except Exception as exc:  # an unknown charset surfaces as a JVM error
        raise LoadError(f"cannot parse {name} as CSV: {type(exc).__name__}") from None
    if not parts:
        raise LoadError(f"cannot parse {name} as CSV: no columns")
    if len({tuple(p.columns) for p in parts}) > 1:
        notes.append("Files have different headers; columns are matched by name.")
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part, allowMissingColumns=True)
    texts = raw
    if legacy:
        texts = raw.select(*[_as_cp1252(col(n)).alias(_name_cp1252(n)) for n in raw.columns])
    texts = texts.select(
        *[F.when(~col(n).isin(NULL_TOKENS), col(n)).alias(n) for n in texts.columns]
    )
    return Dataset(typed(texts), PurePosixPath(path).stem, notes)


def _layouts(lines: DataFrame, delimiter: str | None) -> tuple[list[tuple[bool, str, list[str]]], bool]:
    """``(needs to be read whole, delimiter, files)`` for files of one header; and whether all is UTF-8."""
    candidates = DELIMITERS if delimiter is None else delimiter
    value = F.col("value")
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    opens = [F.startswith("value", F.lit('"')) | F.contains("value", F.lit(f'{d}"')) for d in candidates]
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"),
        "value",
        first.alias("at"),
        F.is_valid_utf8("value").alias("utf8"),
        *[_delimiters_in(value, d).alias(f"n{i}") for i, d in enumerate(candidates)],
        *[(o & (quotes % 2 == 1)).alias(f"open{i}") for i, o in enumerate(opens)],
    )
    aggs = []
    for i in range(len(candidates)):
        n = F.col(f"n{i}")
        aggs += [F.min_by(n, "at").alias(f"head{i}"), F.mode(n, deterministic=True).alias(f"most{i}")]
        aggs += [F.var_pop(n).alias(f"var{i}"), F.bool_or(f"open{i}").alias(f"open{i}")]
    files = rows.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.bool_and("utf8").alias("utf8"), *aggs)
    groups: dict[tuple, list[str]] = {}
    utf8 = True
    for r in files.collect():
        if delimiter is None:
            own = choose_delimiter({d: (r[f"head{i}"] or 0, r[f"most{i}"], r[f"var{i}"]) for i, d in enumerate(candidates)})
        else:
            own = delimiter
        key = (r["header"], bool(r[f"open{candidates.index(own)}"]), own)
        groups.setdefault(key, []).append(r["file"])
        utf8 = utf8 and r["utf8"] is not False
    found = sorted(groups.items(), key=lambda g: min(g[1]))
    return [(whole, own, sorted(names)) for (_, whole, own), names in found], utf8


def _whole_lines(reader: DataFrameReader, part: DataFrame, files: list[str], separator: str, name: str) -> DataFrame:
    """Refuse lines that hold more values than the header, rather than lose them.

    Spark hands over the text of every line whose number of values is not that of the header; these
    few are counted. Without that, it drops what is beyond the header.
    """
    line = "__line"
    schema = T.StructType([*part.schema.fields, T.StructField(line, T.StringType())])
    odd = reader.option("columnNameOfCorruptRecord", line).option("columnPruning", False).schema(schema).csv(files)
    values = _delimiters_in(F.rtrim(col(line), F.lit("\r\n")), separator) + 1
    beyond = F.count_if(col(line).isNotNull() & (values > len(part.columns)))
    # Spark wants another column to be read beside the text of the line.
    long, _ = odd.agg(beyond, F.count(col(part.columns[0]))).first()
    if long:
        raise LoadError(f"{name}: {long} line(s) hold more values than the header")
    return part


# Spark has no cp1252 charset. It differs from Latin-1 in one block of 32 bytes.
_BLOCK = bytes(range(0x80, 0xA0))
_LATIN, _CP1252 = _BLOCK.decode("latin-1"), _BLOCK.decode("cp1252", errors="replace")


def _as_cp1252(text: Column) -> Column:
    return F.translate(text, _LATIN, _CP1252)


def _name_cp1252(name: str) -> str:
    return name.translate(dict(zip(map(ord, _LATIN), _CP1252, strict=True)))


def _parsers(text: Column) -> list[tuple[str, Column]]:
    """``(kind, value)`` from the narrowest type to the widest; NULL where a text fails."""
    whole = F.when(text.rlike(_INTEGER), text.try_cast("bigint"))
    # "inf" and "NaN" are spelled this way in files; Spark's cast knows them too.
    number = F.when(text.rlike(_FLOAT), text.try_cast("double"))
    found = [
        ("bigint", whole),
        ("double", number),
        ("boolean", F.when(text.rlike(_BOOLEAN), text.try_cast("boolean"))),
    ]
    found += [
        (f"date {f}", F.when(text.rlike(DATE_FORMATS[f]), F.try_to_date(text, f))) for f in _DATES
    ]
    found.append(("datetime", F.when(text.rlike(_DATETIME), text.try_cast("timestamp_ntz"))))
    found.append(("zoned", F.when(text.rlike(_ZONED), text.try_cast("timestamp"))))
    return found


def typed(texts: DataFrame) -> DataFrame:
    """Give each text column the first type that every one of its values parses as."""
    chosen: dict[str, Column] = {}
    for batch in batches(texts.columns, 25):
        aggs = []
        for n in batch:
            aggs += [F.count(col(n)), *[F.count(v) for _, v in _parsers(col(n))]]
        row = list(texts.agg(*[a.alias(f"t{i}") for i, a in enumerate(aggs)]).first())
        width = len(row) // len(batch)
        for i, n in enumerate(batch):
            filled, *parsed = row[i * width : (i + 1) * width]
            fits = (v for (_, v), k in zip(_parsers(col(n)), parsed, strict=True) if k == filled)
            value = next(fits, None) if filled else None
            chosen[n] = col(n) if value is None else value
    return texts.select(*[chosen[n].alias(n) for n in texts.columns])
