"""Sinks: star tables, reports and chart tables, each run kept in a directory of its own."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import col

POINTER = "current"
#: Values come back as they were: blanks around them are kept, quotes are doubled.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _no_nan(value: Column, dtype: T.DataType) -> Column:
    """NaN and infinities as NULL at any depth: JSON has no form for them."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
        return F.when(~bad, value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: _no_nan(v, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, v: _no_nan(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        parts = [_no_nan(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def json_ready(df: DataFrame) -> DataFrame:
    return df.select(*[_no_nan(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def run_path(folder: str, run_id: str, table: str) -> str:
    return f"{folder.rstrip('/')}/run_id={run_id}/{table}"


def write_tables(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """One Parquet table each under ``run_id=<id>``; earlier runs stay as they are."""
    for name, df in tables.items():
        df.write.mode("error").parquet(run_path(folder, run_id, name))
    _publish(tables, folder, run_id, "parquet")


def write_reports(reports: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Profile, schema, quality, metrics and findings as JSON lines."""
    for name, df in reports.items():
        json_ready(df).write.mode("error").option("ignoreNullFields", False).json(
            run_path(folder, run_id, name)
        )
    _publish(reports, folder, run_id, "json")


def write_chart_tables(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """The bounded data behind each chart as CSV with a header, one ordered file each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("error").options(**CSV).csv(run_path(folder, run_id, name))
    _publish(tables, folder, run_id, "csv")


# -- publishing -------------------------------------------------------------------------------
def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as its own type."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    files, target = _files(spark, path)
    out = files.create(target, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename over an existing file in one step: readers see the old content or the new one."""
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(paths[0].toUri(), spark._jsc.hadoopConfiguration())
    qualified = [context.makeQualified(p) for p in paths]
    context.rename(*qualified, options)


def _listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files of a written table with their sizes."""
    files, target = _files(spark, path)
    if not files.exists(target):
        return []
    found = [(f.getPath().getName(), f.getLen()) for f in files.listStatus(target) if f.isFile()]
    return sorted(f for f in found if not f[0].startswith(("_", ".")))


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    reader = spark.read.options(**CSV, multiLine=True) if kind == "csv" else spark.read
    return getattr(reader, kind)(path)


def _publish(tables: dict[str, DataFrame], folder: str, run_id: str, kind: str) -> None:
    """Write what the run consists of, then make it the current one.

    A table's entry in the manifest names its files, their sizes and the rows read back from
    them. It is written when the table is whole, and the pointer moves last, by rename: whatever
    stops in between, the former run is still the current one.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    for name in tables:
        path = run_path(folder, run_id, name)
        listed = _listing(spark, path)
        rows = _read(spark, path, kind).count() if any(size for _, size in listed) else 0
        entry = {"table": name, "format": kind, "rows": rows, "files": [{"name": n, "bytes": b} for n, b in listed]}
        _write_text(spark, f"{folder.rstrip('/')}/run_id={run_id}/_manifest/{name}.json", json.dumps(entry))
    _point(spark, folder, run_id)


def _point(spark: SparkSession, folder: str, run_id: str) -> None:
    base = folder.rstrip("/")
    fresh = f"{base}/_{POINTER}-{uuid.uuid4().hex}"
    _write_text(spark, fresh, json.dumps({"run_id": run_id}))
    _replace(spark, fresh, f"{base}/{POINTER}")


def current_run(spark: SparkSession, folder: str) -> str:
    return spark.read.json(f"{folder.rstrip('/')}/{POINTER}").first()["run_id"]


def manifest(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """``(table, format, rows, files)`` of a run, by default the current one."""
    run = run_id or current_run(spark, folder)
    schema = "table string, format string, rows long, files array<struct<name:string,bytes:long>>"
    # The folder's name keeps it out of reads of the run as a whole, so its files are named.
    listed = _listing(spark, f"{folder.rstrip('/')}/run_id={run}/_manifest")
    paths = [f"{folder.rstrip('/')}/run_id={run}/_manifest/{name}" for name, _ in listed]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def verify_run(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """``(table, rows, found_rows, missing_files, ok)``: is all that the manifest names still there?"""
    run = run_id or current_run(spark, folder)
    result = []
    for entry in manifest(spark, folder, run).collect():
        path = run_path(folder, run, entry["table"])
        here = dict(_listing(spark, path))
        lost = [f["name"] for f in entry["files"] if here.get(f["name"]) != f["bytes"]]
        rows = _read(spark, path, entry["format"]).count() if here and any(here.values()) and not lost else 0
        ok = not lost and len(here) == len(entry["files"]) and rows == entry["rows"]
        result.append((entry["table"], entry["rows"], rows, len(lost), ok))
    schema = "table string, rows long, found_rows long, missing_files int, ok boolean"
    return spark.createDataFrame(sorted(result), schema)


def read_tables(
    spark: SparkSession, folder: str, names: list[str], run_id: str | None = None
) -> dict[str, DataFrame]:
    """Tables of a run, by default the current one; a table that the run does not have is left out."""
    run = run_id or current_run(spark, folder)
    kinds = {r["table"]: r["format"] for r in manifest(spark, folder, run).select("table", "format").collect()}
    return {n: _read(spark, run_path(folder, run, n), kinds[n]) for n in names if n in kinds}
