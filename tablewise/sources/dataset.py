"""Loading any supported source, midnight dates, and stored intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import batches, col


class LoadError(Exception):
    """A source could not be read; the message is safe to show."""


@dataclass
class Dataset:
    df: DataFrame
    name: str
    notes: list[str] = field(default_factory=list)
    sheets: list[str] = field(default_factory=list)


# The reader used for each file extension.
READERS = {
    ".csv": "csv",
    ".tsv": "csv",
    ".txt": "csv",
    ".xlsx": "excel",
    ".xlsm": "excel",
    ".xls": "excel",
    ".parquet": "parquet",
    ".pq": "parquet",
}


def source_type(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise LoadError(f"unsupported file type: {suffix or '<none>'} ({PurePosixPath(path).name})")
    return READERS[suffix]


def load(
    spark: SparkSession, path: str, *, sheet: str | None = None, format: str | None = None, **options
) -> Dataset:
    """Load a file, a folder or a glob by extension; folders name their ``format``."""
    from tablewise.sources.delimited import load_csv
    from tablewise.sources.parquet import load_parquet
    from tablewise.sources.workbook import load_workbooks

    kind = format or source_type(path)
    if sheet is not None and kind != "excel":
        raise LoadError("'sheet' is only valid for Excel sources")
    if kind == "csv":
        if path.lower().endswith(".tsv"):
            options.setdefault("delimiter", "\t")
        found = load_csv(spark, path, **options)
    elif kind == "excel":
        found = load_workbooks(spark, path, sheet=sheet, **options)
    else:
        found = load_parquet(spark, path, **options)
    return normalise_dates(found)


def midnight_columns(df: DataFrame) -> list[str]:
    """Timestamp columns with values, all of them at midnight; one aggregate for all."""
    stamps = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    ]
    found = []
    for batch in batches(stamps):
        aggs = [
            F.bool_and(F.date_trunc("day", col(n)) == col(n)).alias(f"b{i}")
            for i, n in enumerate(batch)
        ]
        row = df.agg(*aggs).first()
        found += [n for n, midnight in zip(batch, row, strict=True) if midnight]
    return found


def normalise_dates(dataset: Dataset) -> Dataset:
    """Datetime columns without a time part become dates, and a note says so."""
    names = midnight_columns(dataset.df)
    if names:
        dataset.df = dataset.df.withColumns({n: col(n).cast("date") for n in names})
        note = f"Datetime columns with no time part read as dates: {', '.join(names)}."
        dataset.notes.append(note)
    return dataset


def scratch_folder(spark: SparkSession) -> str | None:
    """Shared folder for stored intermediates: the cluster's checkpoint folder.

    Only local sessions without one get a temporary folder; on a cluster without a shared
    folder nothing is stored, since other executors could not read it back.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="tablewise-")
    return None


def spread(df: DataFrame) -> DataFrame:
    """Use the whole cluster for a source that is read in fewer splits than there are cores.

    A small file is one split, and every pass over it would run in one task. Large sources
    have more splits than cores already and are returned unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame) -> DataFrame:
    """Store a derived table as Parquet and read it back, so that later passes scan columns.

    Unlike a cache it survives lost executors, and unlike a checkpoint it prunes columns. What was shuffled
    to make it is deleted from the executors' disks: nothing reads that again.
    """
    return materialise_parts([df])


def materialise_parts(parts: Iterable[DataFrame], codec: str | None = None) -> DataFrame:
    """Like ``materialise`` for a table that comes in parts, made and stored one after the other.

    The disks hold what was shuffled for one part at a time. ``codec`` is for tables whose size counts for more than
    the time to write them.
    """
    parts = iter(parts)
    df = next(parts)
    folder = scratch_folder(df.sparkSession)
    if folder is None:
        raise LoadError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder.rstrip('/')}/tablewise-{uuid.uuid4().hex}"
    for part in chain([df], parts):
        writer = part.write.mode("append")
        (writer.option("compression", codec) if codec else writer).parquet(path)
        tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver runs short of memory."""
    gc.collect()
    spark._jvm.System.gc()
