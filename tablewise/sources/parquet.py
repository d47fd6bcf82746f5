"""Parquet source."""

from __future__ import annotations

from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tablewise.sources.dataset import Dataset, LoadError


def load_parquet(spark: SparkSession, path: str, **options) -> Dataset:
    name = PurePosixPath(path).stem
    try:
        df = spark.read.options(**options).parquet(path)
    except (PySparkException, Py4JJavaError) as exc:  # a bad footer fails inside a task
        kind = type(exc).__name__
        raise LoadError(f"cannot read {PurePosixPath(path).name} as Parquet: {kind}") from None
    return Dataset(df, name)
