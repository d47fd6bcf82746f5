"""Shared parts of the operators: shared folders, words of Arrow batches, 64-bit mixing.

The word helpers work on whole Arrow columns: they never loop over rows, and their memory is
a small multiple of one batch.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Odd 64-bit multipliers of the mixing functions.
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---------------------------------------------------------------- shared folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names no such folder (local tests) a temporary one is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tablewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Folders of intermediate tables that are still there.
_STORED: list[str] = []


#: Bytes of values of a measured table that may be broadcast at most.
BROADCAST_BYTES = 1 << 20


def stored(df: DataFrame, name: str, measured: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage ends there.

    The folder stays until :func:`dropped` or :func:`release` deletes it. Catalyst takes the size of the files for the
    size of the table, and broadcasts by way of the driver what is compressed a hundredfold. The values of a ``measured``
    table are added up while they are written; a larger one than ``BROADCAST_BYTES`` is joined by sorting.
    """
    spark = df.sparkSession
    path, size, written = shared_folder(spark, name), Observation(), df
    if measured:
        long = [c for c, kind in df.dtypes if kind in ("string", "binary")]
        width = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c in long), F.lit(8 * len(df.columns)).cast("long"))
        written = df.observe(size, F.sum(width).alias("bytes"))
    written.write.option("compression", "zstd").parquet(path)
    _STORED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    if measured and (size.get["bytes"] or 0) > BROADCAST_BYTES:
        out = out.hint("merge")
    out.stored_in = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "stored_in", None)
        if path in _STORED:
            _STORED.remove(path)
            remove(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables of :func:`stored`: for callers whose results so far are written elsewhere."""
    while _STORED:
        remove(spark, _STORED.pop())
    tidy(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_folder` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when memory runs short."""
    gc.collect()
    spark._jvm.System.gc()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; whatever else the table has cannot clash with own names."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


# ---------------------------------------------------------------- words


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """A batch's texts in one array that starts at offset 0; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pa.concat_arrays([pc.fill_null(column.cast(pa.string()), "")])


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``limit`` text bytes, so that working memory has a bound."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


class Words:
    """The words of a batch: ``codes`` into ``dictionary``, and where each text's words begin."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, dictionary: pa.StringArray):
        self.codes, self.bounds, self.dictionary = codes, bounds, dictionary

    def hashes(self) -> np.ndarray:
        """One unsigned 64-bit hash per word of the batch, equal for equal words."""
        own = np.fromiter(
            (xxhash.xxh3_64_intdigest(w) for w in self.dictionary.to_pylist()), np.uint64, len(self.dictionary)
        )
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def split_words(texts: pa.StringArray, lower: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``lower`` maps A-Z to a-z before."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return Words(coded.indices.to_numpy(zero_copy_only=False), before[offsets - offsets[0]], coded.dictionary)


def mapped_bytes(texts: pa.StringArray, byte_map: bytes) -> pa.StringArray:
    """Every byte replaced by ``byte_map``; the map must keep bytes from 0x80 as they are."""
    _, offsets, data = texts.buffers()
    return pa.StringArray.from_buffers(
        len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(byte_map))
    )


def owners(bounds: np.ndarray) -> np.ndarray:
    """The row of each item of a ragged column."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


# ---------------------------------------------------------------- hashes of sequences


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting: ``np.unique`` hashes integers first, which takes longer by far."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_B
        x = (x ^ (x >> np.uint64(27))) * MIX_C
        return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` values; document bounds are the caller's business."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            out = mixed(out * MIX_A + words[i : len(words) - n + 1 + i])
        return out


def run_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions (in the ragged column) at which ``n`` items of one row begin."""
    length = np.diff(bounds)
    inside = np.maximum(length - n + 1, 0)
    shift = np.concatenate([[0], np.cumsum(inside)])
    return np.arange(shift[-1]) + np.repeat(bounds[:-1] - shift[:-1], inside)
