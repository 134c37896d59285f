"""File bytes for listed documents.

Two ways, same result columns (``content BINARY``, ``read_error``):

* ``read_in_tasks`` (default): each listed path is read in the task that holds
  the row, by ``sources.storage``: no shuffle, no join, one read.  Several
  files are opened at once, as an object store answers slowly; the bytes in
  flight are bounded by the listed lengths, and a file of more than the bound
  is read by itself.
* ``read_with_binary_file``: Spark's ``binaryFile`` source joined on path.
  That source skips zero-byte files and ``_``/``.`` names, so rows it
  misses fall back to a task-side read; nothing is dropped.

Only rows that passed the type and resume gates are read (F1/F2 come
before reading); callers filter first and union afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid.schema import DOCUMENT_READ_ERROR
from casegrid.sources import storage

MAX_BATCH_BYTES = 64 << 20  # bytes of file content in flight, and per output batch
MAX_BATCH_ROWS = 1024
READERS = 8  # files a task opens at once


def read_file(path: str) -> tuple[bytes | None, str | None]:
    """(bytes, None), or (None, what went wrong)."""
    try:
        return storage.read_bytes(path), None
    except (OSError, pa.ArrowException) as exc:  # missing, unreadable, a directory, ...
        return None, type(exc).__name__


def windows(lengths: list[int], max_rows: int, max_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows that are read together: at most
    ``max_rows`` files and ``max_bytes`` bytes, or one larger file."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= max_rows or size + n > max_bytes):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _out_schema(df: DataFrame) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name not in ("content", "read_error", "read_message")]
    return T.StructType(fields + [
        T.StructField("content", T.BinaryType()),
        T.StructField("read_error", T.StringType()),
        T.StructField("read_message", T.StringType()),
    ])


def read_in_tasks(listed: DataFrame, path_col: str = "source_file", *, max_rows: int = MAX_BATCH_ROWS,
                  max_bytes: int = MAX_BATCH_BYTES, readers: int = READERS) -> DataFrame:
    """Attach bytes by reading each path inside the executor task.  Without a
    ``length`` column a file counts as an equal share of ``max_bytes`` for each
    reader, so no more than ``readers`` are in flight."""
    schema = _out_schema(listed)
    keep = [f.name for f in schema.fields if f.name not in ("content", "read_error", "read_message")]

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=readers) as pool:
            for pdf in batches:
                unknown = -(-max_bytes // readers)
                lengths = pdf["length"].fillna(unknown).astype("int64").tolist() if "length" in pdf else [unknown] * len(pdf)
                for start, end in windows(lengths, max_rows, max_bytes):
                    got = list(pool.map(read_file, pdf[path_col].iloc[start:end]))
                    out = pdf[keep].iloc[start:end].copy()
                    out["content"] = [g[0] for g in got]
                    out["read_error"] = [None if g[1] is None else DOCUMENT_READ_ERROR for g in got]
                    out["read_message"] = None  # the message of a read failure is its code
                    yield out

    return listed.mapInPandas(fn, schema)


def _plain(path: Column) -> Column:
    """A path as both sides of the join write it: ``file:`` URIs as paths."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_with_binary_file(spark: SparkSession, listed: DataFrame, root: str,
                          path_col: str = "source_file") -> DataFrame:
    """Attach bytes from ``binaryFile`` (left join on the path below the
    canonical root); rows it does not return are read in tasks."""
    top = storage.canonical(root).rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
        .select(_plain(F.col("path")).alias("_abs"), F.col("content").alias("_bf"))
    )
    keyed = listed.withColumn("_abs", _plain(F.concat(F.lit(top), F.col("rel_path"))))
    joined = keyed.join(files, "_abs", "left")
    found = joined.where(F.col("_bf").isNotNull()).withColumn("content", F.col("_bf")) \
        .withColumn("read_error", F.lit(None).cast("string")) \
        .withColumn("read_message", F.lit(None).cast("string")).drop("_bf", "_abs")
    missing = joined.where(F.col("_bf").isNull()).drop("_bf", "_abs")
    return found.unionByName(read_in_tasks(missing, path_col))
