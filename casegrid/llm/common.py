"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.vocab import encoder
from casegrid.session import bounded_batches, staging_root  # noqa: F401 - the operators take the bound from here

#: Rows of ids that may be broadcast (16 MB of longs); beyond it a shuffle join is used.
BROADCAST_IDS = 1_000_000
#: The same for ids that rows are picked by: with keys as text they take 150 bytes
#: each, and up to three times that on the driver while they are sent.
PICKED_IDS = 100_000
#: Bits of the map that stands for more ids than that (4 MB).
MAP_BITS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back(keep_encoder: bool = False) -> None:
    """Return freed memory to the system.  Python workers go on to other
    stages, and what a task has freed stays theirs otherwise; so does the
    encoder of an earlier stage, with its words, which only tasks that encode keep."""
    if not keep_encoder:
        encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator], Iterator], keep_encoder: bool = False) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, giving memory back at its end,
    and that of an encoder it does not use (``keep_encoder``) at its start."""

    def whole(batches: Iterator) -> Iterator:
        if not keep_encoder:
            encoder.cache_clear()
        try:
            yield from run(batches)
        finally:
            give_back(keep_encoder)

    return whole


def fresh_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder (``spark.checkpoint.dir``)."""
    return f"{staging_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    and survives lost executors.  The folder's owner clears it."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if f"{staging_root(spark).split(':', 1)[-1].lstrip('/')}/llm/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def likely(ids: DataFrame, on: list[str]) -> Column:
    """Whether a row's key may be one of ``ids``: true for each of them and, by
    a map of MAP_BITS bits set at the ids' hashes, for few others.  The map is
    all that the driver holds, however many the ids are."""
    at = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in on]), F.lit(1 << MAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(max(1, (1 << MAP_BITS) // 64), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def test(at: pa.Array) -> pa.Array:
        at = at.to_numpy()
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return test(at)


def pick(df: DataFrame, ids: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (narrow, distinct, staged), with
    "inner" beside the columns of ``ids``, or with "left_anti" not in them.  The
    ids are broadcast when counted and few; else they are shuffled, with the
    rows that are likely among them: one Python worker a task where ``df`` is
    read, none where it is joined."""
    if ids.count() <= PICKED_IDS:
        return df.join(F.broadcast(ids), on, how)
    some = likely(ids, on)
    exact = df.where(some).join(ids.hint("merge"), on, how)
    return exact.unionByName(df.where(~some)) if how == "left_anti" else exact


def row_key() -> Column:
    """A row's key where ``doc_id`` may be null or repeat."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def row_id() -> Column:
    """A row's key of 128 bits, where ``doc_id`` may be null or repeat."""
    doc, text = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))
    return F.md5(F.concat_ws(":", doc, F.when(F.col("text").isNull(), F.lit("n")).otherwise(F.lit("t")), text).cast("binary"))


def drawn(df: DataFrame, share: float) -> DataFrame:
    """About ``share`` of the rows (doc_id, text), by a hash of both: no null or
    repeated id draws all its rows at once."""
    return df.where(F.pmod(row_key(), F.lit(1 << 24)) < int(min(1.0, share) * (1 << 24)))


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """The rows (doc_id, text and more) without repeated ones, and of too many
    for a sample the first ``rows`` in the order of their hashes; in one partition."""
    return df.distinct().orderBy(row_key(), *df.columns).limit(rows).repartition(1)


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the column's text, modulo ``mod``; null for null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, null equal to null; the right side's keys (and no
    other shared name) are renamed, so clashing extra columns do no harm."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[F.col(c) for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = one if cond is None else cond & one
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])
