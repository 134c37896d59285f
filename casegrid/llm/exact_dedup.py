"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each partition of the documents sends its distinct fingerprints, sorted and
Golomb-coded, to the owners of the fingerprint ranges, and marks those that it
holds more than once.  An owner answers every message with a bitmap: which of
its fingerprints more than one row has.  Fingerprints are drawn from a range of
``SPARE`` times the number of rows, so a message spends some log2(SPARE * rows
/ rows of the partition) + 1.5 bits on one, and about one row in ``SPARE`` is
suspected wrongly.  The bitmaps go back to the partitions, which read their
documents again; only the texts of suspects are shuffled, and grouped byte for
byte (counted within each task first, so a text that a third of the rows share
is one row a task).  What leaves the first reading are fingerprints, no texts.

The documents are read twice, in the same partitions and order, as a scan of
files gives them; a frame whose plan shuffles is written to the shared folder
first.  A block whose fingerprints differ on the second reading has all its
rows suspected; another number of blocks ends the job.

Defined results: a null text is an empty one; texts are equal when identical
after lower-casing A-Z; of equal texts the row of the largest ``doc_id`` stays
(nulls are the smallest; ``keep_id`` is null if there is no other), and of rows
that also share that id one; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import bounded_batches, staged

if TYPE_CHECKING:
    import pandas as pd

_U = np.uint64
#: Fingerprints per row, rows and bytes of one block (or one longer text), rows
#: of one message's chunk, and rows one owner answers for (8 bytes each once decoded).
SPARE, BLOCK_ROWS, BLOCK_BYTES, CHUNK_ROWS, OWNED_ROWS = 256, 2_000, 1 << 20, 4_000_000, 8_000_000
#: An owner gets at least so many rows, where there are few.
LEAST_OWNED = 512


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(k, code) of sorted distinct uint64 values: the gaps' quotients by 2 ** k
    in unary, then their remainders in k bits each."""
    gaps = np.diff(values, prepend=_U(0))
    k = max(0, int(int(values[-1]) // len(values)).bit_length() - 1)
    ends = np.cumsum((gaps >> _U(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=_U)[None, :]) & _U(1)).astype(np.uint8)
    return k, np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def golomb_decode(k: int, code: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    at = int(ends[-1]) + 1
    rest = bits[at:at + n * k].reshape(n, k).astype(_U)
    gaps = (np.diff(ends, prepend=-1) - 1).astype(_U) << _U(k)
    return np.cumsum(gaps + (rest << np.arange(k, dtype=_U)[None, :]).sum(axis=1, dtype=_U), dtype=_U)


def fingerprint(text: bytes) -> int:
    """64 bits of a normalised text."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text)


def _blocks(rows: Iterable[tuple], of: Callable[[bytes], int]) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """Blocks of rows (doc_id, text as bytes): ids, normalised texts, 64-bit
    fingerprints.  Where a block ends depends on the rows alone."""
    ids, texts, size = [], [], 0
    for doc, text in rows:
        ids.append(doc)
        texts.append(text.lower())  # of bytes: changes A-Z only
        size += len(text)
        if len(ids) >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield ids, texts, np.fromiter(map(of, texts), _U, len(texts))
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, np.fromiter(map(of, texts), _U, len(texts))


def messages(docs: DataFrame, limit: int, owners: int, of: Callable[[bytes], int] = fingerprint) -> DataFrame:
    """What the partitions send: (part, chunk, owner, n, k, code, again, blocks).
    ``again`` marks fingerprints of several rows of the chunk; ``blocks`` (in
    one message of a chunk) has a checksum of each block's fingerprints."""
    width = -(-limit // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held, sums = TaskContext.get().partitionId(), 0, [], []

        def flush() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            owner = (values // _U(width)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            rows = []
            for v, t, o in zip(np.split(values, cuts), np.split(times, cuts), np.split(owner, cuts), strict=True):
                k, code = golomb_encode(v - _U(int(o[0]) * width))
                rows.append((part, chunk, int(o[0]), len(v), k, code, np.packbits(t > 1).tobytes(), [] if rows else sums))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)],
                ["part", "chunk", "owner", "n", "k", "code", "again", "blocks"])

        rows = ((None, t) for b in batches for t in b.column("text").cast(pa.binary()).to_pylist())
        for _, _, h in _blocks(rows, of):
            held.append(h % _U(limit))
            sums.append(zlib.crc32(h.tobytes()))
            if sum(map(len, held)) >= CHUNK_ROWS:
                yield flush()
                chunk, held, sums = chunk + 1, [], []
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "part int, chunk int, owner int, n int, k int, code binary, again binary, blocks array<long>")


def replies(sent: DataFrame) -> DataFrame:
    """Each message with the owner's bitmap: bit i is set if several rows of
    all have its i-th fingerprint.  Messages go back whole, as tasks keep no
    state between the two readings."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([golomb_decode(r.k, r.code, r.n) for r in pdf.itertuples(index=False)])
        again = np.concatenate([np.unpackbits(np.frombuffer(r.again, np.uint8))[:r.n] for r in pdf.itertuples(index=False)])
        _, place, times = np.unique(values, return_inverse=True, return_counts=True)
        several = times > 1
        several[place[again > 0]] = True
        each = np.split(several[place], np.cumsum(pdf["n"].to_numpy())[:-1])
        return pdf.drop(columns=["again"]).assign(bitmap=[np.packbits(x).tobytes() for x in each])

    return sent.groupBy("owner").applyInPandas(
        run, "part int, chunk int, owner int, n int, k int, code binary, blocks array<long>, bitmap binary")


def _answers(rows: Iterable, width: int) -> Iterator[tuple[int, bytes | None]]:
    """For each block of a partition, in order: its checksum and, with the
    first block of a chunk, the chunk's repeated fingerprints."""
    for _, of_chunk in itertools.groupby(rows, key=lambda r: r["chunk"]):
        found, sums = [], []
        for r in of_chunk:
            sums += r["blocks"]
            marks = np.unpackbits(np.frombuffer(bytes(r["bitmap"]), np.uint8))[:r["n"]] > 0
            found.append(golomb_decode(r["k"], bytes(r["code"]), r["n"])[marks] + _U(r["owner"] * width))
        several = np.concatenate(found).tobytes()
        for i, checksum in enumerate(sums):
            yield checksum, None if i else several


def _marked(part: int, pairs: Iterable, limit: int) -> Iterator[tuple]:
    """Rows (uid, doc_id, h, text_sha256, text); text of suspects only."""
    several, uid = np.empty(0, _U), part << 40
    for (ids, texts, raw), (checksum, news) in pairs:
        if news is not None:
            several = np.frombuffer(news, _U)
        h = np.frombuffer(raw, _U)
        suspect = np.isin(h % _U(limit), several) if zlib.crc32(raw) == checksum else np.ones(len(h), bool)
        for doc, text, one, key in zip(ids, texts, suspect.tolist(), h.view(np.int64).tolist(), strict=True):
            yield uid, doc, key, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if one else None
            uid += 1


def exact_duplicates(docs: DataFrame, of: Callable[[bytes], int] = fingerprint) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``
    (doc_id, text).  ``of`` gives the 64-bit fingerprint of a normalised text;
    the result does not depend on it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = staged(docs, "documents")
    n = docs.count()
    if not n:
        return docs.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                           F.lit(True).alias("kept"), F.sha2("text", 256).alias("text_sha256"))
    limit = SPARE * n
    owners = max(-(-n // OWNED_ROWS), min(-(-n // LEAST_OWNED), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sent = staged(messages(docs, limit, owners, of), "messages")
    answered = staged(replies(sent), "replies")

    # Blocks meet their answers one by one.  Both sides are made by the workers
    # that read them, so a task has three Python workers.
    one = BatchedSerializer(CPickleSerializer(), 1)
    width = -(-limit // owners)
    blocks = (docs.rdd.mapPartitions(lambda rows: ((i, t, h.tobytes()) for i, t, h in _blocks(((r[0], r[1].encode()) for r in rows), of)))
              ._reserialize(one))
    home = answered.repartitionById(blocks.getNumPartitions(), F.col("part")).sortWithinPartitions("chunk", "owner")
    answers = home.rdd.mapPartitions(lambda rows: _answers(rows, width))._reserialize(one)
    rows = blocks.zip(answers).mapPartitionsWithIndex(lambda part, pairs: _marked(part, pairs, limit))
    schema = "uid long, doc_id long, h long, text_sha256 string, text string"
    rows = staged(spark.createDataFrame(rows, schema, verifySchema=False), "rows")

    # Byte verification: suspects meet by their texts, counted in each task first.
    suspects = rows.where("text IS NOT NULL")
    groups = ["h", "text"]
    classes = suspects.groupBy(*groups).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
        F.max_by("uid", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("keep_uid"))
    narrow = staged(classes.select("h", "keep_id", "group_size", "keep_uid"), "classes")
    clash = staged(narrow.groupBy("h").count().where("count > 1").select("h"), "clashes")

    def out(r: DataFrame) -> DataFrame:
        return r.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")

    own = rows.where("text IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                            F.lit(True).alias("kept"), "text_sha256")
    ids = suspects.select("uid", "doc_id", "h", "text_sha256")
    if clash.isEmpty():
        return own.unionByName(out(ids.join(narrow, "h")))
    # Different texts of one fingerprint: joined by their texts.
    apart = out(suspects.join(clash, "h", "left_semi").join(staged(classes.join(clash, "h", "left_semi"), "clashing"), groups))
    return own.unionByName(out(ids.join(clash, "h", "left_anti").join(narrow, "h"))).unionByName(apart)
