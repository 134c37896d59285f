"""Lloyd's clustering of integer vectors, sharded by dimension.

Vectors are cut into blocks of ``CHUNK`` vectors by one shard of the columns,
written once as a table bucketed by (shard, chunk).  In each round the tasks of
a column block compute exact partial distances to their slices of the
centroids; the blocks of a chunk are added up (numbers only: vectors by
centroids) and the nearest centroid is taken.  The labels go back to the column
blocks, where each shard adds up its own columns and updates its own slices of
the centroids.  The vectors themselves are not shuffled after the first write,
and the driver holds centroids only (clusters by dimensions).

All arithmetic is on integers.  Components that could take a squared distance
beyond 64 bits are kept as Python integers in their block; a distance beyond
that is null then.

Defined results: vectors that are null, of another number of components or
hold null or non-finite ones take no part; rows of equal id are rows of their
own; a null id is written as an empty text where the starts are drawn, and
rows of equal id start in the order of their components; with fewer vectors
than clusters each is a start; of equally near centroids the smaller number
comes first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import bounded_batches, fresh_folder, staged

#: Columns of a shard and vectors of a block (512 KB of integers together), and
#: bytes of blocks in one bucket.
WIDTH, CHUNK, BUCKET_BYTES = 16, 4096, 64 << 20
#: Components up to this size keep squared distances of up to 4,096 columns within 64 bits.
SAFE = 1 << 24


def _pack(a: np.ndarray) -> bytes:
    """Integers as bytes; Python integers, where 64 bits may not do, pickled."""
    return b"i" + np.ascontiguousarray(a).tobytes() if a.dtype == np.int64 else b"p" + pickle.dumps(a)


def _unpack(b: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(b, np.int64, offset=1).reshape(-1, columns) if b[:1] == b"i" else pickle.loads(b[1:])


def _fit(a: np.ndarray) -> np.ndarray:
    """``a`` as 64-bit integers, if none is large."""
    return a.astype(np.int64) if a.dtype != np.int64 and all(-SAFE <= x <= SAFE for x in a.ravel().tolist()) else a


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, exactly for a power of two."""
    if not vectors.size or np.abs(vectors).max() * scale <= SAFE:
        return np.floor(vectors * scale).astype(np.int64)
    # Doubles of this size are whole numbers.
    return np.array([[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in row] for row in vectors.tolist()], object)


def usable(embeddings: DataFrame, dims: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.coalesce((F.size(v) == dims) & sane, F.lit(False))))


def starts(vectors: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The integers of the ``k`` vectors whose ids have the smallest hashes."""
    of = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", of.alias("h")).orderBy("h", "v").limit(k).collect()
    return scaled(np.array([r["v"] for r in rows], float), scale) if rows else np.empty((0, 0), np.int64)


def _blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(shard, chunk, ids, body): ``ids`` with shard 0 only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, ids, held = TaskContext.get().partitionId() << 32, 0, [], []

        def flush(count: int) -> pa.RecordBatch:
            v, who = scaled(np.stack(held[:count]), scale), pickle.dumps(ids[:count])
            del held[:count], ids[:count]
            at = range(0, dims, WIDTH)
            return pa.RecordBatch.from_arrays(
                [pa.array(range(len(at)), pa.int32()), pa.array([part + n] * len(at), pa.int64()),
                 pa.array([who] + [None] * (len(at) - 1), pa.binary()),
                 pa.array([_pack(_fit(v[:, i:i + WIDTH])) for i in at], pa.binary())], ["shard", "chunk", "ids", "body"])

        for b in batches:
            if not b.num_rows:
                continue
            ids += b.column("vec_id").to_pylist()
            held += list(b.column("v").values.slice(b.column("v").offsets[0].as_py()).to_numpy()[:b.num_rows * dims].reshape(-1, dims))
            while len(held) >= CHUNK:
                yield flush(CHUNK)
                n += 1
        if held:
            yield flush(len(held))

    return vectors.mapInArrow(run, "shard int, chunk long, ids binary, body binary")


def _distances(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(chunk, shard, ids, part): each column block's share of the distances."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for shard, body in zip(b.column("shard").to_pylist(), b.column("body").to_pylist(), strict=True):
                columns = slice(shard * WIDTH, (shard + 1) * WIDTH)
                own = centroids[:, columns]
                x = _unpack(body, own.shape[1])
                parts.append(_pack(np.stack([((x - c) ** 2).sum(axis=1) for c in own], axis=1)))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("shard"), b.column("ids"), pa.array(parts, pa.binary())],
                                             ["chunk", "shard", "ids", "part"])

    return blocks.mapInArrow(run, "chunk long, shard int, ids binary, part binary")


def _nearest(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, distances) of a chunk from its blocks' shares."""
    parts = [_unpack(p, k) for p in pdf["part"]]
    total = sum(parts[1:], parts[0])
    label = np.argmin(total, axis=1)
    return label, total[np.arange(len(label)), label]


def _labels(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(chunk, labels): blocks added up and the nearest centroid taken."""
    k = len(centroids)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "labels": [_nearest(pdf, k)[0].astype(np.int32).tobytes()]})

    return _distances(blocks, centroids).drop("ids").groupBy("chunk").applyInPandas(run, "chunk long, labels binary")


def _updated(blocks: DataFrame, labels: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after each shard has updated its slice."""
    k, dims = centroids.shape
    shards = -(-dims // WIDTH)
    each = labels.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "chunk", "labels")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                columns = min(WIDTH, dims - r["shard"] * WIDTH)
                x, label = _unpack(r["body"], columns), np.frombuffer(r["labels"], np.int32)
                total, count = held.setdefault(r["shard"], (np.zeros((k, columns), object), np.zeros(k, np.int64)))
                for c in np.unique(label):
                    total[c] += x[label == c].sum(axis=0).astype(object)
                count += np.bincount(label, minlength=k)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([pickle.dumps(v) for v in held.values()], pa.binary())],
                                             ["shard", "sums"])

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        got = [pickle.loads(s) for s in pdf["sums"]]
        total, count = sum((g[0] for g in got[1:]), got[0][0]), sum((g[1] for g in got[1:]), got[0][1])
        new = centroids[:, shard * WIDTH:(shard + 1) * WIDTH].astype(object)
        for c in np.flatnonzero(count):
            new[c] = [s // int(count[c]) for s in total[c]]  # rounds down
        return pd.DataFrame({"shard": [shard], "slice": [pickle.dumps(new)]})

    found = (blocks.select("shard", "chunk", "body").join(each, ["shard", "chunk"]).mapInArrow(sums, "shard int, sums binary")
             .groupBy("shard").applyInPandas(update, "shard int, slice binary").collect())  # clusters by dimensions
    return _fit(np.concatenate([pickle.loads(r["slice"]) for r in sorted(found, key=lambda r: r["shard"])], axis=1))


def clusters(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    every vector of ``embeddings`` (vec_id, embedding) that takes part."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    schema = "vec_id long, cluster int, distance long"
    vectors = usable(embeddings, dims)
    centroids = starts(vectors, k, seed, scale)
    if not len(centroids):
        nothing = spark.createDataFrame([], schema)
        return nothing.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    n = vectors.count()
    buckets = max(min(8, -(-n // CHUNK)) * -(-dims // WIDTH), -(-n * dims * 8 // BUCKET_BYTES))
    name = f"casegrid_blocks_{uuid.uuid4().hex}"
    # Sent on by (shard, chunk) once; later joins on these need no exchange of it.
    (_blocks(vectors, dims, scale).repartition(buckets, "shard", "chunk").write.bucketBy(buckets, "shard", "chunk")
     .option("path", fresh_folder(spark, "blocks")).saveAsTable(name))
    try:
        blocks = spark.table(name)
        for _ in range(rounds):
            now = _updated(blocks, _labels(blocks, centroids), centroids)
            if np.array_equal(now, centroids):
                break  # further rounds change nothing
            centroids = now

        def last(pdf: pd.DataFrame) -> pd.DataFrame:
            label, distance = _nearest(pdf, k_now)
            ids = pickle.loads(pdf["ids"].dropna().iloc[0])
            return pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "cluster": label.astype(np.int32),
                                 "distance": pd.array([d if d < 1 << 63 else None for d in distance.tolist()], "Int64")})

        k_now = len(centroids)
        out = staged(_distances(blocks, centroids).groupBy("chunk").applyInPandas(last, schema), "clusters")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = out.groupBy("cluster").agg(total.alias("s")).collect()  # one row a cluster
    inertia = sum(int(r["s"] or 0) for r in by)
    facts = [(r["cluster"], _long(r["s"]), _long(inertia),
              hashlib.sha256(",".join(str(int(x)) for x in centroids[r["cluster"]]).encode()).hexdigest()) for r in by]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(x) -> int | None:
    return int(x) if x is not None and int(x) < 1 << 63 else None
