"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  It is posted, with
its place in their orders, in the inverted files of its ``prefix`` nearest
pivots; the files are made per shard of the vectors and written to the shared
folder.  A query reads the files of its own nearest pivots, which sums up its
footrule distance to the vectors posted there (a missing pivot counts as place
``prefix``).  In the order of that distance, whole blocks of vectors are
ranked again by the exact Euclidean distance until ``quiet`` blocks on end
bring no nearer neighbour; so a crowd of near-equal vectors is read as far as
it goes.  The shards' nearest are merged.  Queries and vectors meet in blocks
of bounded size (a query block by a shard).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part, as queries neither;
neighbours have the query's dimension; a query's own id is no neighbour, but
other ids with an equal vector are; rows of equal id and vector count once; of
equal distances the smaller id comes first; with fewer candidates than ``k``,
all are given; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.llm.common import bounded_batches, staged

#: Pivots (a hash sample of the vectors), pivots a vector is posted under, rows
#: of a shard, queries of a block, part of a shard ranked again at a time and
#: blocks without gain that end a query.
PIVOTS, PREFIX, SHARD_ROWS, QUERY_ROWS, SHARE, QUIET = 96, 24, 10_000, 4_000, 0.05, 3


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b; for ranking pivots only."""
    return (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    v = F.col("v")
    sane = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return (embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.coalesce(sane, F.lit(False)))
            .dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")))


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """At most ``n`` distinct vectors of each dimension, by least hash."""
    rows = vectors.select("dim", "v").distinct()
    top = rows.groupBy("dim").agg(F.min_by(F.struct("v"), F.xxhash64("v")).alias("first"), F.count("*").alias("n"))
    counts = {r["dim"]: r["n"] for r in top.select("dim", "n").collect()}
    out = {}
    for dim, size in counts.items():
        share = min(1.0, 2.0 * n / size)
        some = (rows.where(F.col("dim") == dim).where((F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= int(share * (1 << 20))))
                .orderBy(F.xxhash64("v"), "v").limit(n).collect())
        out[dim] = np.array([r["v"] for r in some] or [top.where(F.col("dim") == dim).first()["first"]["v"]], float)
    return out


def build_index(vectors: DataFrame, pivots: dict[int, np.ndarray], prefix: int = PREFIX,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per shard: one row of vectors (pivot -1) and one per pivot with the
    places and row numbers posted there."""
    shards = max(1, -(-vectors.count() // shard_rows))
    bounded_batches(vectors.sparkSession)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        near = _order(v, pivots[v.shape[1]], prefix)
        row, place = np.divmod(np.arange(near.size), near.shape[1])
        by = np.argsort(near.ravel(), kind="stable")
        cuts = np.flatnonzero(np.diff(near.ravel()[by])) + 1
        dim, shard = v.shape[1], int(pdf["shard"].iloc[0])
        out = [(dim, shard, -1, pdf["vec_id"].to_numpy(np.int64).tobytes(), v.tobytes())]
        for one in np.split(by, cuts):
            out.append((dim, shard, int(near.ravel()[one[0]]), row[one].astype(np.int32).tobytes(),
                        place[one].astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["dim", "shard", "pivot", "a", "b"])

    return staged(vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
                  .groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, pivot int, a binary, b binary"), "index")


def _order(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    return np.argsort(_distances(v, pivots), axis=1, kind="stable")[:, :min(prefix, len(pivots))]


def nearest(query: np.ndarray, own: int, order: np.ndarray, files: dict[int, tuple[np.ndarray, np.ndarray]],
            ids: np.ndarray, v: np.ndarray, k: int, share: float, quiet: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``k`` nearest found in one shard."""
    n, length = len(ids), len(order)
    footrule = np.full(n, 2 * length * length, np.int32)
    for place, p in enumerate(order.tolist()):
        if p in files:
            rows, places = files[p]
            footrule[rows] += np.abs(places.astype(np.int32) - place) - 2 * length
    rank = np.argsort(footrule, kind="stable")
    step = max(4 * k, int(n * share))
    best_i, best_d = np.empty(0, np.int64), np.empty(0)
    calm = 0
    for at in range(0, n, step):
        rows = rank[at:at + step]
        d = np.sqrt(((v[rows] - query) ** 2).sum(1))
        i = ids[rows]
        other = i != own
        i, d = np.concatenate([best_i, i[other]]), np.concatenate([best_d, d[other]])
        top = np.lexsort((i, d))[:k]
        calm = calm + 1 if len(best_i) == k and (top < k).all() else 0
        best_i, best_d = i[top], d[top]
        if calm >= quiet:
            break
    return best_i, best_d


def search(embeddings: DataFrame, is_query: Column, k: int = 10, n_pivots: int = PIVOTS, prefix: int = PREFIX,
           share: float = SHARE, quiet: int = QUIET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row for which
    ``is_query`` (an expression over vec_id) is true, among all rows."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    vectors = staged(usable(embeddings), "vectors")
    pivots = pivots_of(vectors, n_pivots)
    index = build_index(vectors, pivots, prefix)
    queries = vectors.where(is_query).select("dim", F.col("vec_id").alias("query_id"), "v")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    shards = index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("of_shard")).distinct()
    # Each shard meets each block of queries in a group of bounded size.
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
             .join(shards, F.col("dim") == F.col("of_dim"))
             .select("dim", F.col("of_shard").alias("shard"), "block", "query_id", "v"))

    def find(key, files: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        base = files[files["pivot"] == -1]
        if not len(base) or not len(asked):
            return pd.DataFrame({n: [] for n in names})
        ids = np.frombuffer(base["a"].iloc[0], np.int64)
        v = np.frombuffer(base["b"].iloc[0], float).reshape(len(ids), -1)
        posted = {int(r.pivot): (np.frombuffer(r.a, np.int32), np.frombuffer(r.b, np.uint8))
                  for r in files[files["pivot"] >= 0].itertuples(index=False)}
        q = np.stack(asked["v"].to_numpy()).astype(float)
        orders = _order(q, pivots[v.shape[1]], prefix)
        out = [[], [], []]
        for query, own, order in zip(q, asked["query_id"], orders, strict=True):
            i, d = nearest(query, own, order, posted, ids, v, k, share, quiet)
            out[0] += [own] * len(i)
            out[1] += i.tolist()
            out[2] += d.tolist()
        return pd.DataFrame(dict(zip(names, out, strict=True)))

    found = (left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block"))
             .applyInPandas(find, "query_id long, vec_id long, score double"))
    # A query id that occurs with several vectors keeps each neighbour's least distance.
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
