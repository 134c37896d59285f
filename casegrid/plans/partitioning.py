"""Keep CPU-heavy row work spread over the cluster.

Text triage costs far more CPU per row than moving the row, so a scan that
yields fewer partitions than its size or the cluster's cores call for (one big
row group, a few compacted files) is spread with ``repartition(n, key)`` on a
unique id before the regex work; ``n`` grows with the input.  A wide scan (the normal case at scale) is left
as is: no shuffle.  AQE does not coalesce an explicit ``repartition(n)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


SPREAD_BYTES = 64 << 20  # input bytes of one partition, by the planner's estimate


def target_partitions(df: DataFrame, factor: int = 2) -> int:
    """Partitions for ``df``: by its size, and no fewer than keep the cores busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism * factor
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:  # no JVM handle
        size = 0
    # The estimate of a plan without statistics is boundless: not a size.
    return max(1, cores, -(-size // SPREAD_BYTES) if size < 1 << 60 else 0)


def _scan_partitions(df: DataFrame) -> int | None:
    """Partition count of a plan without exchanges, found by planning only.

    For an adaptive plan (one with exchanges) counting would execute its
    shuffle stages, so ``None`` is returned instead."""
    try:
        plan = df._jdf.queryExecution().executedPlan()
    except AttributeError:  # no JVM handle (e.g. a Spark Connect session)
        return None
    if plan.nodeName() == "AdaptiveSparkPlan":
        return None
    return plan.execute().getNumPartitions()


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Repartition only when ``df`` has too few partitions.

    With ``key`` (a unique id) rows are hash-partitioned on it: even, and
    deterministic on task retry without the per-partition sort Spark adds
    before a round-robin exchange.  Without a key, round-robin."""
    try:
        target = min_partitions or target_partitions(df)
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): leave as is
        return df
    n = _scan_partitions(df)
    if n is not None and n >= max(1, target // 2):
        return df
    return df.repartition(target, key) if key else df.repartition(target)
