"""Run-level aggregates (A1-A4).  All are single-pass partial aggregates:
each task pre-aggregates, and only one small row per task is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.schema import SKIPPED, SUCCESS


def outcome_count_columns() -> list[Column]:
    st = F.coalesce(F.col("status"), F.lit(""))
    return [
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(st == SUCCESS).alias("successful"),
        F.count_if(~st.isin(SUCCESS, SKIPPED)).alias("failed"),
        F.count_if(st == SKIPPED).alias("skipped"),
    ]


def outcome_counts(results: DataFrame, *keys: str) -> DataFrame:
    """discovered / successful / failed / skipped; zeros on empty input
    (``count_if``, never ``sum``, which is null on no rows)."""
    cols = outcome_count_columns()
    return results.groupBy(*keys).agg(*cols) if keys else results.agg(*cols)


def status_counts(results: DataFrame) -> DataFrame:
    """Rows per status (A3)."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def usage_rows(calls: DataFrame) -> DataFrame:
    """Per-call token counts with the reporting rules (U7): non-numeric
    counts read as 0, a missing total is prompt + completion, and a call
    that reports all zeros is not counted as a call."""
    p = F.coalesce(F.col("prompt_tokens").try_cast("bigint"), F.lit(0))
    c = F.coalesce(F.col("completion_tokens").try_cast("bigint"), F.lit(0))
    t = F.coalesce(F.col("total_tokens").try_cast("bigint"), F.lit(0))
    return (
        calls.withColumn("prompt_tokens", p)
        .withColumn("completion_tokens", c)
        .withColumn("total_tokens", t)
        .withColumn("_counted", ~((F.col("prompt_tokens") == 0) & (F.col("completion_tokens") == 0)
                                 & (F.col("total_tokens") == 0)))
        .withColumn(
            "total_tokens",
            F.when(F.col("total_tokens") == 0, F.col("prompt_tokens") + F.col("completion_tokens"))
            .otherwise(F.col("total_tokens")),
        )
    )


def usage_totals(calls: DataFrame, *keys: str) -> DataFrame:
    """Token usage (A2): calls and token sums; all null when there were no
    counted calls (never zeros)."""
    u = usage_rows(calls)
    counted = F.col("_counted")
    n = F.count_if(counted)
    aggs = [
        n.alias("calls"),
        F.sum(F.when(counted, F.col("prompt_tokens"))).alias("prompt_tokens"),
        F.sum(F.when(counted, F.col("completion_tokens"))).alias("completion_tokens"),
        F.sum(F.when(counted, F.col("total_tokens"))).alias("total_tokens"),
    ]
    out = u.groupBy(*keys).agg(*aggs) if keys else u.agg(*aggs)
    none = F.col("calls") == 0
    return out.select(
        *keys,
        *[F.when(~none, F.col(c).cast("bigint")).alias(c)
          for c in ("calls", "prompt_tokens", "completion_tokens", "total_tokens")],
    )


def run_timing(results: DataFrame) -> DataFrame:
    """Batch start/end and document durations in ms (A4)."""
    dur = F.unix_millis("completed_at") - F.unix_millis("started_at")
    return results.agg(
        F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"),
        F.max(dur).alias("max_duration_ms"),
        F.sum(dur).alias("total_duration_ms"),
    )
