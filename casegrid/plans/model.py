"""Triage with a model provider: relational retry passes.

Plan, for rows that passed the cheap gates:

1. stage the gated rows with a key of their own (one write, so every pass
   reads the same rows and the gate runs once);
2. extraction pass k (k = 1..max_attempts): prompt (repair line from pass
   2), infer, **stage the raw output**, validate it natively (VARIANT) and
   stage the verdicts;
   valid cases and hard failures are final, validation failures and
   transient failures go to pass k+1 (transient ones after a back-off of
   ``2**(k-1)`` s), and the last pass's failures are final;
3. complaint cases get an email and a summary in one inference pass (the
   two calls overlap), staged, then checked natively (F6, F7);
4. everything is unioned with the gated-out rows and run through the same
   precedence and result projection as the rule-based plan.

Staging is what keeps each call to one per row (G1): Spark recomputes
lazy plans, so every inference output is written once and only re-read.
Staged passes live under the run id; rerunning with the same ``run_id``
after a driver failure re-reads every pass that committed.  The stage
carries a fingerprint of the input, the prompts, the provider and the
settings; a run id used with others is refused.
Task retries after an executor loss can still repeat a partition's calls
(at-least-once), which is why speculation is off in the session defaults.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions import drafts as D
from casegrid.functions.text import is_blank
from casegrid.functions.validate import validate_case_json
from casegrid.operators.aggregate import usage_rows
from casegrid.operators.infer import TRANSIENT, UNEXPECTED, USAGE_FIELDS, ProviderFactory, infer
from casegrid.plans.triage import JSON_OPTIONS, add_draft_checks, fence, finish, gate
from casegrid.schema import (
    CASE_TYPE,
    EMAIL_EMPTY_MESSAGE,
    EMAIL_FAILED_MESSAGE,
    EMAIL_GENERATION_ERROR,
    LLM_PROVIDER_ERROR,
    STRUCTURED_OUTPUT_VALIDATION_ERROR,
    SUMMARY_EMPTY_MESSAGE,
    SUMMARY_FAILED_PREFIX,
    SUMMARY_GENERATION_ERROR,
    UNEXPECTED_PROVIDER_MESSAGE,
)
from casegrid.session import staging_root

#: Calls in flight at once over the whole job, unless ``partitions`` is given:
#: tasks of an inference pass times threads of a task.
MAX_CALLS_IN_FLIGHT = 64

_FLOW_COLUMNS = (
    "document_id", "source_file", "_gate", "_gate_message", "case", "_extract_error",
    "_extract_message", "customer_email", "case_summary", "_email_error", "_email_message",
    "_summary_error", "_summary_message",
)


@dataclass
class ModelRun:
    results: DataFrame
    usage: DataFrame
    run_id: str
    stage_dir: str
    prompt_version: str = D.PROMPT_VERSION

    def cleanup(self) -> None:
        """Delete this run's staged tables (after its results are written:
        ``results`` and ``usage`` read from them lazily)."""
        spark = self.results.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.stage_dir)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _committed(spark: SparkSession, path: str) -> bool:
    """True if a write job committed ``path`` (its ``_SUCCESS`` marker exists)."""
    try:
        jvm = spark._jvm
        marker = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
        fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
        return bool(fs.exists(marker))
    except AttributeError:  # no JVM handle: always recompute
        return False


def _stage(df: DataFrame, path: str) -> DataFrame:
    """Write once, then re-read.  A pass already committed under this run id
    (a rerun after a driver failure) is re-read, not recomputed, so its model
    calls are not paid twice."""
    spark = df.sparkSession
    if not _committed(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _fill(df: DataFrame) -> DataFrame:
    types = {"case": CASE_TYPE}
    for c in _FLOW_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    return df.select(*_FLOW_COLUMNS)


def _usage(out: DataFrame, task: str, attempt: Column) -> DataFrame:
    """The calls that reported usage, with their raw counts settled."""
    calls = out.where(F.col(f"{task}_reported")).select(
        "document_id",
        F.lit(task).alias("task"),
        attempt.cast("int").alias("attempt"),
        "model",
        *[F.col(f"{task}_{name}").alias(name) for name in USAGE_FIELDS],
    )
    return usage_rows(calls).drop("_counted")


def _dealt(prompts: DataFrame, partitions: int | None, concurrency: int) -> DataFrame:
    """Spread the prompts over as many tasks as may call at once."""
    n = partitions or max(1, MAX_CALLS_IN_FLIGHT // max(1, concurrency))
    return prompts.repartition(n, "_row")


def extraction_passes(candidates: DataFrame, factory: ProviderFactory, *, max_attempts: int,
                      stage: str, sleep: Callable[[float], None], partitions: int | None,
                      concurrency: int) -> tuple[DataFrame, DataFrame]:
    """Bounded extraction with repair (U2).  Returns (outcomes, usage):
    outcomes has ``_row, document_id, source_file, case, _extract_error,
    _extract_message``, one row per candidate.

    ``candidates`` has a unique ``_row``: document ids may repeat (they are
    short hashes of paths), so they never serve as a join key here."""
    attempts = max(1, max_attempts)
    pending, finals, usage = None, [], []
    for k in range(1, attempts + 1):
        # One join per pass: it picks the rows and brings their back-off.
        rows = candidates.withColumn("wait_s", F.lit(0.0)) if pending is None else candidates.join(pending, "_row")
        prompts = rows.select("_row", "document_id", "source_file", "wait_s",
                              D.extraction_prompt(F.col("text"), F.lit(k > 1)).alias("prompt_extract"))
        out = _stage(infer(_dealt(prompts, partitions, concurrency), factory, ("extract",), sleep=sleep,
                           concurrency=concurrency), f"{stage}/extract_{k}")
        usage.append(_usage(out, "extract", F.lit(k)))
        err, valid = F.col("extract_error"), F.col("_v.case").isNotNull()
        bad_json = err.isNull() & ~valid
        transient = F.coalesce(err == TRANSIENT, F.lit(False))
        again = (bad_json | transient) & F.lit(k < attempts)
        # Staged too: each reply is parsed once.
        done = _stage(
            fence(validate_case_json(out, "extract_content", "_v")).select(
                "_row", "document_id", "source_file",
                F.col("_v.case").alias("case"),
                F.when(bad_json, F.lit(STRUCTURED_OUTPUT_VALIDATION_ERROR))
                .when(err.isNotNull(), F.lit(LLM_PROVIDER_ERROR)).alias("_extract_error"),
                F.when(bad_json, F.col("_v.error_message"))
                .when(err == UNEXPECTED, F.lit(UNEXPECTED_PROVIDER_MESSAGE))
                .when(err.isNotNull(), F.col("extract_message")).alias("_extract_message"),
                again.alias("_again"),
                F.when(transient, F.lit(float(2 ** (k - 1)))).otherwise(F.lit(0.0)).alias("wait_s"),
            ), f"{stage}/outcome_{k}")
        finals.append(done.where("NOT _again").drop("_again", "wait_s"))
        pending = done.where("_again").select("_row", "wait_s")
    return reduce(DataFrame.unionByName, finals), reduce(DataFrame.unionByName, usage)


def draft_pass(cases: DataFrame, factory: ProviderFactory, *, stage: str,
               sleep: Callable[[float], None], partitions: int | None,
               concurrency: int) -> tuple[DataFrame, DataFrame]:
    """Email and summary for complaint cases, in one staged pass."""
    case_json = F.to_json(F.col("case"), JSON_OPTIONS)
    prompts = cases.select(
        "_row", "document_id", "source_file", "case",
        D.case_prompt(case_json, D.EMAIL_INSTRUCTION).alias("prompt_email"),
        D.case_prompt(case_json, D.SUMMARY_INSTRUCTION).alias("prompt_summary"),
    )
    out = _stage(infer(_dealt(prompts, partitions, concurrency), factory, ("email", "summary"), sleep=sleep,
                       concurrency=concurrency), f"{stage}/drafts")
    usage = _usage(out, "email", F.lit(1)).unionByName(_usage(out, "summary", F.lit(1)))
    email_fail = F.col("email_error").isNotNull()
    summary_fail = F.col("summary_error").isNotNull()
    email_blank, summary_blank = is_blank(F.col("email_content")), is_blank(F.col("summary_content"))
    drafted = out.select(
        "document_id", "source_file", "case",
        F.when(~email_fail, F.col("email_content")).alias("customer_email"),
        F.when(~summary_fail, F.col("summary_content")).alias("case_summary"),
        F.when(email_fail | email_blank, F.lit(EMAIL_GENERATION_ERROR)).alias("_email_error"),
        F.when(email_fail, F.lit(EMAIL_FAILED_MESSAGE)).when(email_blank, F.lit(EMAIL_EMPTY_MESSAGE)).alias("_email_message"),
        F.when(summary_fail | summary_blank, F.lit(SUMMARY_GENERATION_ERROR)).alias("_summary_error"),
        F.when(summary_fail, F.concat(F.lit(SUMMARY_FAILED_PREFIX), F.col("summary_message")))
        .when(summary_blank, F.lit(SUMMARY_EMPTY_MESSAGE)).alias("_summary_message"),
    )
    return drafted, usage


def _fingerprint(docs: DataFrame, factory: ProviderFactory, max_attempts: int, overwrite: bool) -> str:
    """What a staged pass depends on: the input rows (an order-free digest),
    the prompts, the provider and the number of attempts."""
    cols = [F.col(c) for c in ("document_id", "source_file", "suffix", "text", "read_error")]
    n, digest = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0))).first()
    name = f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', repr(type(factory)))}"
    return json.dumps([int(n), str(digest), D.PROMPT_VERSION, name, max_attempts, overwrite])


def _claim(spark: SparkSession, stage: str, run_id: str, fingerprint: str) -> None:
    """Record the stage's fingerprint, or refuse a stage made from another."""
    path = f"{stage}/fingerprint"
    if _committed(spark, path):
        if spark.read.parquet(path).first()["fingerprint"] != fingerprint:
            raise ValueError(f"run id {run_id!r} was used with other input, prompts, provider or settings")
    else:
        spark.range(1).select(F.lit(fingerprint).alias("fingerprint")).write.mode("overwrite").parquet(path)


def triage_with_model(spark: SparkSession, docs: DataFrame, factory: ProviderFactory, *,
                      max_attempts: int = 2, published: DataFrame | None = None,
                      overwrite: bool = False, run_id: str | None = None,
                      sleep: Callable[[float], None] = time.sleep, partitions: int | None = None,
                      concurrency: int = 4, started_at: datetime | None = None,
                      completed_at: datetime | None = None) -> ModelRun:
    """Full pipeline with a model provider.  Runs the inference jobs
    eagerly (each is staged); the returned frames are cheap re-reads."""
    run_id = run_id or uuid.uuid4().hex
    stage = f"{staging_root(spark).rstrip('/')}/casegrid/{run_id}"
    _claim(spark, stage, run_id, _fingerprint(docs, factory, max_attempts, overwrite))
    # Staged once, with the gate's verdict and a key of its own for each row
    # (unique; stable from here on, since it is written).
    g = _stage(fence(gate(docs, published=published, overwrite=overwrite))
               .select("document_id", "source_file", "_gate", "_gate_message", F.when(F.col("_gate").isNull(), F.col("text")).alias("text"))
               .withColumn("_row", F.monotonically_increasing_id()), f"{stage}/gated")
    gated_out = g.where(F.col("_gate").isNotNull()).select("document_id", "source_file", "_gate", "_gate_message")
    candidates = g.where(F.col("_gate").isNull()).select("_row", "document_id", "source_file", "text")

    outcomes, usage = extraction_passes(candidates, factory, max_attempts=max_attempts, stage=stage,
                                        sleep=sleep, partitions=partitions, concurrency=concurrency)
    complaint = F.col("case").isNotNull() & F.col("case.is_complaint")
    drafted, draft_usage = draft_pass(outcomes.where(complaint), factory, stage=stage, sleep=sleep,
                                      partitions=partitions, concurrency=concurrency)
    flow = (
        _fill(gated_out)
        .unionByName(_fill(outcomes.where(~F.coalesce(complaint, F.lit(False)))))
        .unionByName(_fill(drafted))
    )
    ready = F.col("case").isNotNull() & F.col("case.is_complaint")
    results = finish(add_draft_checks(flow, ready), started_at=started_at, completed_at=completed_at)
    return ModelRun(results=results, usage=usage.unionByName(draft_usage), run_id=run_id, stage_dir=stage,
                    prompt_version=D.PROMPT_VERSION)
