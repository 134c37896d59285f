"""The triage plan: gates -> case -> drafts -> result rows.

Input is a *candidate* frame, one row per listed file:

    document_id STRING, source_file STRING, suffix STRING,
    text STRING (decoded, not yet normalised; null when not read),
    read_error STRING (null, or a read-stage error code)

Every gate is a column, and the first failing gate wins, in pipeline
order: unsupported type, already published, read error, empty text,
out of scope, extraction failure, model says not a complaint, draft
failure.  Expensive expressions sit under ``CASE WHEN`` branches, so a
gated row never pays for extraction (native CASE evaluates lazily).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions import drafts as D
from casegrid.functions.extract import found_email, rule_case, rule_email_invalid
from casegrid.functions.scope import out_of_scope
from casegrid.functions.text import normalize
from casegrid.functions.validate import email_draft_ok, summary_draft_ok
from casegrid.schema import (
    ARTIFACTS_EXIST,
    ARTIFACTS_EXIST_MESSAGE,
    CASE_TYPE,
    EMAIL_DRAFT_BAD_MESSAGE,
    EMAIL_GENERATION_ERROR,
    EMPTY_DOCUMENT,
    EMPTY_OR_SCANNED_PDF,
    ERROR_CODES,
    LLM_PROVIDER_ERROR,
    NOT_A_COMPLAINT,
    NOT_A_COMPLAINT_MESSAGE,
    SUCCESS,
    SUMMARY_DRAFT_BAD_MESSAGE,
    SUMMARY_GENERATION_ERROR,
    SUPPORTED_SUFFIXES,
    UNEXPECTED_PROVIDER_MESSAGE,
    UNSUPPORTED_FILE_TYPE,
)

JSON_OPTIONS = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}


def _status_of(code: Column) -> Column:
    mapping = F.create_map(*[x for c, (s, _) in ERROR_CODES.items() for x in (F.lit(c), F.lit(s))])
    return F.when(code.isNull(), F.lit(SUCCESS)).otherwise(
        F.coalesce(F.try_element_at(mapping, code), F.lit("failed"))
    )


def mark_published(docs: DataFrame, published: DataFrame | None, overwrite: bool) -> DataFrame:
    """Flag rows whose id already has published artifacts.

    ``published`` is any frame with a ``document_id`` column (prior run
    output).  Where the candidates come from files, call this on the listing,
    before any text is attached.  Where they come from a table, the published
    set is first cut down to the ids that occur among the candidates, by a
    join of ids alone; what is then joined with the texts is no larger than
    the rows to be skipped, which the planner broadcasts while it is small."""
    if "_published" in docs.columns:
        return docs
    if published is None or overwrite:
        return docs.withColumn("_published", F.lit(False))
    ids = published.select("document_id").distinct()
    here = docs.select("document_id").distinct().join(ids, "document_id", "left_semi").withColumn("_published", F.lit(True))
    return docs.join(here, "document_id", "left").withColumn(
        "_published", F.coalesce(F.col("_published"), F.lit(False))
    )


def gate(docs: DataFrame, *, published: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Cheap gates before any extraction: F1, F2, read errors, F3, F4.

    Each helper column is defined once from earlier ones (never redefined
    in terms of itself), so optimizer rewrites that inline aliases stay
    linear in size."""
    d = mark_published(docs, published, overwrite)
    d = d.withColumn("_sfx", F.lower(F.col("suffix")))
    d = d.withColumn(
        "_pre",
        F.when(~F.col("_sfx").isin(*SUPPORTED_SUFFIXES), F.lit(UNSUPPORTED_FILE_TYPE))
        .when(F.col("_published"), F.lit(ARTIFACTS_EXIST))
        .otherwise(F.col("read_error")),
    )
    d = d.withColumn("text", F.when(F.col("_pre").isNull(), normalize(F.col("text"))))
    d = d.withColumn("_empty", F.col("text") == "")
    d = d.withColumn("_lower", F.when(~F.col("_empty"), F.lower(F.col("text"))))
    d = d.withColumn("_oos", out_of_scope(F.col("_lower")))
    empty_code = F.when(F.col("_sfx") == ".pdf", F.lit(EMPTY_OR_SCANNED_PDF)).otherwise(F.lit(EMPTY_DOCUMENT))
    d = d.withColumn(
        "_gate",
        F.coalesce(
            F.col("_pre"),
            F.when(F.col("_empty"), empty_code),
            F.when(F.col("_oos"), F.lit(NOT_A_COMPLAINT)),
        ),
    )
    read_message = F.col("read_message") if "read_message" in docs.columns else F.lit(None).cast("string")
    message = (
        F.when(F.col("_gate") == NOT_A_COMPLAINT, F.lit(NOT_A_COMPLAINT_MESSAGE))
        .when(F.col("_gate") == ARTIFACTS_EXIST, F.lit(ARTIFACTS_EXIST_MESSAGE))
        .when(F.col("_pre").isNotNull(), read_message)
    )
    return d.withColumn("_gate_message", message).drop("_pre", "_empty", "_oos")


def rule_extract(gated: DataFrame) -> DataFrame:
    """X11: case struct for rows that passed the gates, natively.  Rows
    reaching it passed the scope gate, so ``is_complaint`` is true."""
    open_ = F.col("_gate").isNull()
    d = gated.withColumn("_email", F.when(open_, found_email(F.col("text"))))
    bad_email = open_ & rule_email_invalid(F.col("_email"))
    d = d.withColumn("_extract_error", F.when(bad_email, F.lit(LLM_PROVIDER_ERROR)))
    d = d.withColumn("_extract_message", F.when(bad_email, F.lit(UNEXPECTED_PROVIDER_MESSAGE)))
    case = rule_case(F.col("text"), F.col("_lower"), email=F.col("_email"), in_scope=F.lit(True))
    return d.withColumn(
        "case",
        F.when(open_ & F.col("_extract_error").isNull(), case).otherwise(F.lit(None).cast(CASE_TYPE)),
    ).drop("_email")


def rule_drafts(extracted: DataFrame) -> DataFrame:
    """Template drafts (X18, X19) for complaint cases, then F6/F7 checks."""
    ready = F.col("case").isNotNull() & F.col("case.is_complaint")
    d = extracted.withColumn("customer_email", F.when(ready, D.email_draft(F.col("case"))))
    d = d.withColumn("case_summary", F.when(ready, D.summary_draft(F.col("case"))))
    return add_draft_checks(d, ready)


def add_draft_checks(d: DataFrame, ready: Column) -> DataFrame:
    """F6/F7 on the drafts, after any error the draft call itself reported.

    Optional input columns ``_email_error/_email_message`` and
    ``_summary_error/_summary_message`` carry call failures (model path).
    Both drafts are always produced; the email's failure is reported first.
    """
    for c in ("_email_error", "_email_message", "_summary_error", "_summary_message"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    email_err, summ_err = F.col("_email_error"), F.col("_summary_error")
    email_bad = ready & email_err.isNull() & ~email_draft_ok(F.col("customer_email"))
    summary_bad = ready & summ_err.isNull() & ~summary_draft_ok(F.col("case_summary"))
    code = (
        F.when(ready & email_err.isNotNull(), email_err)
        .when(email_bad, F.lit(EMAIL_GENERATION_ERROR))
        .when(ready & summ_err.isNotNull(), summ_err)
        .when(summary_bad, F.lit(SUMMARY_GENERATION_ERROR))
    )
    message = (
        F.when(ready & email_err.isNotNull(), F.col("_email_message"))
        .when(email_bad, F.lit(EMAIL_DRAFT_BAD_MESSAGE))
        .when(ready & summ_err.isNotNull(), F.col("_summary_message"))
        .when(summary_bad, F.lit(SUMMARY_DRAFT_BAD_MESSAGE))
    )
    return d.withColumn("_draft_error", code).withColumn("_draft_message", message)


def finish(d: DataFrame, *, started_at: datetime | None = None,
           completed_at: datetime | None = None) -> DataFrame:
    """F9 precedence and the result record (P3, K1-K3 bodies as columns)."""
    not_complaint = F.col("case").isNotNull() & ~F.col("case.is_complaint")
    code = F.coalesce(
        F.col("_gate"),
        F.col("_extract_error"),
        F.when(not_complaint, F.lit(NOT_A_COMPLAINT)),
        F.col("_draft_error"),
    )
    message = F.coalesce(
        F.col("_gate_message"),
        F.col("_extract_message"),
        F.when(not_complaint, F.lit(NOT_A_COMPLAINT_MESSAGE)),
        F.col("_draft_message"),
    )
    d = d.withColumn("error_code", code)
    d = d.withColumn("error_message", F.when(code.isNotNull(), F.coalesce(message, code)))
    d = d.withColumn("status", _status_of(F.col("error_code")))
    ok = F.col("status") == SUCCESS
    start = F.lit(started_at) if started_at is not None else F.current_timestamp()
    end = F.lit(completed_at) if completed_at is not None else F.current_timestamp()
    row = F.struct(
        F.col("document_id"),
        F.col("source_file"),
        F.col("status"),
        F.when(ok, F.col("case")).alias("case"),
        F.when(ok, F.col("customer_email")).alias("customer_email"),
        F.when(ok, F.col("case_summary")).alias("case_summary"),
        F.when(ok, F.to_json(F.struct("document_id", "source_file", "case"), JSON_OPTIONS)).alias(
            "structured_data"
        ),
        F.col("error_code"),
        F.col("error_message"),
        start.cast("timestamp").alias("started_at"),
        end.cast("timestamp").alias("completed_at"),
    )
    return fence(d, row)


def fence(d: DataFrame, row: Column | None = None) -> DataFrame:
    """Emit rows through a one-element ``inline`` (a plan fence).

    The optimizer pushes a filter through a projection by inlining the
    projected expressions into it; for a status computed from every gate,
    extraction and draft check that both duplicates the work and grows the
    generated code.  Filters on a generator's output stay above the
    generator, so downstream ``where(status = ...)`` runs on computed
    values.  Column pruning still trims unused struct fields below it.
    ``row`` defaults to all columns of ``d``."""
    if row is None:
        row = F.struct(*[F.col(c) for c in d.columns])
    return d.select(F.inline(F.array(row)))


def triage_rules(docs: DataFrame, *, published: DataFrame | None = None, overwrite: bool = False,
                 started_at: datetime | None = None, completed_at: datetime | None = None) -> DataFrame:
    """The whole rule-based pipeline as one lazy plan (no Python per row)."""
    g = gate(docs, published=published, overwrite=overwrite)
    return finish(rule_drafts(rule_extract(g)), started_at=started_at, completed_at=completed_at)
