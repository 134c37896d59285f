"""Report, manifest and payload projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.ids import base_name
from casegrid.schema import REPORT_COLUMNS


def bool_cell(b: Column) -> Column:
    """``true``/``false``, and ``""`` for null."""
    return F.when(b.isNull(), F.lit("")).when(b, F.lit("true")).otherwise(F.lit("false"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with ``+00:00``; the fraction only when micros are non-zero."""
    # Wall-clock time in UTC whatever the session time zone is: micros since
    # the epoch, added to a zoneless epoch and cast to text.  (date_format
    # would go through the session's local time.)
    micros = F.unix_micros(ts)
    seconds = (F.floor(micros / 1_000_000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    clock = F.replace(F.left(utc.cast("string"), F.lit(19)), F.lit(" "), F.lit("T"))
    rest = F.pmod(micros, F.lit(1_000_000))
    frac = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0")))
    return F.concat(clock, frac, F.lit("+00:00"))


def report_rows(results: DataFrame, *more: str) -> DataFrame:
    """One all-string row per listed file (P4), columns in report order, then
    the columns ``more`` of ``results``."""
    case = F.col("case")
    has = case.isNotNull()
    cells = {
        "document_id": F.col("document_id"),
        "source_file": F.col("source_file"),
        "status": F.col("status"),
        "customer_name": F.when(has, F.coalesce(case["customer_name"], F.lit(""))).otherwise(F.lit("")),
        "complaint_category": F.when(has, case["complaint_category"]).otherwise(F.lit("")),
        "is_complaint": bool_cell(case["is_complaint"]),
        "escalation_required": bool_cell(case["escalation_required"]),
        "overall_case_status": F.when(has, case["overall_case_status"]).otherwise(F.lit("")),
        "email_generated": bool_cell(F.col("customer_email").isNotNull()),
        "summary_generated": bool_cell(F.col("case_summary").isNotNull()),
        "error_code": F.coalesce(F.col("error_code"), F.lit("")),
        "processed_at": iso_utc(F.coalesce(F.col("completed_at"), F.col("started_at"))),
    }
    return results.select(*[cells[c].alias(c) for c in REPORT_COLUMNS], *more)


def ordered_report(report: DataFrame) -> DataFrame:
    """Report order: by source path, code-point order (O2).  Sort only this
    narrow projection, never rows that still carry text.

    The range partitioner samples its input in a separate job; an exchange
    of the narrow rows first (hashed on the id, sized by the planner from the
    data) means that job reads shuffle output instead of recomputing the whole
    triage plan."""
    return report.repartition("document_id").orderBy("source_file")


def with_base_names(report: DataFrame) -> DataFrame:
    """Report for display: ``source_file`` cut to its base name."""
    src = F.col("source_file")
    return report.withColumn(
        "source_file", F.when(F.coalesce(src, F.lit("")) == "", F.lit("")).otherwise(base_name(src))
    )


def manifest_rows(results: DataFrame, *more: str) -> DataFrame:
    """Per-document manifest entries (P5): id, base name, status, code."""
    return results.select(
        "document_id",
        base_name(F.col("source_file")).alias("source_file"),
        "status",
        "error_code",
        *more,
    )


def payload_rows(results: DataFrame, *more: str) -> DataFrame:
    """Per-document API payload entries (K7): bodies, blanks as ``""`` and
    structured data as ``"{}"`` when absent."""
    return results.select(
        base_name(F.col("source_file")).alias("source_file"),
        "document_id",
        "status",
        "error_code",
        "error_message",
        "case",
        F.coalesce(F.col("customer_email"), F.lit("")).alias("customer_email"),
        F.coalesce(F.col("case_summary"), F.lit("")).alias("case_summary"),
        F.coalesce(F.col("structured_data"), F.lit("{}")).alias("structured_data"),
        *more,
    )
