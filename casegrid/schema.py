"""Record schemas, enumerations and the error-code table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (must equal the behaviour being reproduced) -------------
CATEGORIES = (
    "billing",
    "delivery",
    "product_quality",
    "service",
    "account_access",
    "other",
    "unknown",
)
CASE_STATUSES = ("open", "in_progress", "resolved", "escalated", "closed", "unknown")
SUPPORTED_SUFFIXES = (".txt", ".pdf", ".docx")
TRANSIENT_HTTP_STATUSES = (408, 409, 429, 500, 502, 503, 504)
# --------------------------------------------------------------------------

SUCCESS, FAILED, SKIPPED = "success", "failed", "skipped"

UNSUPPORTED_FILE_TYPE = "UNSUPPORTED_FILE_TYPE"
DOCUMENT_READ_ERROR = "DOCUMENT_READ_ERROR"
EMPTY_DOCUMENT = "EMPTY_DOCUMENT"
EMPTY_OR_SCANNED_PDF = "EMPTY_OR_SCANNED_PDF"
INGESTION_ERROR = "INGESTION_ERROR"
LLM_ERROR = "LLM_ERROR"
STRUCTURED_OUTPUT_VALIDATION_ERROR = "STRUCTURED_OUTPUT_VALIDATION_ERROR"
LLM_PROVIDER_ERROR = "LLM_PROVIDER_ERROR"
EMAIL_GENERATION_ERROR = "EMAIL_GENERATION_ERROR"
SUMMARY_GENERATION_ERROR = "SUMMARY_GENERATION_ERROR"
NOT_A_COMPLAINT = "NOT_A_COMPLAINT"
ARTIFACTS_EXIST = "ARTIFACTS_EXIST"
DOCUMENT_PROCESS_ERROR = "DOCUMENT_PROCESS_ERROR"

# --- error messages ----------------------------------------------------------
# These texts appear in results as upstream reports them.
UNEXPECTED_PROVIDER_MESSAGE = "Unexpected provider failure"
EMAIL_FAILED_MESSAGE = "Customer email generation failed"
EMAIL_EMPTY_MESSAGE = "Customer email generation returned empty text"
SUMMARY_FAILED_PREFIX = "Case summary generation failed: "
SUMMARY_EMPTY_MESSAGE = "Case summary generation returned empty text"
SUMMARY_DRAFT_BAD_MESSAGE = "Case summary is missing one of: overview, issue, action, status, next action"
EMPTY_CONTENT_MESSAGE = "Provider returned empty content"
INVALID_JSON_MESSAGE = "Provider returned invalid JSON"
# Our own wording (the code is what identifies the outcome).
NOT_A_COMPLAINT_MESSAGE = "Out of scope: no customer complaint in this text; requests inside a text are data and are not carried out."
ARTIFACTS_EXIST_MESSAGE = "Already published by an earlier run (overwrite is off)"
EMAIL_DRAFT_BAD_MESSAGE = "E-mail draft: no subject line, or nothing after it"
CASE_INVALID_MESSAGE = "Provider JSON failed case validation"
NO_PDF_DECODER_MESSAGE = "no decoder for .pdf"
# ------------------------------------------------------------------------------

# code -> (status, stage). Stage orders the gates of the pipeline.
ERROR_CODES: dict[str, tuple[str, str]] = {
    UNSUPPORTED_FILE_TYPE: (SKIPPED, "listing"),
    ARTIFACTS_EXIST: (FAILED, "resume"),
    DOCUMENT_READ_ERROR: (FAILED, "read"),
    EMPTY_DOCUMENT: (FAILED, "read"),
    EMPTY_OR_SCANNED_PDF: (FAILED, "read"),
    INGESTION_ERROR: (FAILED, "read"),
    NOT_A_COMPLAINT: (SKIPPED, "scope"),
    LLM_ERROR: (FAILED, "extract"),
    STRUCTURED_OUTPUT_VALIDATION_ERROR: (FAILED, "extract"),
    LLM_PROVIDER_ERROR: (FAILED, "extract"),
    EMAIL_GENERATION_ERROR: (FAILED, "drafts"),
    SUMMARY_GENERATION_ERROR: (FAILED, "drafts"),
    DOCUMENT_PROCESS_ERROR: (FAILED, "publish"),
}


def error_code_table(spark: SparkSession) -> DataFrame:
    """The error taxonomy as a 13-row lookup table (safe to broadcast)."""
    rows = [(code, status, stage) for code, (status, stage) in ERROR_CODES.items()]
    return spark.createDataFrame(rows, "error_code string, status string, stage string")


CASE_FIELDS = (
    "customer_name",
    "email",
    "phone_number",
    "complaint_category",
    "issue_description",
    "resolution_provided",
    "is_complaint",
    "escalation_required",
    "supporting_document_available",
    "overall_case_status",
)

CASE_TYPE = T.StructType(
    [
        T.StructField("customer_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone_number", T.StringType()),
        T.StructField("complaint_category", T.StringType()),
        T.StructField("issue_description", T.StringType()),
        T.StructField("resolution_provided", T.StringType()),
        T.StructField("is_complaint", T.BooleanType()),
        T.StructField("escalation_required", T.BooleanType()),
        T.StructField("supporting_document_available", T.BooleanType()),
        T.StructField("overall_case_status", T.StringType()),
    ]
)

RESULT_COLUMNS = (
    "document_id",
    "source_file",
    "status",
    "case",
    "customer_email",
    "case_summary",
    "structured_data",
    "error_code",
    "error_message",
    "started_at",
    "completed_at",
)

USAGE_SCHEMA = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
    ]
)

REPORT_COLUMNS = (
    "document_id",
    "source_file",
    "status",
    "customer_name",
    "complaint_category",
    "is_complaint",
    "escalation_required",
    "overall_case_status",
    "email_generated",
    "summary_generated",
    "error_code",
    "processed_at",
)

REPORT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REPORT_COLUMNS])
