"""Directory of files -> candidate frame for the triage plan.

Order of work per listed file, as the gates require: type check and
already-published check first (no bytes read for those rows), then read,
then decode.  The gated rows are unioned back unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions.ids import document_id, suffix
from casegrid.functions.text import normalize
from casegrid.plans.triage import mark_published
from casegrid.schema import EMPTY_DOCUMENT, EMPTY_OR_SCANNED_PDF, SUPPORTED_SUFFIXES
from casegrid.sources.content import read_in_tasks, read_with_binary_file
from casegrid.sources.decode import PdfDecoder, decode_documents
from casegrid.sources.listing import list_documents

CANDIDATE_COLUMNS = ("document_id", "source_file", "rel_path", "name", "suffix", "length",
                     "_published", "text", "read_error", "read_message")


def listed_documents(spark: SparkSession, root: str) -> DataFrame:
    """Listing plus id and suffix (P1, P2); the id's hash is of the resolved
    path, its stem of the name as listed."""
    ls = list_documents(spark, root)
    return ls.select(
        document_id(F.col("id_path"), F.col("name")).alias("document_id"),
        "source_file", "rel_path", "name", suffix(F.col("name")).alias("suffix"), "length",
    )


def file_candidates(spark: SparkSession, root: str, *, published: DataFrame | None = None,
                    overwrite: bool = False, pdf_decoder: PdfDecoder | None = None,
                    read_via: str = "tasks") -> DataFrame:
    """Candidate frame for a directory: decoded text for rows that pass the
    type and resume gates; the rest carry no text."""
    listed = mark_published(listed_documents(spark, root), published, overwrite)
    wanted = F.lower(F.col("suffix")).isin(*SUPPORTED_SUFFIXES) & ~F.col("_published")
    to_read = listed.where(wanted)
    if read_via == "binaryFile":
        read = read_with_binary_file(spark, to_read, root)
    else:
        read = read_in_tasks(to_read)
    decoded = decode_documents(read, pdf_decoder)
    skipped = (
        listed.where(~wanted)
        .withColumn("text", F.lit(None).cast("string"))
        .withColumn("read_error", F.lit(None).cast("string"))
        .withColumn("read_message", F.lit(None).cast("string"))
    )
    return decoded.select(*CANDIDATE_COLUMNS).unionByName(skipped.select(*CANDIDATE_COLUMNS))


def ingest_rows(c: DataFrame) -> DataFrame:
    """Ingest-only outcome per candidate row (S7): ``source_file, status,
    error_code, char_count, text`` with status ``skipped`` / ``failed`` /
    ``extracted`` and ``char_count`` in code points of the normalised text."""
    sfx = F.lower(F.col("suffix"))
    text = F.when(sfx.isin(*SUPPORTED_SUFFIXES) & F.col("read_error").isNull(), normalize(F.col("text")))
    c = c.withColumn("text", text)
    code = (
        F.when(~sfx.isin(*SUPPORTED_SUFFIXES), F.lit("UNSUPPORTED_FILE_TYPE"))
        .when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(F.col("text") == "", F.when(sfx == ".pdf", F.lit(EMPTY_OR_SCANNED_PDF)).otherwise(F.lit(EMPTY_DOCUMENT)))
    )
    c = c.withColumn("error_code", code)
    status = (
        F.when(F.col("error_code") == "UNSUPPORTED_FILE_TYPE", F.lit("skipped"))
        .when(F.col("error_code").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("extracted"))
    )
    ok = F.col("error_code").isNull()
    return c.select(
        "source_file", status.alias("status"), "error_code",
        F.when(ok, F.length("text").cast("bigint")).alias("char_count"),
        F.when(ok, F.col("text")).alias("text"),
    )


def ingest_directory(spark: SparkSession, root: str, *, pdf_decoder: PdfDecoder | None = None) -> DataFrame:
    """Ingest only (S7) for a directory.  Unordered; ``listing.ordered`` or
    ``listing.with_positions`` give a narrow projection the listing order."""
    return ingest_rows(file_candidates(spark, root, pdf_decoder=pdf_decoder))
