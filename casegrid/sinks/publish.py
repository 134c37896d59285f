"""Sinks: results table, report CSV, manifest.

Artifacts (structured JSON, email, summary) are columns of one result row,
so the three always appear together (K4); ``sinks.documents`` publishes them as
files.  The results table is
partitioned by ``run_id`` and written with dynamic partition overwrite:
the job commit swaps in the run's partition, and a failed job leaves the
previous one in place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators.aggregate import outcome_counts, usage_totals
from casegrid.operators.report import iso_utc, manifest_rows, payload_rows, report_rows, with_base_names
from casegrid.schema import REPORT_COLUMNS, REPORT_SCHEMA
from casegrid.sinks.jsondoc import JSON_KEEP_NULLS, Section, escaped, write_json_document

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "quote": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "lineSep": "\n",
    "encoding": "UTF-8",
}

# Settings a manifest may show; nothing else (no keys or secrets).
MANIFEST_CONFIG_KEYS = ("llm_provider", "model_name", "max_llm_attempts", "max_document_workers",
                        "input_dir", "output_dir", "overwrite")


def write_results(results: DataFrame, path: str, run_id: str) -> None:
    """Append/replace one run's results (dynamic partition overwrite)."""
    (results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists; any other storage error is raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def published_ids(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame | None:
    """Ids with published artifacts in a results table (input to J1), or None
    while there is no table.

    ``run_id`` names the run that asks: its own earlier rows do not count, so
    a replayed epoch or a rerun batch recomputes its rows as they were.  Only
    the id, status and run columns are read; a storage error is raised, since
    taking it for an empty table would repeat every paid call."""
    if not path_exists(spark, path):
        return None
    t = spark.read.parquet(path)
    if run_id is not None and "run_id" in t.columns:
        t = t.where(F.col("run_id").cast("string") != run_id)
    return t.where(F.col("status") == "success").select("document_id")


def write_report_csv(report: DataFrame, path: str, single_file: bool = False) -> None:
    """The report as CSV (K5): header, minimal quoting, empty cells blank.
    ``single_file`` moves only this narrow projection into one partition, by
    a shuffle, so the triage before it keeps its parallelism."""
    out = report.repartition(1).sortWithinPartitions("source_file") if single_file else report
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Report read-back (S8): every cell a string, quoted newlines kept."""
    return spark.read.schema(REPORT_SCHEMA).options(**CSV_OPTIONS).option("multiLine", "true").csv(path)


def token_usage(spark: SparkSession, usage: DataFrame | None) -> DataFrame:
    """One row ``token_usage``: totals of the calls, null without any."""
    if usage is None:
        return spark.range(1).select(F.lit(None).cast(
            "struct<calls:bigint,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>").alias("token_usage"))
    return usage_totals(usage).select(F.when(F.col("calls").isNotNull(), F.struct("calls", "prompt_tokens", "completion_tokens",
                                                                                 "total_tokens")).alias("token_usage"))


def manifest_frame(spark: SparkSession, results: DataFrame, usage: DataFrame | None, *,
                   started_at, completed_at, config: dict, report_path: str) -> DataFrame:
    """One-row manifest header (K6): times, allow-listed config, counts,
    token usage (null when no calls) and the report path.  The per-document
    entries stay a sibling table (``manifest_rows``) at scale."""
    cfg = {k: config.get(k) for k in MANIFEST_CONFIG_KEYS}
    counts = outcome_counts(results).select(F.struct("discovered", "successful", "failed", "skipped").alias("counts"))
    tok = token_usage(spark, usage)
    head = spark.range(1).select(
        iso_utc(F.lit(started_at)).alias("started_at"),
        iso_utc(F.lit(completed_at)).alias("completed_at"),
        F.from_json(F.lit(json.dumps(cfg)),
                    "llm_provider string, model_name string, max_llm_attempts int, "
                    "max_document_workers int, input_dir string, output_dir string, overwrite boolean")
        .alias("config"),
        F.lit(report_path).alias("report_path"),
    )
    # Three one-row frames side by side: an equi-join on a constant key.
    one = F.lit(1).alias("_one")
    return (head.select("*", one).join(counts.select("*", one), "_one")
            .join(tok.select("*", one), "_one").drop("_one"))


def write_manifest(manifest: DataFrame, results: DataFrame, path: str) -> None:
    """Header as one JSON object, entries as a sibling JSON table."""
    manifest.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/header")
    manifest_rows(results).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/results")


def _entries(rows: DataFrame) -> Section:
    """Entries of a JSON array in report order (by the path of the row, which
    ``rows`` has as ``_path`` besides)."""
    # Sent on by path before it is sorted, as the report is: the sort's sample reads these, not the whole plan.
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "_path"]), JSON_KEEP_NULLS)
    return Section(rows.select("_path", line.alias("line")).repartition("_path").orderBy("_path"))


def _header(frame: DataFrame) -> list[tuple[str, str]]:
    """Members of a one-row frame as JSON texts."""
    row = frame.select(*[F.to_json(F.struct(F.col(c).alias("x")), JSON_KEEP_NULLS).alias(c) for c in frame.columns]).first()
    return [(c, row[c][len('{"x":'):-1]) for c in frame.columns]


def write_manifest_file(manifest: DataFrame, results: DataFrame, path: str) -> None:
    """The manifest as one JSON file (K6): the header's members, then
    ``results``, one entry per document in report order."""
    rows = manifest_rows(results.withColumn("_path", F.col("source_file")), "_path")
    members = _header(manifest.select("started_at", "completed_at", "config", "counts", "token_usage", "report_path"))
    write_json_document(results.sparkSession, path, [*members, ("results", _entries(rows))])


def _csv_lines(report: DataFrame) -> Section:
    """The report as CSV text (K5), header first, as pieces of a JSON string."""
    spark = report.sparkSession
    options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "lineSep", "encoding")}
    line = F.concat(escaped(F.to_csv(F.struct(*REPORT_COLUMNS), options)), F.lit("\\n"))
    head = spark.range(1).select(F.lit("").alias("_path"), F.lit(0).alias("_k"), F.lit(",".join(REPORT_COLUMNS) + "\\n").alias("line"))
    rows = report.select("_path", F.lit(1).alias("_k"), line.alias("line")).repartition("_path")
    return Section(head.unionByName(rows).orderBy("_k", "_path"), text=True)


def write_payload(results: DataFrame, path: str, usage: DataFrame | None = None, with_csv: bool = True) -> None:
    """The whole run as one JSON file (K7): ``counts``, ``token_usage`` (null
    without calls), ``report_rows`` with base names, the report as
    ``report_csv``, and ``documents`` with their cases as objects and their
    bodies, both lists in report order."""
    spark = results.sparkSession
    keyed = results.withColumn("_path", F.col("source_file"))
    report = report_rows(keyed, "_path")
    head = _header(outcome_counts(results).select(F.struct("discovered", "successful", "failed", "skipped").alias("counts")))
    calls = _header(token_usage(spark, usage))
    members = [*head, *calls, ("report_rows", _entries(with_base_names(report)))]
    if with_csv:
        members.append(("report_csv", _csv_lines(report)))
    write_json_document(spark, path, [*members, ("documents", _entries(payload_rows(keyed, "_path")))])
