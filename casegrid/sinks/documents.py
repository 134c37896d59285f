"""Per-document files, published as sets (K1-K4), with a row-level error
channel (F9).

A successful row has three files: ``structured_data/<id>.json``,
``customer_emails/<id>.md`` and ``case_summaries/<id>.md``.  They appear
together, and a set that cannot be published leaves the prior one as it was.
``publish_documents`` works in two jobs:

1. **Stage.**  The data source ``casegrid_documents`` writes every row's files
   under a name of its task attempt, below ``<out>/.publish-<run>/``.  A row
   that cannot be written is recorded with its error and does not stop the
   job.  A task's commit message names its record file; the commit lists these
   files, so what lost or repeated attempts left is never looked at.  If the
   job fails, ``abort`` deletes all of it and nothing was published.
2. **Publish.**  A Spark job over the recorded rows moves each set into place,
   the prior files to backups first.  If a move fails, the prior files come
   back, the new ones go, and the row gets the error.  All names are fixed by
   the records, so a task that is run again finds out how far the first one
   came and goes on.

``with_publish_errors`` joins the errors to the results: such a row has failed
with ``DOCUMENT_PROCESS_ERROR`` before the report and the manifest are made.

On a store without renames a move is a copy and a deletion, so a reader may
see a set half replaced for a moment; after a failure it is whole all the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from casegrid.schema import DOCUMENT_PROCESS_ERROR, FAILED
from casegrid.session import stage_table
from casegrid.sources import storage

# Folders and suffixes of a document's files, in the order they are published.
ARTIFACTS = (("structured_data", ".json"), ("customer_emails", ".md"), ("case_summaries", ".md"))
#: Error of a row whose document id another row of the run has taken.
TAKEN = "FileExistsError"
_RECORD = pa.schema([("row", pa.int64()), ("document_id", pa.string()), ("staged", pa.string()), ("error", pa.string())])
_ROW_SCHEMA = "row long, document_id string, structured_data string, customer_email string, case_summary string"
_FAULTS = (OSError, ValueError, pa.ArrowException)  # of a file system, or of a name that it refuses


def artifact_path(out: str, kind: int, document_id: str) -> str:
    folder, ext = ARTIFACTS[kind]
    return f"{out.rstrip('/')}/{folder}/{document_id}{ext}"


def case_file(structured_data: str) -> bytes:
    """The case record as a file: indented, in ASCII, with a closing line break."""
    return (json.dumps(json.loads(structured_data), indent=2, ensure_ascii=True) + "\n").encode()


def bodies(structured_data: str, email: str, summary: str) -> list[bytes]:
    return [case_file(structured_data), email.encode(), summary.encode()]


def _staged_names(staged: str) -> list[str]:
    return [f"{staged}{ext}.{i}" for i, (_, ext) in enumerate(ARTIFACTS)]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its record file."""

    records: str


class DocumentSetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        base = f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        storage.make_folder(base)
        records = f"{base}/records.parquet"
        system, path = storage.resolve(records)
        with system.open_output_stream(path) as stream, pq.ParquetWriter(stream, _RECORD) as out:
            n = 0
            for batch in iterator:
                rows = []
                for r in batch.to_pylist():
                    staged, error = f"{base}/{n}", None
                    n += 1
                    try:
                        for name, body in zip(_staged_names(staged), bodies(r["structured_data"], r["customer_email"], r["case_summary"]), strict=True):
                            storage.write_bytes(name, body)
                    except _FAULTS as exc:
                        error = type(exc).__name__
                    rows.append({"row": r["row"], "document_id": r["document_id"], "staged": staged, "error": error})
                out.write_batch(pa.RecordBatch.from_pylist(rows, _RECORD))
        return Written(records)

    def commit(self, messages: list) -> None:
        """One line for each task; the files are published by the next job."""
        listed = [m.records for m in messages if m is not None]
        storage.write_bytes(f"{self.folder}/committed", "\n".join(listed).encode())

    def abort(self, messages: list) -> None:
        storage.remove_folder(self.folder)


class DocumentSets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "casegrid_documents"

    def schema(self) -> str:
        return _ROW_SCHEMA

    def writer(self, schema, overwrite: bool) -> DocumentSetWriter:
        return DocumentSetWriter(self.options)


def publish_set(out: str, run: str, document_id: str, staged: str) -> str | None:
    """Move a staged set into place; the error's name if the prior set was
    restored instead.  Repeatable: what an earlier attempt has done is found
    by the names that are left."""
    names = _staged_names(staged)
    finals = [artifact_path(out, i, document_id) for i in range(len(names))]
    backups = [f"{f.rsplit('/', 1)[0]}/.{f.rsplit('/', 1)[1]}.{run}.bak" for f in finals]
    verdict = f"{staged}.failed"
    if storage.exists(verdict):
        return storage.read_bytes(verdict).decode()
    try:
        for name, final, backup in zip(names, finals, backups, strict=True):
            if not storage.exists(name):
                continue  # moved by an earlier attempt
            if storage.is_folder(final):
                raise IsADirectoryError(final)
            if storage.exists(final):
                storage.move(final, backup)
            storage.move(name, final)
    except _FAULTS as exc:
        for name, final, backup in zip(names, finals, backups, strict=True):
            if storage.exists(backup):
                storage.move(backup, final)
            elif not storage.exists(name) and not storage.is_folder(final):
                storage.remove(final)  # new, and no prior one
        storage.write_bytes(verdict, type(exc).__name__.encode())
        for name in names:
            storage.remove(name)
        return type(exc).__name__
    for backup in backups:
        storage.remove(backup)
    return None


def publish_documents(results: DataFrame, out_dir: str, run_id: str | None = None) -> DataFrame:
    """Publish the files of all successful rows of ``results`` to ``out_dir``
    (a path that all executors share, or a URI) and return (document_id,
    source_file, error), one row for each: ``error`` is null for published
    sets.  Of rows with one id the first by ``source_file`` is published, the
    others are refused."""
    spark = results.sparkSession
    spark.dataSource.register(DocumentSets)
    run = run_id or uuid.uuid4().hex
    out = storage.canonical(out_dir)
    rows = stage_table(results.where(F.col("structured_data").isNotNull())
                       .select("document_id", "source_file", "structured_data", "customer_email", "case_summary")
                       .withColumn("row", F.monotonically_increasing_id()), "artifacts")
    keys = rows.select("row", "document_id", "source_file")
    first = stage_table(keys.groupBy("document_id").agg(F.min(F.struct(F.coalesce("source_file", F.lit("")), "row")).alias("f"))
                        .select(F.col("f.row").alias("row")), "first")
    storage.make_folder(out)
    for folder, _ in ARTIFACTS:
        storage.make_folder(f"{out}/{folder}")
    folder = f"{out}/.publish-{run}"
    storage.make_folder(folder)
    (rows.join(first, "row", "left_semi").select(*[c.split()[0] for c in _ROW_SCHEMA.split(", ")])
     .write.format("casegrid_documents").option("path", folder).mode("append").save())
    listed = storage.read_bytes(f"{folder}/committed").decode().split("\n")  # one for each task
    records = spark.read.parquet(*listed)

    def run_publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = [r.error if isinstance(r.error, str) else publish_set(out, run, r.document_id, r.staged)
                      for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"row": pdf["row"], "error": errors})

    done = stage_table(records.mapInPandas(run_publish, "row long, error string"), "published")
    storage.remove_folder(folder)
    return stage_table(keys.join(done.withColumn("here", F.lit(True)), "row", "left")
                       .select("document_id", "source_file", F.when(F.col("here"), F.col("error")).otherwise(F.lit(TAKEN)).alias("error")),
                       "outcomes")


def with_publish_errors(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``results`` after publishing: a row whose set was not published has
    failed with ``DOCUMENT_PROCESS_ERROR`` and the error's name, and carries no
    case or bodies."""
    bad = outcomes.where(F.col("error").isNotNull()).select(
        F.col("document_id").alias("_id"), F.col("source_file").alias("_file"), F.col("error").alias("_error")).distinct()
    joined = results.join(bad, (F.col("document_id") == F.col("_id")) & F.col("source_file").eqNullSafe(F.col("_file"))
                          & F.col("structured_data").isNotNull(), "left")
    failed = F.col("_error").isNotNull()
    new = {"status": F.lit(FAILED), "error_code": F.lit(DOCUMENT_PROCESS_ERROR), "error_message": F.col("_error")}
    gone = ("case", "customer_email", "case_summary", "structured_data")
    return joined.select(*[
        F.when(failed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.when(~failed, F.col(c)).alias(c) if c in gone else F.col(c)
        for c in results.columns])
