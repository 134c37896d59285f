"""Incremental triage over a growing document table (optional, §7.4).

``spark.readStream`` over a parquet directory of candidate rows (the
same columns the batch plan takes), the same column functions per
micro-batch, and ``foreachBatch`` doing the resume check (J1) against the
results table plus the publish (K4).  Each micro-batch writes its own
``run_id=epoch-<n>`` partition with dynamic overwrite, so a replayed epoch
(after a failure, from the checkpoint) replaces its own output by the same
rows: what the epoch itself published before does not count as published.  No watermark or state is needed: a document's outcome
depends on that document only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from casegrid.plans.triage import triage_rules
from casegrid.sinks.publish import published_ids, write_results

CANDIDATE_SCHEMA = ("document_id string, source_file string, suffix string, text string, "
                    "read_error string")


def start_incremental(spark: SparkSession, source_dir: str, results_path: str, checkpoint: str, *,
                      overwrite: bool = False, available_now: bool = True,
                      max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(CANDIDATE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(source_dir)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        run_id = f"epoch-{epoch_id}"
        published = published_ids(batch.sparkSession, results_path, run_id)
        results = triage_rules(batch, published=published, overwrite=overwrite)
        write_results(results, results_path, run_id=run_id)

    w = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
