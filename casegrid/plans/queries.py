"""Registered queries over the driver's tables, with DuckDB oracles.

Each query reads whole tables (``documents``, ``labels``, ``events``,
``conversations``) or frames Spark derives from them, and returns a flat
DataFrame whose column names match its oracle SQL.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions.extract import (
    EMAIL_RE,
    NAME_RE,
    PHONE_RE,
    email_is_valid,
    first_match,
    found_email,
    rule_case,
)
from casegrid.functions.ids import id_stem, stem
from casegrid.functions.patterns import ATTACHMENT_TOKENS, COMPLAINT_CUES, ESCALATION_TOKENS
from casegrid.functions.scope import has_complaint_cue, out_of_scope
from casegrid.functions.text import normalize, strip
from casegrid.functions.validate import email_draft_ok, summary_draft_ok
from casegrid.operators import aggregate as A
from casegrid.operators import report as R
from casegrid.plans import duck
from casegrid.plans.corpus import complaint_corpus, load_table
from casegrid.plans.partitioning import spread
from casegrid.plans.triage import fence, triage_rules
from casegrid.schema import (
    ERROR_CODES,
    NOT_A_COMPLAINT_MESSAGE,
    SUMMARY_DRAFT_BAD_MESSAGE,
    error_code_table,
)
from casegrid.session import stage_path, stage_table, staging_root

# Fixed run times so report cells are reproducible.
RUN_STARTED = datetime(2026, 1, 1, 0, 0, 0, tzinfo=timezone.utc)
RUN_COMPLETED = datetime(2026, 1, 1, 0, 0, 1, 500000, tzinfo=timezone.utc)
RUN_COMPLETED_ISO = "2026-01-01T00:00:01.500000+00:00"

CASE_COLS = (
    "customer_name", "email", "phone_number", "complaint_category", "issue_description",
    "resolution_provided", "is_complaint", "escalation_required",
    "supporting_document_available", "overall_case_status",
)


def _results(spark: SparkSession, sf_dir: str, published: DataFrame | None = None) -> DataFrame:
    return triage_rules(
        complaint_corpus(spark, sf_dir), published=published,
        started_at=RUN_STARTED, completed_at=RUN_COMPLETED,
    )


def _flat(results: DataFrame) -> DataFrame:
    return results.select(
        "document_id", "source_file", "status", "error_code", "error_message",
        *[F.col("case")[c].alias(c) for c in CASE_COLS], "customer_email", "case_summary",
    )


# --- Spark queries ----------------------------------------------------------

def q_normalize_text(spark, sf_dir):
    c = complaint_corpus(spark, sf_dir)
    n = c.select("doc_id", normalize(F.col("text")).alias("norm_text"))
    return n.select("doc_id", "norm_text", F.length("norm_text").cast("bigint").alias("norm_chars"))


def q_document_ids(spark, sf_dir):
    c = complaint_corpus(spark, sf_dir)
    return c.select("doc_id", "rel_path", "name", "suffix", stem(F.col("name")).alias("stem"),
                    id_stem(F.col("name")).alias("id_stem"), "document_id")


def nested_paths(spark, sf_dir):
    """Paths derived from ``documents``: two to five parts, with parts that sort
    otherwise as parts than as text (``a-b/`` and ``a/``, blanks, case, accents)."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    k = F.pmod(F.col("doc_id"), F.lit(7))
    top = F.when(k == 0, F.concat("source", F.lit("-old"))).when(k == 1, F.concat("source", F.lit(" b"))).when(k == 2, F.upper("source")).otherwise(F.col("source"))
    middle = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "lang", F.lit("é.d"), F.lit("x!")))
    return d.select("doc_id", F.concat_ws("/", top, middle, F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel_path"))


def q_listing_order(spark, sf_dir):
    """O1: each path's place in listing order."""
    from casegrid.sources.listing import with_positions

    return with_positions(nested_paths(spark, sf_dir)).select("doc_id", "rel_path", "position")


def q_scope_gate(spark, sf_dir):
    c = complaint_corpus(spark, sf_dir).select("doc_id", F.lower(normalize(F.col("text"))).alias("low"))
    return c.select("doc_id", has_complaint_cue(F.col("low")).alias("has_cue"),
                    out_of_scope(F.col("low")).alias("out_of_scope"))


def q_rule_extract(spark, sf_dir):
    c = fence(complaint_corpus(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text")))
    c = c.where(F.col("text") != "").withColumn("low", F.lower("text"))
    c = c.select("doc_id", rule_case(F.col("text"), F.col("low")).alias("case"),
                 found_email(F.col("text")).alias("found_email"))
    return c.select("doc_id", *[F.col("case")[k].alias(k) for k in CASE_COLS],
                    F.coalesce(email_is_valid(F.col("found_email")), F.lit(True)).alias("email_ok"))


def q_contact_find(spark, sf_dir):
    d = spread(load_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    d = d.select("doc_id", found_email(F.col("text")).alias("email"),
                 first_match(F.col("text"), PHONE_RE).alias("phone"),
                 F.nullif(strip(first_match(F.col("text"), NAME_RE, 1)), F.lit("")).alias("name"))
    return d.withColumn("email_valid", email_is_valid(F.col("email")))


def q_outcomes(spark, sf_dir):
    return _results(spark, sf_dir).select("document_id", "source_file", "status", "error_code", "error_message")


def q_outcome_counts(spark, sf_dir):
    return A.outcome_counts(_results(spark, sf_dir))


def q_status_counts(spark, sf_dir):
    return A.status_counts(_results(spark, sf_dir))


def q_category_counts(spark, sf_dir):
    r = _results(spark, sf_dir).where(F.col("status") == "success")
    return r.groupBy(F.col("case.complaint_category").alias("complaint_category")).agg(
        F.count(F.lit(1)).alias("n"))


def q_triage_summary(spark, sf_dir):
    """Flagship: outcome counts per status, code and category."""
    r = _results(spark, sf_dir)
    return r.groupBy(
        "status", F.coalesce("error_code", F.lit("")).alias("error_code"),
        F.coalesce(F.col("case.complaint_category"), F.lit("")).alias("complaint_category"),
    ).agg(F.count(F.lit(1)).alias("n"))


def q_report_rows(spark, sf_dir):
    return R.ordered_report(R.report_rows(_results(spark, sf_dir)))


def q_report_basenames(spark, sf_dir):
    return R.with_base_names(R.report_rows(_results(spark, sf_dir)))


def q_email_drafts(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("document_id", "customer_email", email_draft_ok(F.col("customer_email")).alias("email_ok"))


def q_summary_drafts(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("document_id", "case_summary", summary_draft_ok(F.col("case_summary")).alias("summary_ok"))


def q_structured_json(spark, sf_dir):
    r = _results(spark, sf_dir).where(F.col("structured_data").isNotNull())
    j = F.col("structured_data")
    cols = [F.get_json_object(j, "$.document_id").alias("j_document_id"),
            F.get_json_object(j, "$.source_file").alias("j_source_file")]
    cols += [F.get_json_object(j, f"$.case.{k}").alias(f"j_{k}") for k in CASE_COLS]
    has_all_keys = F.size(F.json_object_keys(F.get_json_object(j, "$.case"))) == len(CASE_COLS)
    return r.select("document_id", *cols, has_all_keys.alias("all_keys"),
                    (~j.rlike("[^\\x00-\\x7F]")).alias("ascii_only"))


def q_resume_skip(spark, sf_dir):
    """Documents with a ``labels`` row count as already published."""
    corpus = complaint_corpus(spark, sf_dir)
    labels = load_table(spark, sf_dir, "labels").select("doc_id")
    ids = complaint_corpus(spark, sf_dir, with_text=False)
    published = ids.join(labels, "doc_id", "left_semi").select("document_id")
    return triage_rules(corpus, published=published, started_at=RUN_STARTED,
                        completed_at=RUN_COMPLETED).select("document_id", "status", "error_code")


def q_manifest_rows(spark, sf_dir):
    return R.manifest_rows(_results(spark, sf_dir))


def q_run_payload(spark, sf_dir):
    p = R.payload_rows(_results(spark, sf_dir))
    return p.select("source_file", "document_id", "status", "error_code", "error_message",
                    "customer_email", "case_summary",
                    (F.col("structured_data") != "{}").alias("has_structured"))


def _event_calls(spark, sf_dir):
    """Model-call usage records derived from ``events``: one call per event,
    prompt tokens from ``props.k``, completion tokens from ``value``, and
    ``click`` events reporting no total (so total = prompt + completion)."""
    e = load_table(spark, sf_dir, "events")
    p = F.get_json_object("props", "$.k")
    c = F.floor("value").cast("bigint")
    return e.select(
        F.col("event_type").alias("run_id"),
        p.alias("prompt_tokens"),
        c.alias("completion_tokens"),
        F.when(F.col("event_type") == "click", F.lit(0))
        .otherwise(F.coalesce(p.try_cast("bigint"), F.lit(0)) + c).alias("total_tokens"),
    )


def q_usage_totals(spark, sf_dir):
    return A.usage_totals(_event_calls(spark, sf_dir), "run_id")


def _model_run(spark, sf_dir):
    """The model path with the scripted provider over the corpus; ids repeat
    (97 of them), as short hashes of paths do at scale."""
    from casegrid.plans.model import triage_with_model
    from casegrid.plans.scripted import scripted_factory

    shared = F.concat(F.lit("case_"), F.pmod("doc_id", F.lit(97)).cast("string"))
    return triage_with_model(spark, complaint_corpus(spark, sf_dir).withColumn("document_id", shared), scripted_factory,
                             started_at=RUN_STARTED, completed_at=RUN_COMPLETED, concurrency=8)


def _settled(df: DataFrame, run) -> DataFrame:
    """Write a small result of a model run and clear the run's own stage."""
    path = f"{staging_root(df.sparkSession)}/casegrid/result-{run.run_id}"
    df.write.parquet(path)
    run.cleanup()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def q_infer_repair(spark, sf_dir):
    """U1-U6 end to end with the scripted provider (inference is staged)."""
    run = _model_run(spark, sf_dir)
    return _settled(run.results.select("document_id", "source_file", "status", "error_code", "error_message",
                                       *[F.col("case")[c].alias(c) for c in CASE_COLS]), run)


def q_model_usage(spark, sf_dir):
    """U7 on the model path: calls that reported usage, by task and attempt."""
    run = _model_run(spark, sf_dir)
    return _settled(run.usage.groupBy("task", "attempt").agg(F.count(F.lit(1)).alias("calls")), run)


def q_prompts(spark, sf_dir):
    """The three prompts of every successful row.  A draft prompt is its
    rules and the case record; ``text_in_drafts`` and ``mark_in_drafts`` look
    for the document's text and marks outside the record, ``email_fields`` and
    ``summary_fields`` are what the record holds."""
    from casegrid.functions import drafts as D
    from casegrid.plans.triage import JSON_OPTIONS

    r = _results(spark, sf_dir).where("status = 'success'").select("document_id", "source_file", "case")
    texts = complaint_corpus(spark, sf_dir).select("source_file", normalize(F.col("text")).alias("text"))
    record = F.to_json("case", JSON_OPTIONS)
    p = r.join(texts, "source_file").select(
        "document_id", "text", D.extraction_prompt(F.col("text"), F.lit(False)).alias("extract_prompt"),
        D.case_prompt(record, D.EMAIL_INSTRUCTION).alias("email"), D.case_prompt(record, D.SUMMARY_INSTRUCTION).alias("summary"))

    def rules(c):
        return F.substring_index(c, "\n" + D.CASE_OPEN + "\n", 1)

    def body(c):
        """From the first opening mark to the last closing one."""
        rest = F.substr(c, F.length(rules(c)) + F.lit(len(D.CASE_OPEN) + 3))
        return F.left(rest, F.length(rest) - F.length(after(c)) - F.lit(len(D.CASE_CLOSE) + 1))

    def after(c):
        return F.substring_index(c, "\n" + D.CASE_CLOSE, -1)

    def outside(c):
        return F.concat(rules(c), F.lit("\n"), after(c))

    both = [F.col("email"), F.col("summary")]
    return p.select(
        "document_id", F.lit(D.PROMPT_VERSION).alias("prompt_version"), "extract_prompt",
        rules(F.col("email")).alias("email_rules"), rules(F.col("summary")).alias("summary_rules"),
        *[F.array_join(F.json_object_keys(body(c)), ",").alias(f"{n}_fields") for n, c in zip(("email", "summary"), both, strict=True)],
        *[F.get_json_object(body(c), "$.issue_description").alias(f"{n}_issue") for n, c in zip(("email", "summary"), both, strict=True)],
        *[(after(c) == "").alias(f"{n}_ends") for n, c in zip(("email", "summary"), both, strict=True)],
        (outside(both[0]).contains(F.col("text")) | outside(both[1]).contains(F.col("text"))).alias("text_in_drafts"),
        (outside(both[0]).contains(D.DOC_OPEN) | outside(both[1]).contains(D.DOC_OPEN)).alias("mark_in_drafts"))


def q_error_codes(spark, sf_dir):
    """the taxonomy beside the corpus's outcomes; codes that did not
    occur count 0."""
    n = _results(spark, sf_dir).where("error_code IS NOT NULL").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))
    return error_code_table(spark).join(n, "error_code", "left").select(
        "error_code", "status", "stage", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def q_run_timing(spark, sf_dir):
    """A4: start, end and durations of the rule-based run."""
    t = A.run_timing(_results(spark, sf_dir))
    return t.select(R.iso_utc(F.col("started_at")).alias("started_at"), R.iso_utc(F.col("completed_at")).alias("completed_at"),
                    "max_duration_ms", "total_duration_ms")


def q_run_summary(spark, sf_dir):
    """K7 for a run: counts and the payload's per-status sums in one row."""
    r = _results(spark, sf_dir)
    return r.agg(
        *A.outcome_count_columns(),
        F.count("structured_data").alias("documents_with_case"),
        F.coalesce(F.sum(F.length("customer_email")), F.lit(0).cast("bigint")).alias("email_chars"),
        F.coalesce(F.sum(F.length("case_summary")), F.lit(0).cast("bigint")).alias("summary_chars"))


def uploads_from_conversations(spark, sf_dir):
    """Upload batches derived from ``conversations``: one batch per
    conversation, one file per turn, named after the speaker's role with
    varying case, type and a ``_1`` variant (so names collide within a
    batch, including generated names against uploaded ones)."""
    c = load_table(spark, sf_dir, "conversations")
    name = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.col("role"), F.lit(".txt")))
        .when(F.col("turn") % 4 == 1, F.concat(F.upper("role"), F.lit(".TXT")))
        .when(F.col("turn") % 4 == 2, F.concat(F.col("role"), F.lit("_1.txt")))
        .otherwise(F.concat(F.col("role"), F.lit(".docx")))
    )
    from casegrid.plans.corpus import docx_from_lines

    content = F.when(F.col("turn") % 4 == 3, docx_from_lines("text", "turn")).otherwise(F.encode("text", "UTF-8"))
    return c.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"),
                    name.alias("filename"), content.alias("content"))


def odd_uploads(spark, sf_dir):
    """Uploads from ``conversations`` with bad, null and empty names, and some
    without a batch; every third batch has good names only."""
    c = load_table(spark, sf_dir, "conversations")
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(9))
    good = F.concat(F.col("role"), F.lit(".txt"))
    name = (
        F.when(F.col("conv_id") % 3 == 0, good)
        .when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("")).when(k == 2, F.lit(".."))
        .when(k == 3, F.concat(F.col("role"), F.lit(".exe"))).when(k == 4, F.concat(F.lit("in/"), good)).otherwise(good)
    )
    batch = F.when(~((F.col("conv_id") % 3 == 1) & (k == 5)), F.col("conv_id"))
    return c.select(batch.alias("batch_id"), "conv_id", F.col("turn").alias("pos"), name.alias("filename"))


def q_upload_rejects(spark, sf_dir):
    """Every upload is either stored under a name or refused with a
    reason, and none is lost."""
    from casegrid.operators.names import accepted, quarantine, stored_names

    u = odd_uploads(spark, sf_dir)
    stored = stored_names(accepted(u)).select("batch_id", "conv_id", "pos", "filename", "stored_name",
                                              F.lit(None).cast("string").alias("reason"))
    refused = quarantine(u).select("batch_id", "conv_id", "pos", "filename", F.lit(None).cast("string").alias("stored_name"), "reason")
    return stored.unionByName(refused)


def q_docx_text(spark, sf_dir):
    """Packages built from ``documents`` in the tasks (a line is a
    paragraph), decoded and normalised; every fifth has another main part,
    every seventh is broken."""
    from casegrid.plans.corpus import docx_from_lines
    from casegrid.sources.decode import decode_documents

    d = spread(load_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = d.select("doc_id", F.lit(".DOCX").alias("suffix"), docx_from_lines("text", "doc_id").alias("content"),
                    F.lit(None).cast("string").alias("read_error"))
    return decode_documents(rows).select("doc_id", normalize(F.col("text")).alias("norm_text"), "read_error")


def q_upload_names(spark, sf_dir):
    from casegrid.operators.names import stored_names

    u = uploads_from_conversations(spark, sf_dir).drop("content")
    return stored_names(u).select("batch_id", "pos", "filename", "stored_name")


def q_upload_triage(spark, sf_dir):
    """Uploaded batches (from ``conversations``) through the pipeline."""
    from casegrid.operators.names import upload_candidates

    res = triage_rules(upload_candidates(uploads_from_conversations(spark, sf_dir)),
                       started_at=RUN_STARTED, completed_at=RUN_COMPLETED)
    return res.select("document_id", "source_file", "status", "error_code")


def q_ingest_summary(spark, sf_dir):
    """S7 over the corpus: ingest outcome and normalised length per file."""
    from casegrid.sources.files import ingest_rows

    return ingest_rows(complaint_corpus(spark, sf_dir)).select("source_file", "status", "error_code",
                                                               "char_count")


RUN_CONFIG = {"llm_provider": "rules", "model_name": None, "max_llm_attempts": 2,
              "max_document_workers": 4, "input_dir": "inbox", "output_dir": "out", "overwrite": False}


def q_manifest_header(spark, sf_dir):
    """K6: the one-row run manifest of the rule-based run over the corpus
    (rule runs make no model calls, so token usage is null)."""
    from casegrid.sinks.publish import manifest_frame

    m = manifest_frame(spark, _results(spark, sf_dir), None, started_at=RUN_STARTED,
                       completed_at=RUN_COMPLETED, config=RUN_CONFIG, report_path="out/final_report.csv")
    return m.select(
        "started_at", "completed_at", "report_path",
        F.col("config.llm_provider").alias("llm_provider"),
        F.col("config.max_llm_attempts").cast("bigint").alias("max_llm_attempts"),
        F.col("config.overwrite").alias("overwrite"),
        "counts.discovered", "counts.successful", "counts.failed", "counts.skipped",
        F.col("token_usage.calls").alias("token_calls"),
    )


def q_publish_outcomes(spark, sf_dir):
    """The run's files are published as sets; ids ending in 7 have a
    folder where their third file belongs, so these rows fail and keep no new
    file.  ``files`` counts what a listing of the output then finds."""
    from casegrid.sinks.documents import artifact_path, publish_documents, with_publish_errors
    from casegrid.sources import storage
    from casegrid.sources.listing import list_documents

    out = stage_path(spark, "export")
    # Published and then joined with the outcomes: the triage runs once.
    results = stage_table(_results(spark, sf_dir).drop("case"), "results")
    target = storage.canonical(out)

    def block(batches):
        for pdf in batches:
            for i in pdf["document_id"]:
                storage.make_folder(artifact_path(target, 2, i))
            yield pdf

    # One result for each document, so the ids need no text.
    ids = complaint_corpus(spark, sf_dir, with_text=False).select("document_id")
    ids.where(F.col("document_id").endswith("7")).mapInPandas(block, "document_id string").count()
    done = with_publish_errors(results, publish_documents(results, out))
    files = (list_documents(spark, out).groupBy(stem(F.col("name")).alias("document_id"))
             .agg(F.count("*").alias("files"), F.sum("length").alias("bytes")))
    return done.join(files, "document_id", "left").select(
        "document_id", "source_file", "status", "error_code", "error_message", F.coalesce("files", F.lit(0).cast("bigint")).alias("files"),
        (F.col("bytes") > F.length("customer_email") + F.length("case_summary")).alias("holds_bodies"))


def q_error_codes_published(spark, sf_dir):
    """rows per code after publishing, all thirteen codes."""
    n = q_publish_outcomes(spark, sf_dir).where("error_code IS NOT NULL").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))
    return error_code_table(spark).join(n, "error_code", "left").select("error_code", "status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _digest(*cols):
    """An order-free digest over rows: the sum of 48 bits of each row's hash."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.sum(F.conv(F.left(F.sha2(text, 256), F.lit(12)), 16, 10).cast("decimal(38,0)")).cast("string")


def q_manifest_document(spark, sf_dir):
    """K6: the manifest as one JSON file, written and read back: its entries
    as parsed from the file, and what its header says beside them."""
    from casegrid.sinks.publish import manifest_frame, write_manifest_file

    results, path = _results(spark, sf_dir), f"{stage_path(spark, 'manifest')}/manifest.json"
    head = manifest_frame(spark, results, None, started_at=RUN_STARTED, completed_at=RUN_COMPLETED, config=RUN_CONFIG,
                          report_path="out/final_report.csv")
    write_manifest_file(head, results, path)
    line = F.rtrim(F.col("value"), F.lit(","))
    lines = spark.read.text(path).select(line.alias("line"))
    entries = (lines.where(F.col("line").startswith('{"document_id"'))
               .select(F.from_json("line", "document_id string, source_file string, status string, error_code string").alias("e")).select("e.*"))
    counts = lines.where(F.col("line").startswith('"counts"')).select(
        F.from_json(F.substring_index("line", ": ", -1), "discovered bigint, successful bigint").alias("c"), F.lit(1).alias("_one"))
    return (entries.withColumn("_one", F.lit(1)).join(F.broadcast(counts), "_one")
            .select("document_id", "source_file", "status", "error_code", F.col("c.discovered").alias("discovered"),
                    F.col("c.successful").alias("successful")))


def q_payload_document(spark, sf_dir):
    """K7: the run's payload as one JSON file, written and read back: rows,
    sizes and digests of its sections."""
    from casegrid.sinks.publish import write_payload

    results, path = _results(spark, sf_dir), f"{stage_path(spark, 'payload')}/payload.json"
    write_payload(results, path, with_csv=False)
    case = ", ".join(f"{c} {'boolean' if c in CASE_COLS[6:9] else 'string'}" for c in CASE_COLS)
    entry = ("document_id string, source_file string, status string, error_code string, error_message string, customer_email string, "
             f"case_summary string, structured_data string, processed_at string, complaint_category string, case struct<{case.replace(' ', ': ').replace(',:', ',')}>")
    e = spark.read.text(path).select(F.from_json(F.rtrim(F.col("value"), F.lit(",")), entry).alias("e")).select("e.*")
    e = e.where("document_id IS NOT NULL")
    docs = e.where("processed_at IS NULL").agg(
        F.lit("documents").alias("section"), F.count("*").alias("entries"), F.count("case").alias("cases"),
        F.coalesce(F.sum(F.length("customer_email") + F.length("case_summary")), F.lit(0)).alias("chars"),
        _digest(*[F.col(c) for c in ("document_id", "source_file", "status", "error_code", "error_message", "customer_email", "case_summary",
                                     "case.customer_name", "case.email", "case.issue_description", "case.is_complaint")],
                F.col("structured_data") != "{}").alias("digest"))
    rows = e.where("processed_at IS NOT NULL").agg(
        F.lit("report_rows").alias("section"), F.count("*").alias("entries"), F.count_if(F.col("complaint_category") != "").alias("cases"),
        F.coalesce(F.sum(F.length("processed_at")), F.lit(0)).alias("chars"),
        _digest(*[F.col(c) for c in ("document_id", "source_file", "status", "error_code", "complaint_category", "processed_at")]).alias("digest"))
    return docs.unionByName(rows)


def model_outputs_from_documents(spark, sf_dir):
    """Model replies derived from ``documents``: one JSON reply per row, in
    one of twelve shapes chosen by ``doc_id % 12`` (valid, explicit nulls,
    bad enum, bad e-mail, missing or numeric issue, not JSON, null enum,
    extra key with lax booleans, trailing text, an array, a bad boolean).
    The issue text is the whole document text."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    t, k = F.col("text"), F.pmod(F.col("doc_id"), F.lit(20))
    yes, no = F.lit(True), F.lit(False)
    opts = {"ignoreNullFields": "false"}

    def js(*cols):
        return F.to_json(F.struct(*cols), opts)

    base = [t.alias("issue_description"), yes.alias("is_complaint"), no.alias("escalation_required"),
            yes.alias("supporting_document_available")]
    null_s = F.lit(None).cast("string")
    content = (
        F.when(k == 0, js(*base, F.lit("billing").alias("complaint_category"),
                          F.lit("Ann@Example.COM").alias("email")))
        .when(k == 1, js(*base, null_s.alias("customer_name"), null_s.alias("email"),
                         null_s.alias("phone_number"), F.lit("open").alias("overall_case_status")))
        .when(k == 2, js(*base, F.lit("furniture").alias("complaint_category")))
        .when(k == 3, js(*base, F.lit("not-an-email").alias("email")))
        .when(k == 4, js(*base[1:]))
        .when(k == 5, js(F.lit(5).alias("issue_description"), *base[1:]))
        .when(k == 6, F.concat(F.lit("not json "), F.col("source")))
        .when(k == 7, js(*base, null_s.alias("complaint_category")))
        .when(k == 8, js(t.alias("issue_description"), F.lit("yes").alias("is_complaint"),
                         F.lit(0).alias("escalation_required"), F.lit("OFF").alias("supporting_document_available"),
                         F.lit(1).alias("extra_field")))
        .when(k == 9, F.concat(js(*base), F.lit(" trailing")))
        .when(k == 10, F.lit("[1, 2]"))
        .when(k == 11, js(t.alias("issue_description"), F.lit(2).alias("is_complaint"), no.alias("escalation_required"),
                          no.alias("supporting_document_available")))
        .when(k == 12, F.concat(F.lit('{"issue_description": 7, "is_complaint": "perhaps", '), F.substr(js(*base), F.lit(2))))
        .when(k == 13, F.concat(F.lit('{"confidence": NaN, "range": [-Infinity, Infinity], '), F.substr(js(*base), F.lit(2))))
        .when(k == 14, F.concat(F.substr(js(*base[:3]), F.lit(1), F.length(js(*base[:3])) - 1), F.lit(', "supporting_document_available": NaN}')))
        .when(k == 15, F.lit(" \n\t"))
        .when(k == 16, F.lit(None).cast("string"))
        .when(k == 17, js(*base, F.lit("Ann O'Lee <Ann@Example.COM>").alias("email")))
        .when(k == 18, js(*base, F.lit(' "Lee, Ann" <Ann@Example.COM> ').alias("email")))
        .otherwise(js(*base, F.lit("Ann Lee Ann@Example.COM").alias("email")))
    )
    return d.select("doc_id", content.alias("content"))


def q_case_validate(spark, sf_dir):
    """Validate model replies against the case schema."""
    from casegrid.functions.validate import validate_case_json

    v = validate_case_json(model_outputs_from_documents(spark, sf_dir), "content", "v")
    return v.select("doc_id", F.col("v.error_code").alias("error_code"),
                    *[F.col("v.case")[c].alias(c) for c in CASE_COLS])


QUERIES = {
    "triage_summary": q_triage_summary,
    "normalize_text": q_normalize_text,
    "document_ids": q_document_ids,
    "listing_order": q_listing_order,
    "scope_gate": q_scope_gate,
    "rule_extract": q_rule_extract,
    "contact_find": q_contact_find,
    "outcomes": q_outcomes,
    "outcome_counts": q_outcome_counts,
    "status_counts": q_status_counts,
    "category_counts": q_category_counts,
    "report_rows": q_report_rows,
    "report_basenames": q_report_basenames,
    "email_drafts": q_email_drafts,
    "summary_drafts": q_summary_drafts,
    "structured_json": q_structured_json,
    "resume_skip": q_resume_skip,
    "manifest_rows": q_manifest_rows,
    "run_payload": q_run_payload,
    "usage_totals": q_usage_totals,
    "infer_repair": q_infer_repair,
    "model_usage": q_model_usage,
    "prompts": q_prompts,
    "error_codes": q_error_codes,
    "run_timing": q_run_timing,
    "run_summary": q_run_summary,
    "upload_rejects": q_upload_rejects,
    "docx_text": q_docx_text,
    "upload_names": q_upload_names,
    "upload_triage": q_upload_triage,
    "ingest_summary": q_ingest_summary,
    "manifest_header": q_manifest_header,
    "publish_outcomes": q_publish_outcomes,
    "error_codes_published": q_error_codes_published,
    "manifest_document": q_manifest_document,
    "payload_document": q_payload_document,
    "case_validate": q_case_validate,
}


# --- DuckDB oracles -----------------------------------------------------------

def _with(body: str, published_sql: str | None = None) -> str:
    return "WITH " + duck.pipeline_ctes(published_sql) + "\n" + body


def _bool_cell(b: str) -> str:
    return f"CASE WHEN {b} IS NULL THEN '' WHEN {b} THEN 'true' ELSE 'false' END"


_REPORT_SELECT = f"""SELECT document_id, source_file, status,
  coalesce(customer_name, '') AS customer_name,
  coalesce(complaint_category, '') AS complaint_category,
  {_bool_cell('is_complaint')} AS is_complaint,
  {_bool_cell('escalation_required')} AS escalation_required,
  coalesce(overall_case_status, '') AS overall_case_status,
  {_bool_cell('customer_email IS NOT NULL')} AS email_generated,
  {_bool_cell('case_summary IS NOT NULL')} AS summary_generated,
  coalesce(error_code, '') AS error_code,
  '{RUN_COMPLETED_ISO}' AS processed_at
FROM results"""


def _case_json_cols() -> str:
    out = []
    for k in CASE_COLS:
        if k in ("is_complaint", "escalation_required", "supporting_document_available"):
            out.append(f"lower(CAST({k} AS VARCHAR)) AS j_{k}")
        else:
            out.append(f"{k} AS j_{k}")
    return ", ".join(out)


def names_rule_sql(uploads: str) -> str:
    """The naming rule stated sequentially: a recursive CTE walks each batch of
    the query ``uploads`` (batch_id, pos, filename, ...) in upload order and
    carries the set of names taken so far; the result is ``named``."""
    candidates = """list_filter(list_prepend(n.filename, list_transform(range(1, len(s.used) + 2),
        lambda i: n.stm || '_' || CAST(i AS VARCHAR) || n.sfx)), lambda c: NOT list_contains(s.used, lower(c)))[1]"""
    return f"""
WITH RECURSIVE u AS ({uploads}),
n0 AS (SELECT *, {duck.suffix('filename')} AS sfx,
         row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS rn FROM u),
n AS (SELECT *, left(filename, length(filename) - length(sfx)) AS stm FROM n0),
steps AS (
  SELECT batch_id, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS stored
  FROM (SELECT DISTINCT batch_id FROM n)
  UNION ALL
  SELECT s.batch_id, s.rn + 1, list_append(s.used, lower({candidates})), {candidates}
  FROM steps s JOIN n ON n.batch_id = s.batch_id AND n.rn = s.rn + 1),
named AS (
  SELECT n.*, s.stored AS stored_name FROM steps s JOIN n ON s.batch_id = n.batch_id AND s.rn = n.rn)"""


_UPLOADS_SQL = names_rule_sql("""
  SELECT conv_id AS batch_id, turn AS pos, text,
    CASE WHEN turn % 4 = 0 THEN role || '.txt' WHEN turn % 4 = 1 THEN upper(role) || '.TXT'
         WHEN turn % 4 = 2 THEN role || '_1.txt' ELSE role || '.docx' END AS filename
  FROM conversations""")


# Uploads with odd names: the checks stated per row, then per batch.  Batches
# that pass hold one name per role, so collisions are numbered in order.
_REJECTS_SQL = """
WITH k AS (SELECT *, ((conv_id * 7 + turn * 3) % 9 + 9) % 9 AS k FROM conversations),
u AS (
  SELECT CASE WHEN NOT (conv_id % 3 = 1 AND k = 5) THEN conv_id END AS batch_id, conv_id, turn AS pos,
    CASE WHEN conv_id % 3 = 0 THEN role || '.txt' WHEN k = 0 THEN NULL WHEN k = 1 THEN '' WHEN k = 2 THEN '..'
         WHEN k = 3 THEN role || '.exe' WHEN k = 4 THEN 'in/' || role || '.txt' ELSE role || '.txt' END AS filename
  FROM k),
e AS (
  SELECT *, CASE WHEN batch_id IS NULL THEN 'The upload names no batch.'
                 WHEN coalesce(filename, '') IN ('', '..') THEN 'Choose a file with a name.'
                 WHEN ends_with(filename, '.exe') THEN 'Unsupported file type ''.exe''. Use .docx, .pdf, .txt.' END AS err
  FROM u),
b AS (SELECT *, count(err) OVER (PARTITION BY batch_id) > 0 AS refused,
        CASE WHEN starts_with(filename, 'in/') THEN substr(filename, 4) ELSE filename END AS base FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY batch_id, base, refused ORDER BY pos) AS j FROM b)
SELECT batch_id, conv_id, pos, filename,
  CASE WHEN NOT refused THEN CASE WHEN j = 1 THEN base ELSE left(base, length(base) - 4) || '_' || (j - 1) || '.txt' END END AS stored_name,
  CASE WHEN refused THEN coalesce(err, 'Another file of the batch was refused.') END AS reason
FROM n"""


def _scripted(body: str) -> str:
    """The scripted provider's answers, by the length of the text."""
    return _with("""
, scripted AS (
  SELECT r.source_file, 'case_' || (((r.doc_id % 97) + 97) % 97) AS shared, gate, r.status AS rule_status, r.error_message AS rule_message, text,
    length(text) % 5 AS k, contains(lower(text), 'jailbreak') AS says_no, contains(lower(text), 'kettle') AS bad_summary
  FROM x4 JOIN results r ON r.doc_id = x4.doc_id
),
scripted1 AS (
  SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN k = 3 THEN 'LLM_PROVIDER_ERROR' WHEN k = 4 THEN 'STRUCTURED_OUTPUT_VALIDATION_ERROR'
                 WHEN says_no THEN 'NOT_A_COMPLAINT' WHEN bad_summary THEN 'SUMMARY_GENERATION_ERROR' END AS code FROM scripted),
scripted2 AS (SELECT *, code IS NULL AS ok FROM scripted1)
""".replace("\n, scripted AS", ", scripted AS", 1) + body)


def _prompts_sql() -> str:
    from casegrid.functions import drafts as D
    from casegrid.plans.corpus import sql_str

    email, summary = sql_str(D.EMAIL_INSTRUCTION), sql_str(D.SUMMARY_INSTRUCTION)
    fields = duck.q(",".join(CASE_COLS))
    return f"""
SELECT r.document_id, '{D.PROMPT_VERSION}' AS prompt_version,
  {sql_str(D.EXTRACTION_INSTRUCTION)} || chr(10) || '<<<DOCUMENT>>>' || chr(10) || x.text || chr(10) || '<<<END_DOCUMENT>>>' AS extract_prompt,
  {email} AS email_rules, {summary} AS summary_rules, {fields} AS email_fields, {fields} AS summary_fields,
  r.issue_description AS email_issue, r.issue_description AS summary_issue, true AS email_ends, true AS summary_ends,
  contains({email}, x.text) OR contains({summary}, x.text) AS text_in_drafts,
  contains({email}, '<<<DOCUMENT>>>') OR contains({summary}, '<<<DOCUMENT>>>') AS mark_in_drafts
FROM results r JOIN x4 x ON x.doc_id = r.doc_id WHERE r.status = 'success'"""


_PUBLISHED = """, published AS (
  SELECT *, status = 'success' AND ends_with(document_id, '7') AS blocked FROM results)"""


def _digest_sql(*cols: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(({c})::VARCHAR, '~')" for c in cols) + ")"
    return f"sum(('0x' || left(sha256({text}), 12))::BIGINT::HUGEINT)::VARCHAR"


def _payload_sql() -> str:
    docs = _digest_sql("document_id", "base", "status", "error_code", "error_message", "coalesce(customer_email, '')", "coalesce(case_summary, '')",
                       "customer_name", "email", "issue_description", "is_complaint", "status = 'success'")
    rows = _digest_sql("document_id", "base", "status", "coalesce(error_code, '')", "coalesce(complaint_category, '')", f"'{RUN_COMPLETED_ISO}'")
    return _with(f""", b AS (SELECT *, {duck.base_name('source_file')} AS base FROM results)
SELECT 'documents' AS section, count(*) AS entries, count(*) FILTER (WHERE status = 'success') AS cases,
  coalesce(sum(length(coalesce(customer_email, '')) + length(coalesce(case_summary, ''))), 0)::BIGINT AS chars, {docs} AS digest FROM b
UNION ALL SELECT 'report_rows', count(*), count(*) FILTER (WHERE status = 'success'), coalesce(sum(length('{RUN_COMPLETED_ISO}')), 0)::BIGINT, {rows} FROM b""")


def _case_validate_sql() -> str:
    from casegrid.schema import CASE_STATUSES, CATEGORIES

    def t(f):
        return f"json_type(jc, '$.{f}')"

    def v(f):
        return f"json_extract_string(jc, '$.{f}')"

    cats = ", ".join(duck.q(c) for c in CATEGORIES)
    stats = ", ".join(duck.q(c) for c in CASE_STATUSES)
    truthy = "('1', 'on', 't', 'true', 'y', 'yes')"
    falsy = "('0', 'off', 'f', 'false', 'n', 'no')"

    def boolean(f):
        return (f"CASE WHEN {t(f)} = 'BOOLEAN' THEN {v(f)} = 'true' "
                f"WHEN {t(f)} IN ('UBIGINT', 'BIGINT') AND {v(f)} IN ('0', '1') THEN {v(f)} = '1' "
                f"WHEN {t(f)} = 'VARCHAR' AND lower({v(f)}) IN {truthy} THEN true "
                f"WHEN {t(f)} = 'VARCHAR' AND lower({v(f)}) IN {falsy} THEN false END")

    def opt_str(f):
        return f"({t(f)} IS NULL OR {t(f)} IN ('NULL', 'VARCHAR'))"

    email = v("email")
    checks = " AND ".join([
        opt_str("customer_name"), opt_str("phone_number"), opt_str("resolution_provided"),
        f"({opt_str('email')} AND ({t('email')} IS DISTINCT FROM 'VARCHAR' OR {duck.email_is_valid(email)}))",
        f"{t('issue_description')} = 'VARCHAR'",
        f"({t('complaint_category')} IS NULL OR ({t('complaint_category')} = 'VARCHAR' AND {v('complaint_category')} IN ({cats})))",
        f"({t('overall_case_status')} IS NULL OR ({t('overall_case_status')} = 'VARCHAR' AND {v('overall_case_status')} IN ({stats})))",
        *[f"({boolean(b)}) IS NOT NULL" for b in ("is_complaint", "escalation_required", "supporting_document_available")],
    ])
    obj = ("(jc IS NOT NULL AND regexp_matches(content, '(?s)^[ \\t\\n\\r]*\\{.*\\}[ \\t\\n\\r]*$') "
           "AND json_type(jc) = 'OBJECT')")
    fields = {
        "customer_name": f"CASE WHEN {t('customer_name')} = 'VARCHAR' THEN {v('customer_name')} END",
        "email": f"CASE WHEN {t('email')} = 'VARCHAR' THEN {duck.normalize_email(email)} END",
        "phone_number": f"CASE WHEN {t('phone_number')} = 'VARCHAR' THEN {v('phone_number')} END",
        "complaint_category": f"coalesce({v('complaint_category')}, 'unknown')",
        "issue_description": v("issue_description"),
        "resolution_provided": f"CASE WHEN {t('resolution_provided')} = 'VARCHAR' THEN {v('resolution_provided')} END",
        "is_complaint": boolean("is_complaint"),
        "escalation_required": boolean("escalation_required"),
        "supporting_document_available": boolean("supporting_document_available"),
        "overall_case_status": f"coalesce({v('overall_case_status')}, 'unknown')",
    }
    cols = ", ".join(f"CASE WHEN good THEN {expr} END AS {name}" for name, expr in fields.items())
    content = """CASE ((doc_id % 20) + 20) % 20
      WHEN 0 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                              'supporting_document_available', true, 'complaint_category', 'billing',
                              'email', 'Ann@Example.COM')::VARCHAR
      WHEN 1 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                              'supporting_document_available', true, 'customer_name', NULL, 'email', NULL,
                              'phone_number', NULL, 'overall_case_status', 'open')::VARCHAR
      WHEN 2 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                              'supporting_document_available', true, 'complaint_category', 'furniture')::VARCHAR
      WHEN 3 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                              'supporting_document_available', true, 'email', 'not-an-email')::VARCHAR
      WHEN 4 THEN json_object('is_complaint', true, 'escalation_required', false,
                              'supporting_document_available', true)::VARCHAR
      WHEN 5 THEN json_object('issue_description', 5, 'is_complaint', true, 'escalation_required', false,
                              'supporting_document_available', true)::VARCHAR
      WHEN 6 THEN 'not json ' || source
      WHEN 7 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                              'supporting_document_available', true, 'complaint_category', NULL)::VARCHAR
      WHEN 8 THEN json_object('issue_description', text, 'is_complaint', 'yes', 'escalation_required', 0,
                              'supporting_document_available', 'OFF', 'extra_field', 1)::VARCHAR
      WHEN 9 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                              'supporting_document_available', true)::VARCHAR || ' trailing'
      WHEN 10 THEN '[1, 2]'
      WHEN 11 THEN json_object('issue_description', text, 'is_complaint', 2, 'escalation_required', false,
                               'supporting_document_available', false)::VARCHAR
      -- What is left of keys given twice, and of keys of no interest.
      WHEN 12 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                               'supporting_document_available', true)::VARCHAR
      WHEN 13 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                               'supporting_document_available', true)::VARCHAR
      WHEN 14 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                               'supporting_document_available', 0.5)::VARCHAR
      WHEN 15 THEN ' ' || chr(10) || chr(9)
      WHEN 16 THEN NULL
      WHEN 19 THEN json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                               'supporting_document_available', true, 'email', 'Ann Lee Ann@Example.COM')::VARCHAR
      -- Names before addresses are not part of them.
      ELSE json_object('issue_description', text, 'is_complaint', true, 'escalation_required', false,
                       'supporting_document_available', true, 'email', 'Ann@Example.COM')::VARCHAR END"""
    blank = f"(content IS NULL OR {duck.strip('content')} = '')"
    return f"""
WITH r AS (SELECT doc_id, {content} AS content FROM documents),
r2 AS (SELECT doc_id, content, CASE WHEN json_valid(content) THEN content END AS jc FROM r),
g AS (SELECT doc_id, content, jc, coalesce(NOT {blank} AND {obj} AND {checks}, false) AS good FROM r2)
SELECT doc_id, CASE WHEN good THEN NULL ELSE 'STRUCTURED_OUTPUT_VALIDATION_ERROR' END AS error_code, {cols}
FROM g"""


def oracle_sql() -> dict[str, str]:
    snorm = duck.normalize("text")
    return {
        "triage_summary": _with(
            "SELECT status, coalesce(error_code, '') AS error_code, "
            "coalesce(complaint_category, '') AS complaint_category, count(*) AS n "
            "FROM results GROUP BY ALL"),
        "normalize_text": "WITH " + duck.corpus_cte() + f"""
SELECT doc_id, norm_text, CAST(length(norm_text) AS BIGINT) AS norm_chars
FROM (SELECT doc_id, {snorm} AS norm_text FROM corpus)""",
        "document_ids": "WITH " + duck.corpus_cte() + f"""
SELECT doc_id, rel_path, name, suffix, left(name, length(name) - length(suffix)) AS stem,
  left(document_id, length(document_id) - 9) AS id_stem, document_id FROM corpus""",
        "listing_order": """
WITH d AS (SELECT doc_id, lang, CASE doc_id % 7 WHEN 0 THEN source || '-old' WHEN 1 THEN source || ' b' WHEN 2 THEN upper(source) ELSE source END AS top
           FROM documents),
p AS (SELECT doc_id, concat_ws('/', top, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN lang || '/é.d/x!' END, 'f' || doc_id || '.txt') AS rel_path FROM d)
SELECT doc_id, rel_path, row_number() OVER (ORDER BY string_split(rel_path, '/')) - 1 AS position FROM p""",
        "scope_gate": "WITH " + duck.corpus_cte() + f""",
low AS (SELECT doc_id, lower({snorm}) AS low FROM corpus)
SELECT doc_id, {duck.contains_any('low', COMPLAINT_CUES)} AS has_cue,
  {duck.out_of_scope('low')} AS out_of_scope FROM low""",
        "rule_extract": "WITH " + duck.corpus_cte() + f""",
n AS (SELECT doc_id, {snorm} AS text FROM corpus),
n2 AS (SELECT doc_id, text, lower(text) AS low, {duck.first_match('text', EMAIL_RE)} AS found_email FROM n WHERE text <> '')
SELECT doc_id,
  nullif({duck.strip(duck.first_match('text', NAME_RE, 1))}, '') AS customer_name,
  CASE WHEN found_email IS NOT NULL THEN {duck.normalize_email('found_email')} END AS email,
  {duck.first_match('text', PHONE_RE)} AS phone_number,
  {duck.category('low')} AS complaint_category,
  left(text, 1000) AS issue_description,
  CAST(NULL AS VARCHAR) AS resolution_provided,
  NOT {duck.out_of_scope('low')} AS is_complaint,
  {duck.contains_any('low', ESCALATION_TOKENS)} AS escalation_required,
  {duck.contains_any('low', ATTACHMENT_TOKENS)} AS supporting_document_available,
  'open' AS overall_case_status,
  coalesce({duck.email_is_valid('found_email')}, true) AS email_ok
FROM n2""",
        "contact_find": f"""
SELECT doc_id, email, phone, name, {duck.email_is_valid('email')} AS email_valid FROM (
  SELECT doc_id, {duck.first_match('text', EMAIL_RE)} AS email, {duck.first_match('text', PHONE_RE)} AS phone,
    nullif({duck.strip(duck.first_match('text', NAME_RE, 1))}, '') AS name FROM documents)""",
        "outcomes": _with("SELECT document_id, source_file, status, error_code, error_message FROM results"),
        "outcome_counts": _with(
            "SELECT count(*) AS discovered, count(*) FILTER (WHERE status = 'success') AS successful, "
            "count(*) FILTER (WHERE status NOT IN ('success', 'skipped')) AS failed, "
            "count(*) FILTER (WHERE status = 'skipped') AS skipped FROM results"),
        "status_counts": _with("SELECT status, count(*) AS n FROM results GROUP BY status"),
        "category_counts": _with(
            "SELECT complaint_category, count(*) AS n FROM results WHERE status = 'success' GROUP BY 1"),
        "report_rows": _with(_REPORT_SELECT + " ORDER BY source_file"),
        "report_basenames": _with(_REPORT_SELECT.replace(
            "SELECT document_id, source_file,",
            "SELECT document_id, CASE WHEN coalesce(source_file, '') = '' THEN '' ELSE "
            + duck.base_name("source_file") + " END AS source_file,")),
        "email_drafts": _with(
            "SELECT document_id, customer_email, (customer_email IS NOT NULL) AS email_ok FROM results"),
        "summary_drafts": _with(
            "SELECT document_id, case_summary, (case_summary IS NOT NULL) AS summary_ok FROM results"),
        "structured_json": _with(
            f"SELECT document_id, document_id AS j_document_id, source_file AS j_source_file, {_case_json_cols()}, "
            "true AS all_keys, true AS ascii_only FROM results WHERE status = 'success'"),
        "resume_skip": _with(
            "SELECT document_id, status, error_code FROM results",
            published_sql="SELECT document_id FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels)",
        ),
        "manifest_rows": _with(
            f"SELECT document_id, {duck.base_name('source_file')} AS source_file, status, error_code FROM results"),
        "run_payload": _with(
            f"SELECT {duck.base_name('source_file')} AS source_file, document_id, status, error_code, error_message, "
            "coalesce(customer_email, '') AS customer_email, coalesce(case_summary, '') AS case_summary, "
            "(status = 'success') AS has_structured FROM results"),
        "infer_repair": _scripted(f"""
SELECT shared AS document_id, source_file,
  CASE WHEN gate IS NOT NULL THEN rule_status WHEN code IS NULL THEN 'success' WHEN says_no AND k < 3 THEN 'skipped' ELSE 'failed' END AS status,
  CASE WHEN gate IS NOT NULL THEN gate ELSE code END AS error_code,
  CASE WHEN gate IS NOT NULL THEN rule_message WHEN k = 3 THEN 'unauthorized' WHEN k = 4 THEN 'Provider JSON failed case validation'
       WHEN says_no THEN {duck.q(NOT_A_COMPLAINT_MESSAGE)} WHEN bad_summary THEN {duck.q(SUMMARY_DRAFT_BAD_MESSAGE)} END AS error_message,
  CAST(NULL AS VARCHAR) AS customer_name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone_number,
  CASE WHEN ok THEN 'other' END AS complaint_category, CASE WHEN ok THEN text END AS issue_description,
  CAST(NULL AS VARCHAR) AS resolution_provided, CASE WHEN ok THEN true END AS is_complaint,
  CASE WHEN ok THEN true END AS escalation_required, CASE WHEN ok THEN false END AS supporting_document_available,
  CASE WHEN ok THEN 'unknown' END AS overall_case_status
FROM scripted2"""),
        "model_usage": _scripted("""
SELECT 'extract' AS task, 1 AS attempt, count(*) AS calls FROM scripted2 WHERE gate IS NULL AND k <> 3 HAVING count(*) > 0
UNION ALL SELECT 'extract', 2, count(*) FROM scripted2 WHERE gate IS NULL AND k IN (1, 4) HAVING count(*) > 0
UNION ALL SELECT t.task, 1, count(*) FROM scripted2, (VALUES ('email'), ('summary')) t(task)
WHERE gate IS NULL AND k < 3 AND NOT says_no GROUP BY t.task"""),
        "prompts": _with(_prompts_sql()),
        "error_codes": _with(
            ", taxonomy(error_code, status, stage) AS (VALUES "
            + ", ".join(f"({duck.q(c)}, {duck.q(st)}, {duck.q(sg)})" for c, (st, sg) in ERROR_CODES.items())
            + ") SELECT t.error_code, t.status, t.stage, count(r.document_id) AS n FROM taxonomy t "
            "LEFT JOIN results r ON r.error_code = t.error_code GROUP BY ALL"),
        "run_timing": f"SELECT '2026-01-01T00:00:00+00:00' AS started_at, '{RUN_COMPLETED_ISO}' AS completed_at, "
                      "CAST(1500 AS BIGINT) AS max_duration_ms, CAST(1500 * count(*) AS BIGINT) AS total_duration_ms FROM documents",
        "run_summary": _with(
            "SELECT count(*) AS discovered, count(*) FILTER (WHERE status = 'success') AS successful, "
            "count(*) FILTER (WHERE status NOT IN ('success', 'skipped')) AS failed, "
            "count(*) FILTER (WHERE status = 'skipped') AS skipped, "
            "count(*) FILTER (WHERE status = 'success') AS documents_with_case, "
            "CAST(coalesce(sum(length(customer_email)), 0) AS BIGINT) AS email_chars, "
            "CAST(coalesce(sum(length(case_summary)), 0) AS BIGINT) AS summary_chars FROM results"),
        "upload_rejects": _REJECTS_SQL,
        "docx_text": f"""
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN {duck.normalize("coalesce(text, '')")} END AS norm_text,
  CASE WHEN doc_id % 7 = 0 THEN 'DOCUMENT_READ_ERROR' END AS read_error FROM documents""",
        "upload_names": _UPLOADS_SQL + """
SELECT batch_id, pos, filename, stored_name FROM named""",
        "upload_triage": _UPLOADS_SQL + f""",
t AS (
  SELECT *, {duck.document_id("(CAST(batch_id AS VARCHAR) || '/' || stored_name)", 'stored_name')} AS document_id,
    CAST(batch_id AS VARCHAR) || '/' || stored_name AS source_file,
    CASE WHEN lower(sfx) = '.docx' AND pos % 7 = 0 THEN NULL ELSE {duck.normalize('text')} END AS norm
  FROM named),
g AS (
  SELECT *, lower(norm) AS low, {duck.first_match('norm', EMAIL_RE)} AS found FROM t),
c AS (
  SELECT document_id, source_file,
    CASE WHEN norm IS NULL THEN 'DOCUMENT_READ_ERROR'
         WHEN norm = '' THEN 'EMPTY_DOCUMENT'
         WHEN {duck.out_of_scope('low')} THEN 'NOT_A_COMPLAINT'
         WHEN found IS NOT NULL AND NOT {duck.email_is_valid('found')} THEN 'LLM_PROVIDER_ERROR' END AS error_code
  FROM g)
SELECT document_id, source_file,
  CASE WHEN error_code IS NULL THEN 'success' WHEN error_code = 'NOT_A_COMPLAINT' THEN 'skipped'
       ELSE 'failed' END AS status, error_code
FROM c""",
        "ingest_summary": "WITH " + duck.corpus_cte() + f""",
i AS (
  SELECT source_file, lower(suffix) AS sfx,
    CASE WHEN lower(suffix) IN ('.txt', '.pdf', '.docx') THEN {snorm} END AS norm
  FROM corpus),
c AS (
  SELECT source_file,
    CASE WHEN sfx NOT IN ('.txt', '.pdf', '.docx') THEN 'UNSUPPORTED_FILE_TYPE'
         WHEN norm = '' THEN CASE WHEN sfx = '.pdf' THEN 'EMPTY_OR_SCANNED_PDF' ELSE 'EMPTY_DOCUMENT' END
    END AS error_code, norm
  FROM i)
SELECT source_file,
  CASE WHEN error_code = 'UNSUPPORTED_FILE_TYPE' THEN 'skipped' WHEN error_code IS NOT NULL THEN 'failed'
       ELSE 'extracted' END AS status,
  error_code,
  CAST(CASE WHEN error_code IS NULL THEN length(norm) END AS BIGINT) AS char_count
FROM c""",
        "manifest_header": _with(
            "SELECT '2026-01-01T00:00:00+00:00' AS started_at, "
            f"'{RUN_COMPLETED_ISO}' AS completed_at, 'out/final_report.csv' AS report_path, "
            "'rules' AS llm_provider, CAST(2 AS BIGINT) AS max_llm_attempts, false AS overwrite, "
            "count(*) AS discovered, count(*) FILTER (WHERE status = 'success') AS successful, "
            "count(*) FILTER (WHERE status NOT IN ('success', 'skipped')) AS failed, "
            "count(*) FILTER (WHERE status = 'skipped') AS skipped, "
            "CAST(NULL AS BIGINT) AS token_calls FROM results"),
        "publish_outcomes": _with(_PUBLISHED + """
SELECT document_id, source_file, CASE WHEN blocked THEN 'failed' ELSE status END AS status,
  CASE WHEN blocked THEN 'DOCUMENT_PROCESS_ERROR' ELSE error_code END AS error_code,
  CASE WHEN blocked THEN 'IsADirectoryError' ELSE error_message END AS error_message,
  CASE WHEN status = 'success' AND NOT blocked THEN 3 ELSE 0 END::BIGINT AS files,
  CASE WHEN status = 'success' AND NOT blocked THEN true END AS holds_bodies FROM published"""),
        "error_codes_published": _with(
            _PUBLISHED + ", taxonomy(error_code, status) AS (VALUES "
            + ", ".join(f"({duck.q(c)}, {duck.q(st)})" for c, (st, _) in ERROR_CODES.items())
            + "), c AS (SELECT CASE WHEN blocked THEN 'DOCUMENT_PROCESS_ERROR' ELSE error_code END AS error_code FROM published) "
            "SELECT t.error_code, t.status, count(c.error_code) AS n FROM taxonomy t LEFT JOIN c USING (error_code) GROUP BY ALL"),
        "manifest_document": _with(
            f"SELECT document_id, {duck.base_name('source_file')} AS source_file, status, error_code, "
            "count(*) OVER () AS discovered, count(*) FILTER (WHERE status = 'success') OVER () AS successful FROM results"),
        "payload_document": _payload_sql(),
        "case_validate": _case_validate_sql(),
        "usage_totals": """
WITH calls AS (
  SELECT event_type AS run_id,
    coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS p,
    CAST(floor(value) AS BIGINT) AS c,
    CASE WHEN event_type = 'click' THEN 0
         ELSE coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) + CAST(floor(value) AS BIGINT) END AS t
  FROM events),
counted AS (SELECT *, NOT (p = 0 AND c = 0 AND t = 0) AS ok, CASE WHEN t = 0 THEN p + c ELSE t END AS tt FROM calls),
agg AS (
  SELECT run_id, count(*) FILTER (WHERE ok) AS calls,
    sum(p) FILTER (WHERE ok) AS prompt_tokens, sum(c) FILTER (WHERE ok) AS completion_tokens,
    sum(tt) FILTER (WHERE ok) AS total_tokens
  FROM counted GROUP BY run_id)
SELECT run_id,
  CAST(CASE WHEN calls > 0 THEN calls END AS BIGINT) AS calls,
  CAST(CASE WHEN calls > 0 THEN prompt_tokens END AS BIGINT) AS prompt_tokens,
  CAST(CASE WHEN calls > 0 THEN completion_tokens END AS BIGINT) AS completion_tokens,
  CAST(CASE WHEN calls > 0 THEN total_tokens END AS BIGINT) AS total_tokens
FROM agg""",
    }
