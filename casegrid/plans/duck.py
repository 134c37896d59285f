"""DuckDB SQL mirroring the triage plan, for cross-checking results.

Each helper returns a SQL expression string built from the same pattern
strings the Spark plan uses (``casegrid.functions.*``), so the two sides
cannot drift apart on word lists or regexes.  Only engine syntax differs
(``regexp_replace(..., 'g')``, ``||``, ``split_part``).
"""

from __future__ import annotations

from casegrid.functions.extract import (
    EMAIL_RE,
    NAME_RE,
    PHONE_RE,
    SPECIAL_DOMAIN_RE,
    VALID_EMAIL_RE,
)
from casegrid.functions.patterns import (
    ATTACHMENT_TOKENS,
    CATEGORY_HINTS,
    COMPLAINT_CUES,
    ESCALATION_TOKENS,
    ISSUE_MAX_CHARS,
)
from casegrid.functions.scope import INJECTION_RE, OFF_TASK_RE
from casegrid.functions.text import LINE_EDGE_SPACE, TEXT_EDGE_SPACE
from casegrid.plans.corpus import EXTENSIONS, INPUT_ROOT, SNIPPETS, _sql_case, sql_str
from casegrid.schema import (
    ARTIFACTS_EXIST_MESSAGE,
    NOT_A_COMPLAINT_MESSAGE,
    SUPPORTED_SUFFIXES,
    UNEXPECTED_PROVIDER_MESSAGE,
)


def q(s: str) -> str:
    """Quote a plain SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {q(TEXT_EDGE_SPACE)}, '', 'g')"


def normalize(t: str) -> str:
    x = f"replace({t}, chr(0), '')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, {q(LINE_EDGE_SPACE)}, '', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(x)


def contains_any(low: str, needles) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(n)})" for n in needles) + ")"


def out_of_scope(low: str) -> str:
    return (
        f"(NOT {contains_any(low, COMPLAINT_CUES)} AND (regexp_matches({low}, {q(INJECTION_RE)})"
        f" OR regexp_matches({low}, {q(OFF_TASK_RE)})))"
    )


def category(low: str) -> str:
    arms = " ".join(f"WHEN {contains_any(low, hints)} THEN {q(name)}" for name, hints in CATEGORY_HINTS)
    return f"CASE {arms} ELSE 'unknown' END"


def first_match(t: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({t}, {q(pattern)}, {group}), '')"


def email_is_valid(e: str) -> str:
    return (
        f"(CASE WHEN {e} IS NULL THEN NULL WHEN length({e}) > 254 THEN false"
        f" WHEN length(split_part({e}, '@', 1)) > 64 THEN false ELSE regexp_matches({e}, {q(VALID_EMAIL_RE)})"
        f" AND NOT regexp_matches(lower(split_part({e}, '@', 2)), {q(SPECIAL_DOMAIN_RE)}) END)"
    )


def normalize_email(e: str) -> str:
    return f"(split_part({e}, '@', 1) || '@' || lower(split_part({e}, '@', 2)))"


def suffix(name: str) -> str:
    return f"regexp_extract({name}, '(?s)^.+(\\.[^.]+)$', 1)"


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def document_id(rel: str, name: str) -> str:
    stem = f"left({name}, length({name}) - length({suffix(name)}))"
    cleaned = f"lower(trim(regexp_replace({stem}, '[^a-zA-Z0-9]+', '_', 'g'), '_'))"
    cleaned = f"left(CASE WHEN {cleaned} = '' THEN 'document' ELSE {cleaned} END, 40)"
    return f"({cleaned} || '_' || left(sha256({rel}), 8))"


def yes_no(b: str) -> str:
    return f"CASE WHEN {b} THEN 'yes' ELSE 'no' END"


def email_draft(c: str = "") -> str:
    """Mirror of ``drafts.email_draft`` over flat case columns."""
    nl, nl2 = "chr(10)", "chr(10) || chr(10)"
    return (
        f"('# Subject: We are looking into your ' || {c}complaint_category || ' report' || {nl2}"
        f" || 'Dear ' || coalesce({c}customer_name, 'Customer') || ',' || {nl2}"
        f" || 'Your message has reached us. Our notes say:' || {nl2} || '> '"
        f" || replace({c}issue_description, {nl}, {nl} || '> ') || {nl2}"
        f" || '| Status | Passed to a senior colleague |' || {nl} || '| --- | --- |' || {nl} || '| '"
        f" || {c}overall_case_status || ' | ' || {yes_no(c + 'escalation_required')} || ' |' || {nl2}"
        f" || 'Draft for human review: nothing in it commits us to a date, a refund or a policy.' || {nl2}"
        f" || 'Yours,' || {nl} || 'Customer Care' || {nl})"
    )


def summary_draft(c: str = "") -> str:
    nl, nl2 = "chr(10)", "chr(10) || chr(10)"
    nxt = (f"CASE WHEN {c}escalation_required THEN 'Hand over to a person who may decide.' "
           f"ELSE 'Find someone to own the case, after a look at the draft.' END")
    return (
        f"('# Internal notes' || {nl2} || '## Overview' || {nl} || '- who: ' || coalesce({c}customer_name, 'Unknown')"
        f" || {nl} || '- about: ' || {c}complaint_category || {nl} || '- is a complaint: ' || {yes_no(c + 'is_complaint')} || {nl2}"
        f" || '## Issue' || {nl} || {c}issue_description || {nl2}"
        f" || '## Action' || {nl} || coalesce({c}resolution_provided, 'Unknown. Nothing has been noted so far.') || {nl2}"
        f" || '## Status' || {nl} || {c}overall_case_status || {nl2}"
        f" || '## Next action' || {nl} || {nxt} || {nl})"
    )


def corpus_cte() -> str:
    """``corpus(doc_id, rel_path, name, suffix, document_id, source_file, text)``."""
    snippet = _sql_case(f"(((doc_id % {len(SNIPPETS)}) + {len(SNIPPETS)}) % {len(SNIPPETS)})", SNIPPETS)
    ext = _sql_case("(((floor(doc_id / 10)::BIGINT % 10) + 10) % 10)", EXTENSIONS)
    return f"""
corpus_raw AS (
  SELECT doc_id,
         source || '/' || lang || '/doc ' || CAST(doc_id AS VARCHAR) || {ext} AS rel_path,
         {snippet} || chr(10) || coalesce(text, '') AS text
  FROM documents
),
corpus_named AS (
  SELECT doc_id, rel_path, {base_name('rel_path')} AS name, text FROM corpus_raw
),
corpus AS (
  SELECT doc_id, rel_path, name, {suffix('name')} AS suffix,
         {document_id('rel_path', 'name')} AS document_id,
         {q(INPUT_ROOT + '/')} || rel_path AS source_file, text
  FROM corpus_named
)"""


def pipeline_ctes(published_sql: str | None = None) -> str:
    """CTE chain ending in ``results``: one row per corpus row with status,
    error code/message, flat case fields and draft bodies.

    ``published_sql`` is a query (it may read ``corpus``) giving the
    ``document_id`` values already published (F2/J1)."""
    supported = ", ".join(q(s) for s in SUPPORTED_SUFFIXES)
    published = "document_id IN (SELECT document_id FROM published)" if published_sql else "false"
    pub_cte = f",\npublished AS ({published_sql})" if published_sql else ""
    low = "low"
    return corpus_cte() + pub_cte + f""",
g1 AS (
  SELECT *, lower(suffix) AS sfx, {published} AS is_published FROM corpus
),
g2 AS (
  SELECT *, CASE WHEN sfx NOT IN ({supported}) THEN 'UNSUPPORTED_FILE_TYPE'
                 WHEN is_published THEN 'ARTIFACTS_EXIST' END AS pre
  FROM g1
),
g3 AS (
  SELECT * REPLACE (CASE WHEN pre IS NULL THEN {normalize('text')} END AS text) FROM g2
),
g4 AS (
  SELECT *, CASE WHEN text <> '' THEN lower(text) END AS low FROM g3
),
g5 AS (
  SELECT *, coalesce(pre,
           CASE WHEN text = '' THEN CASE WHEN sfx = '.pdf' THEN 'EMPTY_OR_SCANNED_PDF' ELSE 'EMPTY_DOCUMENT' END END,
           CASE WHEN {out_of_scope(low)} THEN 'NOT_A_COMPLAINT' END) AS gate
  FROM g4
),
x1 AS (
  SELECT *, CASE WHEN gate IS NULL THEN {first_match('text', EMAIL_RE)} END AS found_email FROM g5
),
x2 AS (
  SELECT *, (gate IS NULL AND found_email IS NOT NULL AND NOT {email_is_valid('found_email')}) AS bad_email
  FROM x1
),
x3 AS (
  SELECT *,
    CASE WHEN gate IS NULL AND NOT bad_email THEN 1 END AS has_case,
    nullif({strip(first_match('text', NAME_RE, 1))}, '') AS customer_name,
    CASE WHEN found_email IS NOT NULL THEN {normalize_email('found_email')} END AS email,
    {first_match('text', PHONE_RE)} AS phone_number,
    {category(low)} AS complaint_category,
    left(text, {ISSUE_MAX_CHARS}) AS issue_description,
    CAST(NULL AS VARCHAR) AS resolution_provided,
    NOT {out_of_scope(low)} AS is_complaint,
    {contains_any(low, ESCALATION_TOKENS)} AS escalation_required,
    {contains_any(low, ATTACHMENT_TOKENS)} AS supporting_document_available,
    'open' AS overall_case_status
  FROM x2
),
x4 AS (
  SELECT *,
    coalesce(gate, CASE WHEN bad_email THEN 'LLM_PROVIDER_ERROR' END) AS error_code,
    CASE WHEN gate = 'NOT_A_COMPLAINT' THEN {q(NOT_A_COMPLAINT_MESSAGE)}
         WHEN gate = 'ARTIFACTS_EXIST' THEN {q(ARTIFACTS_EXIST_MESSAGE)}
         WHEN gate IS NOT NULL THEN gate
         WHEN bad_email THEN {q(UNEXPECTED_PROVIDER_MESSAGE)} END AS error_message
  FROM x3
),
results AS (
  SELECT doc_id, document_id, source_file, rel_path, name, suffix,
    CASE WHEN error_code IS NULL THEN 'success'
         WHEN error_code IN ('UNSUPPORTED_FILE_TYPE', 'NOT_A_COMPLAINT') THEN 'skipped'
         ELSE 'failed' END AS status,
    error_code, error_message,
    CASE WHEN error_code IS NULL THEN customer_name END AS customer_name,
    CASE WHEN error_code IS NULL THEN email END AS email,
    CASE WHEN error_code IS NULL THEN phone_number END AS phone_number,
    CASE WHEN error_code IS NULL THEN complaint_category END AS complaint_category,
    CASE WHEN error_code IS NULL THEN issue_description END AS issue_description,
    CASE WHEN error_code IS NULL THEN resolution_provided END AS resolution_provided,
    CASE WHEN error_code IS NULL THEN is_complaint END AS is_complaint,
    CASE WHEN error_code IS NULL THEN escalation_required END AS escalation_required,
    CASE WHEN error_code IS NULL THEN supporting_document_available END AS supporting_document_available,
    CASE WHEN error_code IS NULL THEN overall_case_status END AS overall_case_status,
    CASE WHEN error_code IS NULL THEN {email_draft()} END AS customer_email,
    CASE WHEN error_code IS NULL THEN {summary_draft()} END AS case_summary
  FROM x4
)"""


__all__ = [
    "normalize", "strip", "out_of_scope", "category", "email_is_valid", "document_id",
    "pipeline_ctes", "corpus_cte", "email_draft", "summary_draft", "sql_str",
]
