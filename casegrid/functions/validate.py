"""Checks on model output: case JSON (X12, X13, X21) and drafts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.functions.extract import address_of, email_is_valid, normalize_email
from casegrid.functions.patterns import EMAIL_SUBJECT_PREFIX, SUMMARY_HEADINGS
from casegrid.functions.text import strip
from casegrid.schema import (
    CASE_FIELDS,
    CASE_INVALID_MESSAGE,
    CASE_STATUSES,
    CATEGORIES,
    EMPTY_CONTENT_MESSAGE,
    INVALID_JSON_MESSAGE,
    STRUCTURED_OUTPUT_VALIDATION_ERROR,
)

# Line breaks as Python's str.splitlines() sees them.
_BREAK_CHARS = "\\n\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}"
_FIRST_LINE = f"^[^{_BREAK_CHARS}]*"
_FIRST_LINE_AND_BREAK = f"^[^{_BREAK_CHARS}]*(?:\\r\\n|[{_BREAK_CHARS}])?"
# The edge white space that JSON allows.
_JSON_SPACE = " \t\n\r"
_TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
_FALSE_WORDS = ("0", "off", "f", "false", "n", "no")


def email_draft_ok(draft: Column) -> Column:
    """Stripped draft starts with the subject heading; subject and body are
    both non-blank.  Null and blank drafts fail."""
    s = strip(F.coalesce(draft, F.lit("")))
    first = F.regexp_extract(s, _FIRST_LINE, 0)
    subject = strip(F.substring(first, len(EMAIL_SUBJECT_PREFIX) + 1, 1 << 30))
    body = strip(F.regexp_replace(s, _FIRST_LINE_AND_BREAK, ""))
    return s.startswith(EMAIL_SUBJECT_PREFIX) & (subject != "") & (body != "")


def summary_draft_ok(draft: Column) -> Column:
    """All five headings present, case-insensitively, in any order."""
    low = F.lower(F.coalesce(draft, F.lit("")))
    ok = reduce(lambda a, b: a & b, [low.contains(h.lower()) for h in SUMMARY_HEADINGS])
    return ok & (strip(F.coalesce(draft, F.lit(""))) != "")


# --- case JSON -------------------------------------------------------------

#: As a strict parser reads: no single quotes; of equal keys the last one
#: counts, and NaN and Infinity are numbers.
_READ = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}


def _one_value(text: Column) -> Column:
    """True when a JSON parser reads the whole of ``text`` as one value.

    The parser stops at the end of the first value.  So the text is set in an
    array before its own digest: only if nothing but white space follows the
    value, the digest is the second of two elements."""
    mark = F.sha2(text, 256)
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", _READ)
    return F.coalesce((F.size(wrapped) == 2) & (wrapped[1] == mark), F.lit(False))


def _kind(x: Column) -> Column:
    """JSON type of a variant value: STRING, BIGINT, BOOLEAN, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(x), "^([A-Z]+)", 1)


def _present(x: Column) -> Column:
    return x.isNotNull() & ~F.is_variant_null(x)


def _opt_string(x: Column) -> tuple[Column, Column]:
    ok = ~_present(x) | (_kind(x) == "STRING")
    return ok, F.when(_present(x), F.variant_get(x, "$", "string"))


def _req_string(x: Column) -> tuple[Column, Column]:
    return _present(x) & (_kind(x) == "STRING"), F.variant_get(x, "$", "string")


def _enum(x: Column, allowed: tuple[str, ...]) -> tuple[Column, Column]:
    """Missing means ``unknown``; explicit null or a value outside the set
    fails."""
    s = F.variant_get(x, "$", "string")
    ok = x.isNull() | ((_kind(x) == "STRING") & s.isin(*allowed))
    return ok, F.when(x.isNull(), F.lit("unknown")).otherwise(s)


def _req_bool(x: Column) -> tuple[Column, Column]:
    """Lax booleans: true/false, the numbers 0 and 1 (``1.0`` too), and the
    usual yes/no words."""
    kind = _kind(x)
    word = F.lower(F.variant_get(x, "$", "string"))
    num = F.try_variant_get(x, "$", "double")
    value = (
        F.when(kind == "BOOLEAN", F.variant_get(x, "$", "boolean"))
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE") & num.isin(0.0, 1.0), num == 1.0)
        .when((kind == "STRING") & word.isin(*_TRUE_WORDS), F.lit(True))
        .when((kind == "STRING") & word.isin(*_FALSE_WORDS), F.lit(False))
    )
    return _present(x) & value.isNotNull(), value


_STRINGS = ("customer_name", "phone_number", "resolution_provided")
_BOOLS = ("is_complaint", "escalation_required", "supporting_document_available")


def validate_case_json(df: DataFrame, content: str, out: str) -> DataFrame:
    """Validate model output in column ``content`` against the case schema.

    Adds ``out`` = ``struct<case, error_code, error_message>``: ``case`` is
    set only for a JSON object passing every field rule, else the code is
    STRUCTURED_OUTPUT_VALIDATION_ERROR.  Missing and explicit null are told
    apart (missing enums default to ``unknown``; null enums fail).  The
    JSON is parsed once per row; fields are extracted once each.
    """
    c = F.col(content)
    body = F.btrim(c, F.lit(_JSON_SPACE))
    braced = body.startswith("{") & body.endswith("}")
    names = _STRINGS + ("email", "issue_description", "complaint_category", "overall_case_status") + _BOOLS
    fields = ", ".join(f"{n} variant" for n in names)
    d = df.withColumn("_pj", F.from_json(F.when(braced & _one_value(body), body), f"{fields}, _bad string", _READ))
    d = d.withColumn("_pj_obj", F.col("_pj").isNotNull() & F.col("_pj._bad").isNull())
    d = d.select("*", *[F.col(f"_pj.{n}").alias(f"_pj_{n}") for n in names])

    checks, vals = [], {}
    for n in _STRINGS:
        ok, vals[n] = _opt_string(F.col(f"_pj_{n}"))
        checks.append(ok)
    ok, raw_email = _opt_string(F.col("_pj_email"))
    d = d.withColumn("_pj_email_s", address_of(raw_email))
    e = F.col("_pj_email_s")
    checks.append(ok & (e.isNull() | email_is_valid(e)))
    vals["email"] = F.when(e.isNotNull(), normalize_email(e))
    ok, vals["issue_description"] = _req_string(F.col("_pj_issue_description"))
    checks.append(ok)
    ok, vals["complaint_category"] = _enum(F.col("_pj_complaint_category"), CATEGORIES)
    checks.append(ok)
    ok, vals["overall_case_status"] = _enum(F.col("_pj_overall_case_status"), CASE_STATUSES)
    checks.append(ok)
    for n in _BOOLS:
        ok, vals[n] = _req_bool(F.col(f"_pj_{n}"))
        checks.append(ok)
    d = d.select("*", *[F.coalesce(x, F.lit(False)).alias(f"_pj_ok{i}") for i, x in enumerate(checks)],
                 *[v.alias(f"_pj_v_{k}") for k, v in vals.items()])
    fields_ok = reduce(lambda a, b: a & b, [F.col(f"_pj_ok{i}") for i in range(len(checks))])
    blank = c.isNull() | (strip(c) == "")
    good = ~blank & F.col("_pj_obj") & fields_ok
    case = F.struct(*[F.col(f"_pj_v_{k}").alias(k) for k in CASE_FIELDS])
    message = (
        F.when(blank, F.lit(EMPTY_CONTENT_MESSAGE))
        .when(~F.col("_pj_obj"), F.lit(INVALID_JSON_MESSAGE))
        .when(~fields_ok, F.lit(CASE_INVALID_MESSAGE))
    )
    d = d.withColumn(out, F.struct(
        F.when(good, case).alias("case"),
        F.when(~good, F.lit(STRUCTURED_OUTPUT_VALIDATION_ERROR)).alias("error_code"),
        message.alias("error_message"),
    ))
    return d.drop(*[x for x in d.columns if x.startswith("_pj")])
