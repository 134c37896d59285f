"""Rule-based case extraction as native column expressions.

Nothing here calls Python per row: the whole case record is one
``struct`` of built-in expressions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrid.functions.patterns import (
    ATTACHMENT_TOKENS,
    CATEGORY_HINTS,
    ESCALATION_TOKENS,
    ISSUE_MAX_CHARS,
    NAME_MAX_TAIL,
    SPECIAL_USE_DOMAINS,
)
from casegrid.functions.regex import DIGIT, FOLDED_LETTERS, SPACE, ci_literal
from casegrid.functions.scope import out_of_scope
from casegrid.functions.text import contains_any, strip

# EMAIL_PATTERN / PHONE_PATTERN / NAME_PATTERN (patterns.py) in a form that
# Java regex and RE2 read the same way as Python does.
# First e-mail-like token, matched case-insensitively.
_LOCAL_CHARS = f"[{FOLDED_LETTERS}0-9._%+\\-]"
EMAIL_RE = f"{_LOCAL_CHARS}+@[{FOLDED_LETTERS}0-9.\\-]+\\.[{FOLDED_LETTERS}]{{2,}}"
# Same leftmost match, found in linear time: a match attempt that starts
# inside a run of local-part characters cannot succeed unless one at the
# run's start does, so those starts are skipped.
_EMAIL_SEARCH_RE = f"(?<!{_LOCAL_CHARS})" + EMAIL_RE
# "+", a digit, at least eight digits/hyphens/spaces, a digit.
PHONE_RE = f"\\+{DIGIT}[{DIGIT}\\- ]{{8,}}{DIGIT}"
# A name after "customer:" or "from:" (no word boundary), case-insensitive.
NAME_RE = (
    f"(?:{ci_literal('customer')}|{ci_literal('from')}){SPACE}*:{SPACE}*"
    f"([{FOLDED_LETTERS}][{FOLDED_LETTERS} .'\\-]{{1,{NAME_MAX_TAIL}}})"
)

# Address syntax accepted by the case schema (a documented subset of RFC
# 5321/5322 rules): dot-separated atoms, labelled domain whose last label
# ends in a letter, length limits.  Repeated groups recurse in Java's regex
# engine, so the pattern is only ever run on texts within the length limits.
EMAIL_MAX_CHARS, LOCAL_MAX_CHARS = 254, 64
_LOCAL_ATOM = f"[{FOLDED_LETTERS}0-9!#$%&'*+/=?^_`{{|}}~\\-]+"
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9\\-]{0,61}[A-Za-z0-9])?"
_LAST_LABEL = "(?:[A-Za-z0-9][A-Za-z0-9\\-]{0,61})?[A-Za-z]"
VALID_EMAIL_RE = f"^{_LOCAL_ATOM}(?:\\.{_LOCAL_ATOM})*@(?:{_LABEL}\\.)+{_LAST_LABEL}$"
SPECIAL_DOMAIN_RE = "(?:^|\\.)(?:" + "|".join(SPECIAL_USE_DOMAINS) + ")$"


# A display name, bare words or quoted, before an address in angle brackets.
NAMED_MAX_CHARS = 2048
_NAME_CHARS = "[\\p{L}\\p{N}_!#$%&'*+\\-/=?^`{|}~]"
NAMED_ADDRESS_RE = f'^{SPACE}*(?:(?:{_NAME_CHARS}+{SPACE}+)*{_NAME_CHARS}+|"(?:[^"]|")+")?{SPACE}*<([^\\n]+)>{SPACE}*$'


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def category(lower_text: Column) -> Column:
    """First hint group with a substring hit, else ``unknown``."""
    expr = None
    for name, hints in CATEGORY_HINTS:
        hit = contains_any(lower_text, hints)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr.otherwise(F.lit("unknown"))


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def email_is_valid(email: Column) -> Column:
    """Syntax check for an address (X14); null input gives null.

    The branches are taken in order: no pattern sees an over-long address."""
    local = F.substring_index(email, "@", 1)
    domain = F.lower(email_domain(email))
    return (
        F.when(email.isNull(), F.lit(None).cast("boolean"))
        .when(F.length(email) > EMAIL_MAX_CHARS, F.lit(False))
        .when(F.length(local) > LOCAL_MAX_CHARS, F.lit(False))
        .otherwise(email.rlike(VALID_EMAIL_RE) & ~domain.rlike(SPECIAL_DOMAIN_RE))
    )


def normalize_email(email: Column) -> Column:
    """Local part kept, domain lower-cased."""
    return F.concat(F.substring_index(email, "@", 1), F.lit("@"), F.lower(email_domain(email)))


def address_of(email: Column) -> Column:
    """The address in a field that may also hold a display name (X14):
    ``Ann Lee <ann@x.example>`` or ``"Lee, Ann" <ann@x.example>``; else the
    field without white space at its ends.  Over-long fields are left as they are."""
    named = F.regexp_extract(email, NAMED_ADDRESS_RE, 1)
    return (F.when(F.length(email) > NAMED_MAX_CHARS, email)
            .when(email.contains("<") & (named != ""), strip(named)).otherwise(strip(email)))


def found_email(text: Column) -> Column:
    """First e-mail-like token (X5); the regex runs only on texts with '@'."""
    return F.when(text.contains("@"), first_match(text, _EMAIL_SEARCH_RE))


def rule_case(text: Column, lower_text: Column, *, email: Column | None = None,
              in_scope: Column | None = None) -> Column:
    """The case struct the rule-based extractor yields for normalised text.

    ``email`` (the found address) and ``in_scope`` (the gate's verdict) may
    be passed in when the plan already computed them."""
    email = found_email(text) if email is None else email
    in_scope = ~out_of_scope(lower_text) if in_scope is None else in_scope
    name = first_match(text, NAME_RE, 1)
    return F.struct(
        F.nullif(strip(name), F.lit("")).alias("customer_name"),
        normalize_email(email).alias("email"),
        first_match(text, PHONE_RE).alias("phone_number"),
        category(lower_text).alias("complaint_category"),
        F.left(text, F.lit(ISSUE_MAX_CHARS)).alias("issue_description"),
        F.lit(None).cast("string").alias("resolution_provided"),
        in_scope.alias("is_complaint"),
        contains_any(lower_text, ESCALATION_TOKENS).alias("escalation_required"),
        contains_any(lower_text, ATTACHMENT_TOKENS).alias("supporting_document_available"),
        F.lit("open").alias("overall_case_status"),
    )


def rule_email_invalid(email: Column) -> Column:
    """A found e-mail that fails the schema check fails the extraction."""
    return email.isNotNull() & ~email_is_valid(email)
