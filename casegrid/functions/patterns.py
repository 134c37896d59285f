"""Word lists and patterns the triage rules are defined by.

Fixed values: these must equal the rules being reproduced, so they are
written out plainly, in their natural order, in one place.
"""

# --- fixed values ---------------------------------------------------------
# Complaint cues: any one of them as a plain substring keeps a text in scope.
COMPLAINT_CUES = (
    "complaint",
    "refund",
    "invoice",
    "charged",
    "delivery",
    "order",
    "package",
    "billing",
    "account",
    "ticket",
    "customer",
    "broken",
    "defective",
    "warranty",
    "subscription",
    "never arrived",
    "late delivery",
)

# Instruction-injection patterns (regular expressions over lower-cased text).
INJECTION_PATTERNS = (
    r"ignore (all )?(previous|prior|above) (instructions|prompts)",
    r"disregard (the )?(system|previous) (prompt|instructions)",
    r"you are now",
    r"reveal your (system |hidden )?prompt",
    r"jailbreak",
    r"system prompt",
)

# Off-task request patterns (regular expressions over lower-cased text).
OFF_TASK_PATTERNS = (
    r"write (me )?(a |some )?(python |javascript |java |rust )?code",
    r"implement (a |an )",
    r"solve this (leetcode|algorithm|puzzle)",
    r"act as (a )?(linux |hacker|shell)",
)

# Category hints in priority order; the first group with a hit wins.
CATEGORY_HINTS = (
    ("billing", ("invoice", "charg", "refund", "billing", "subscription")),
    ("delivery", ("deliver", "package", "shipping", "tracking")),
    ("product_quality", ("crack", "defect", "quality", "broken", "mug")),
    ("service", ("hold", "callback", "service", "ticket")),
    ("account_access", ("login", "password", "account access", "locked out")),
)

ESCALATION_TOKENS = ("urgent", "second", "never received")
ATTACHMENT_TOKENS = ("attach", "photo", "enclosed")

ISSUE_MAX_CHARS = 1000
NAME_MAX_TAIL = 80  # name = one letter + 1..80 of letters, space, . ' -

EMAIL_SUBJECT_PREFIX = "# Subject:"
SUMMARY_HEADINGS = ("## Overview", "## Issue", "## Action", "## Status", "## Next action")

# Special-use domain names an e-mail address may not end in.
SPECIAL_USE_DOMAINS = ("arpa", "invalid", "local", "localhost", "onion", "test")

# Contact patterns, as Python regular expressions (Unicode str semantics).
EMAIL_PATTERN = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"  # case-insensitive
PHONE_PATTERN = r"\+\d[\d\- ]{8,}\d"
NAME_PATTERN = r"(?:customer|from)\s*:\s*([A-Za-z][A-Za-z .'-]{1,80})"  # case-insensitive
# --------------------------------------------------------------------------
# The Spark plan cannot use these strings as they are: Python's \d and \s
# are Unicode-aware and its case-insensitive matching folds four non-ASCII
# letters onto ASCII ones, while Java regex and RE2 differ on both.
# functions/extract.py spells the same patterns out with explicit classes
# (functions/regex.py); tests compare the two forms on edge strings.
