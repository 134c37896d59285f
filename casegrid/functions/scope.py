"""Scope gate (F4): keep complaints, drop injections and off-task requests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column

from casegrid.functions.patterns import COMPLAINT_CUES, INJECTION_PATTERNS, OFF_TASK_PATTERNS
from casegrid.functions.text import contains_any

INJECTION_RE = "|".join(INJECTION_PATTERNS)
OFF_TASK_RE = "|".join(OFF_TASK_PATTERNS)


def _required_literal(pattern: str) -> str:
    """The literal text every match of ``pattern`` starts with."""
    m = re.match(r"[a-z ]+", pattern)
    return m.group(0) if m else ""


def _any_pattern(lower_text: Column, patterns: tuple[str, ...]) -> Column:
    """``rlike`` per pattern, each behind a byte search for its required
    literal prefix, so the regex engine only runs on candidate texts."""
    tests = [lower_text.contains(_required_literal(p)) & lower_text.rlike(p) for p in patterns]
    return reduce(lambda a, b: a | b, tests)


def has_complaint_cue(lower_text: Column) -> Column:
    return contains_any(lower_text, COMPLAINT_CUES)


def out_of_scope(lower_text: Column) -> Column:
    """True when no complaint cue is present and an injection or off-task
    pattern is.  A cue anywhere keeps the text in scope; so does the
    absence of every pattern.  The cue test runs first and short-circuits
    the two regex scans."""
    return ~has_complaint_cue(lower_text) & (
        _any_pattern(lower_text, INJECTION_PATTERNS) | _any_pattern(lower_text, OFF_TASK_PATTERNS)
    )
