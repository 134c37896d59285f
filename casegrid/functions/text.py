"""Text columns: decode, normalise, strip, substring tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrid.functions.regex import SPACE, SPACE_NO_NL

# Edge runs of Python whitespace, per line (only LF ends a line) and
# overall, as regexes (used by the DuckDB cross-check).
LINE_EDGE_SPACE = f"(?m)^{SPACE_NO_NL}+|{SPACE_NO_NL}+$"
TEXT_EDGE_SPACE = f"^{SPACE}+|{SPACE}+$"

# The same whitespace as a character set, for Spark's native btrim (a
# code-point set trim, linear in the trimmed edge, no regex engine).
PY_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
PY_SPACE_NO_NL = PY_SPACE_CHARS.replace("\n", "")


def decode_utf8(content: Column) -> Column:
    """Bytes to text; invalid sequences become U+FFFD, never an error."""
    return F.make_valid_utf8(content.cast("string"))


def strip(text: Column) -> Column:
    """Python ``str.strip()``: remove edge Unicode whitespace."""
    return F.btrim(text, F.lit(PY_SPACE_CHARS))


def normalize(text: Column) -> Column:
    """Normalise document text.

    In order: drop NUL; CRLF and CR become LF; runs of spaces/tabs become
    one space; strip every line; three or more LFs become two; strip all.
    Literal replaces and set trims do most of the work; the two regexes run
    only on the lines/texts a byte search shows need them.
    """
    t = F.replace(text, F.lit("\x00"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def clean_line(line: Column) -> Column:
        dirty = line.contains("  ") | line.contains("\t")
        squeezed = F.when(dirty, F.regexp_replace(line, "[ \t]+", " ")).otherwise(line)
        return F.btrim(squeezed, F.lit(PY_SPACE_NO_NL))

    t = F.array_join(F.transform(F.split(t, "\n", -1), clean_line), "\n")
    t = F.when(t.contains("\n\n\n"), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t)
    return strip(t)


def contains_any(lower_text: Column, needles: tuple[str, ...] | list[str]) -> Column:
    """True if any plain substring occurs (X3); byte search, no regex."""
    return reduce(lambda a, b: a | b, [lower_text.contains(n) for n in needles])


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == F.lit(""), F.lit(True))
