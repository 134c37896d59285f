"""Regular-expression pieces that mean the same thing in Java and RE2.

Python's ``str`` regexes are Unicode-aware by default while Java's are
ASCII unless flagged, and the flags differ between engines (``(?U)`` is
"ungreedy" in RE2).  So nothing here uses a flag: character classes are
spelled out with ``\\x{...}`` escapes, which both engines read the same
way.  That lets one pattern string serve the Spark plan and a DuckDB
cross-check alike.
"""

from __future__ import annotations

import re

# Characters Python's str.isspace() accepts (Unicode White_Space plus the
# four information separators U+001C..U+001F).
_SPACE_BODY_NO_NL = (
    r"\t\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE_NO_NL = "[" + _SPACE_BODY_NO_NL + "]"
SPACE = "[\\n" + _SPACE_BODY_NO_NL + "]"

# Python's case-insensitive matching folds four non-ASCII letters onto ASCII
# ones: U+0130 and U+0131 (i), U+017F (s) and U+212A (k).
_FOLD_EXTRAS = {"i": r"\x{130}\x{131}", "s": r"\x{17F}", "k": r"\x{212A}"}
FOLDED_LETTERS = r"A-Za-z\x{130}\x{131}\x{17F}\x{212A}"

DIGIT = r"\p{Nd}"


def ci_literal(word: str) -> str:
    """A case-insensitive pattern for a literal word, without flags."""
    out = []
    for ch in word:
        if ch.isascii() and ch.isalpha():
            low = ch.lower()
            out.append("[" + low + low.upper() + _FOLD_EXTRAS.get(low, "") + "]")
        else:
            out.append(re.escape(ch))
    return "".join(out)


def alternation(literals: tuple[str, ...] | list[str]) -> str:
    return "|".join(re.escape(w) for w in literals)
