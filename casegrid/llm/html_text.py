"""Main text of web pages from flat text blocks and a trained decision tree.

A page is cut at block-level tags into flat blocks.  A block's features are
its word count and link density, those of the block before and after it,
whether it lies in an article element or in an element for something else,
whether it is a heading, and what its part's name says: a class, id or role
with a noise word hints at something else the more, the less of the page's text
lies under that word (a word around most of the text names a wrapper).  Names
of article and main elements, and of what lies around them, say nothing.  A
small decision tree, grown here from a labelled table, decides which blocks are
main text; no block is judged by position or cut.

Defined results: null or empty html gives an empty text and 0 characters;
markup that never closes ends at the page's end; character references are
decoded once, by HTML's rules; rows and ids are kept as they are (null, equal
or not); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import bounded_batches

# HTML element names by role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
SKIP = frozenset("svg math select button object canvas audio video head datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("nav aside footer form menu dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts by name that hold articles of their own (replies, teasers).
HOLDERS = frozenset("comment comments commentlist disqus related promo promoted promotion sponsor sponsored".split())
#: First words of names that say what a part has or lacks, not what it is.
HAVING = frozenset("has have having no not non with without is".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead title tr ul".split())
#: Words of a class, id or role that mark a part as no main text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent"
    " cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo promoted"
    " promotion related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_HINT = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_FIRST = re.compile(r"[a-z]+(?=[-_])")
_SPACE = re.compile(r"\s+")


def _tag_end(page: str, at: int, gone: dict[str, bool]) -> int:
    """Index after the tag's ``>``; quoted values may hold one.  A quote that
    never closes is an ordinary character (``gone`` remembers that)."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return len(page)
        at, c = m.end(), m.group()
        if c == ">":
            return at
        if not gone[c]:
            close = page.find(c, at)
            if close < 0:
                gone[c] = True
            else:
                at = close + 1


def _hints(tag: str) -> frozenset[str]:
    """Noise words in the class, id and role of a tag."""
    names = [n for h in _HINT.findall(tag) for n in h.lower().strip("\"'").split()]
    found = {w for n in names if not ((m := _FIRST.match(n)) and m.group() in HAVING) for w in _WORDS.findall(n)}
    return NOISE_WORDS & found


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, frozenset[str]]]:
    """(text, words, words in links, in article, in noise, is heading, noise
    words of names around it) of each flat block."""
    out: list[tuple[str, int, int, bool, bool, bool, frozenset[str]]] = []
    text: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, frozenset[str]]] = []  # name, is main, is noise, hints around it
    open_ = Counter()
    state = {"main": 0, "noise": 0, "skip": 0, "link": 0, "heading": 0}
    hints: frozenset[str] = frozenset()
    gone = {"'": False, '"': False}
    unclosed: set[str] = set()

    def flush() -> None:
        if not text:
            return
        body = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in text))).strip()
        if body:
            linked = sum(len(entities.unescape(t).split()) for t, in_link in text if in_link)
            out.append((body, len(body.split()), linked, state["main"] > 0, state["noise"] > 0, state["heading"] > 0, hints))
        text.clear()

    def close(name: str) -> None:
        nonlocal hints
        while stack:
            top, main, noise, hints = stack.pop()
            open_[top] -= 1
            state["main"] -= main
            state["noise"] -= noise
            state["skip"] -= top in SKIP
            state["heading"] -= top in HEADINGS
            if top == name:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not state["skip"]:
            text.append((page[at:lt], state["link"] > 0))
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        shut = page.startswith("</", lt)
        m = _NAME.match(page, lt + 1 + shut)
        if m is None:  # a "<" that opens no tag is text
            if not state["skip"]:
                text.append(("&lt;", state["link"] > 0))
            at = lt + 1
            continue
        name = m.group().lower()
        at = _tag_end(page, m.end(), gone)
        if name in BLOCK:
            flush()
        elif name in ("br", "wbr") and not state["skip"]:
            text.append((" ", False))
        if shut:
            if name == "a":
                state["link"] = 0
            if open_[name] > 0:
                close(name)
            continue
        if name in RAW:
            # Its content is text of its own kind, up to its end tag.
            end = None if name in unclosed else re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(page, at)
            if end is None:
                unclosed.add(name)
                at = n
            else:
                at = _tag_end(page, end.end(), gone)
            continue
        if name == "a":
            state["link"] = 1
            continue
        if name in VOID or page[at - 2:at] == "/>":
            continue
        if name not in BLOCK and name not in SKIP:
            continue
        if name in BLOCK and stack and stack[-1][0] == "p":
            close("p")
        if name in ("li", "dd", "dt", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
            close(name)
        if name in BLOCK:
            state["link"] = 0
        noise = name in NOISE or (name == "header" and not state["main"])
        main = name in MAIN
        stack.append((name, main, noise, hints))
        if main:  # where the main text opens, names around it were a wrapper's
            hints = hints if state["main"] else hints & HOLDERS
        elif name not in ("html", "body"):  # a theme's class on the page itself says nothing of a part
            hints |= _hints(page[m.end():at])
        open_[name] += 1
        state["main"] += main
        state["noise"] += noise
        state["skip"] += name in SKIP
        state["heading"] += name in HEADINGS
    flush()
    return out


# Labelled blocks: words and link density of the block before, of the block
# itself and of the block after; in article; in noise; main text or not.
_PLAIN = np.array([
    # running text of an article, long and short, headings, lists, last lines
    (0, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1), (9, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1), (60, 0.0, 1, 0.0, 2, 0.0, 1, 0, 1),
    (1, 0.0, 2, 0.0, 30, 0.0, 1, 0, 1), (6, 1.0, 12, 0.0, 80, 0.0, 1, 0, 1), (80, 0.0, 1, 0.0, 0, 0.0, 1, 0, 1),
    (40, 0.0, 5, 1.0, 40, 0.0, 1, 0, 1), (300, 0.0, 250, 0.1, 9, 0.5, 1, 0, 1), (0, 0.0, 1, 0.0, 0, 0.0, 1, 0, 1),
    (25, 0.0, 18, 0.4, 30, 0.0, 1, 0, 1), (3, 0.0, 4, 0.0, 5, 0.0, 1, 0, 1), (1, 1.0, 2, 0.0, 8, 0.2, 1, 0, 1),
    (3, 0.0, 1, 0.0, 3, 0.3, 1, 0, 1), (4, 1.0, 3, 0.0, 2, 0.5, 1, 0, 1), (2, 1.0, 1, 0.0, 1, 0.0, 1, 0, 1),
    (5, 0.0, 2, 1.0, 3, 0.0, 1, 0, 1), (0, 0.0, 6, 0.0, 4, 0.0, 1, 0, 1), (12, 0.0, 7, 0.0, 0, 0.0, 1, 0, 1),
    (1, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1), (6, 1.0, 150, 0.0, 2, 1.0, 1, 0, 1), (2, 0.0, 4, 0.5, 0, 0.0, 1, 0, 1),
    (45, 0.0, 3, 0.0, 60, 0.0, 1, 0, 1), (7, 1.0, 7, 1.0, 7, 1.0, 1, 0, 1), (30, 0.1, 11, 0.0, 4, 1.0, 1, 0, 1),
    # parts marked as something else, in an article or out of it
    (90, 0.0, 30, 0.0, 12, 0.0, 1, 1, 0), (30, 0.0, 55, 0.0, 70, 0.0, 1, 1, 0), (70, 0.0, 4, 1.0, 4, 1.0, 1, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (0, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0), (6, 1.0, 40, 0.0, 10, 0.0, 0, 1, 0),
    (50, 0.0, 8, 0.1, 0, 0.0, 0, 1, 0), (8, 0.0, 120, 0.0, 60, 0.0, 0, 1, 0), (2, 0.0, 25, 0.2, 90, 0.0, 0, 1, 0),
    (60, 0.0, 3, 0.0, 0, 0.0, 1, 1, 0), (40, 0.0, 45, 0.0, 50, 0.0, 0, 1, 0), (35, 0.0, 200, 0.1, 60, 0.0, 1, 1, 0),
    (90, 0.0, 20, 0.0, 55, 0.0, 1, 1, 0), (5, 0.0, 15, 0.0, 30, 0.0, 1, 1, 0), (12, 0.0, 60, 0.0, 9, 0.0, 1, 1, 0),
    (22, 0.2, 75, 0.0, 41, 0.0, 0, 1, 0), (64, 0.0, 33, 0.1, 27, 0.1, 0, 1, 0), (48, 0.0, 17, 0.0, 52, 0.0, 0, 1, 0),
    # pages without an article element: running text between other blocks
    (20, 0.0, 45, 0.0, 38, 0.0, 0, 0, 1), (45, 0.0, 22, 0.1, 50, 0.0, 0, 0, 1), (60, 0.0, 16, 0.0, 44, 0.0, 0, 0, 1),
    (7, 0.0, 70, 0.0, 4, 0.0, 0, 0, 1), (33, 0.1, 90, 0.2, 28, 0.0, 0, 0, 1), (80, 0.0, 12, 0.0, 66, 0.0, 0, 0, 1),
    (5, 0.5, 55, 0.1, 61, 0.0, 0, 0, 1), (48, 0.0, 19, 0.0, 3, 1.0, 0, 0, 1), (50, 0.0, 6, 0.0, 60, 0.0, 0, 0, 1),
    (62, 0.0, 8, 0.0, 48, 0.1, 0, 0, 1), (44, 0.0, 3, 0.0, 90, 0.0, 0, 0, 1), (70, 0.1, 5, 0.0, 41, 0.0, 0, 0, 1),
    (120, 0.0, 2, 0.0, 77, 0.0, 0, 0, 1), (39, 0.0, 7, 0.1, 52, 0.0, 0, 0, 1), (2, 1.0, 64, 0.0, 70, 0.0, 0, 0, 1),
    (1, 1.0, 45, 0.1, 50, 0.0, 0, 0, 1), (3, 0.0, 80, 0.0, 62, 0.0, 0, 0, 1), (0, 0.0, 55, 0.0, 48, 0.0, 0, 0, 1),
    (66, 0.0, 70, 0.0, 1, 1.0, 0, 0, 1), (40, 0.0, 36, 0.0, 0, 0.0, 0, 0, 1), (0, 0.0, 41, 0.0, 0, 0.0, 0, 0, 1),
    (2, 1.0, 30, 0.0, 25, 0.0, 0, 0, 1), (3, 1.0, 24, 0.1, 2, 1.0, 0, 0, 1), (4, 0.0, 27, 0.0, 5, 0.0, 0, 0, 1),
    # pages without an article element: links, labels, legal lines
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (1, 1.0, 5, 0.9, 6, 1.0, 0, 0, 0), (0, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0),
    (3, 1.0, 7, 0.0, 2, 1.0, 0, 0, 0), (9, 0.6, 14, 0.8, 30, 0.0, 0, 0, 0), (40, 0.0, 6, 1.0, 5, 1.0, 0, 0, 0),
    (6, 0.0, 8, 0.1, 0, 0.0, 0, 0, 0), (4, 0.0, 5, 0.0, 6, 0.0, 0, 0, 0), (30, 0.0, 25, 0.7, 20, 0.6, 0, 0, 0),
    (2, 0.0, 9, 0.0, 4, 0.4, 0, 0, 0), (58, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0), (70, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0),
    (95, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0), (50, 0.1, 4, 0.0, 6, 0.0, 0, 0, 0), (2, 1.0, 2, 0.0, 55, 0.0, 0, 0, 0),
    (33, 0.0, 18, 1.0, 21, 0.9, 0, 0, 0), (75, 0.0, 30, 0.6, 28, 0.1, 0, 0, 0), (60, 0.0, 26, 0.5, 44, 0.0, 0, 0, 0),
    (3, 1.0, 3, 1.0, 80, 0.0, 0, 0, 0), (0, 0.0, 1, 0.0, 40, 0.0, 0, 0, 0),
], dtype=float)
# The same, with is heading and follows a heading before the label.
_MORE = np.array([
    # headings before running text, long or short; before links or nothing; linked ones
    (0, 0.0, 1, 0.0, 40, 0.0, 0, 0, 1, 0, 1), (2, 1.0, 2, 0.0, 55, 0.0, 0, 0, 1, 0, 1), (3, 1.0, 5, 0.0, 9, 0.0, 0, 0, 1, 0, 1),
    (60, 0.0, 3, 0.0, 12, 0.1, 0, 0, 1, 0, 1), (14, 0.0, 2, 0.0, 5, 0.0, 0, 0, 1, 0, 1), (40, 0.0, 4, 0.0, 30, 0.2, 0, 0, 1, 0, 1),
    (30, 0.0, 1, 0.0, 2, 1.0, 0, 0, 1, 0, 0), (60, 0.0, 2, 0.0, 5, 1.0, 0, 0, 1, 0, 0), (3, 1.0, 2, 0.0, 1, 1.0, 0, 0, 1, 0, 0),
    (5, 0.0, 2, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (8, 0.0, 2, 0.0, 25, 0.9, 0, 0, 1, 0, 0), (40, 0.0, 5, 1.0, 50, 0.0, 0, 0, 1, 0, 0),
    (3, 1.0, 3, 1.0, 80, 0.0, 0, 0, 1, 0, 0), (0, 0.0, 2, 0.0, 3, 0.0, 1, 0, 1, 0, 1), (3, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1, 0, 1),
    (5, 0.0, 3, 0.0, 40, 0.0, 0, 1, 1, 0, 0), (5, 0.0, 3, 0.0, 40, 0.0, 1, 1, 1, 0, 0),
    (25, 0.0, 3, 0.0, 6, 0.0, 0, 0, 1, 0, 1), (0, 0.0, 4, 0.0, 7, 0.1, 0, 0, 1, 0, 1), (3, 1.0, 1, 0.0, 5, 0.0, 0, 0, 1, 0, 1),
    (2, 1.0, 6, 0.0, 6, 0.0, 0, 0, 1, 0, 1), (9, 0.0, 2, 0.0, 4, 0.0, 0, 0, 1, 0, 1), (70, 0.0, 5, 0.0, 7, 0.0, 0, 0, 1, 0, 1),
    (3, 0.0, 3, 0.0, 18, 0.0, 0, 0, 1, 1, 1), (6, 0.0, 2, 0.0, 5, 0.0, 0, 0, 1, 1, 1), (1, 0.0, 4, 0.0, 66, 0.0, 0, 0, 1, 1, 1),
    # labels of few words before text that are no headings
    (1, 1.0, 1, 0.0, 48, 0.0, 0, 0, 0, 0, 0), (0, 0.0, 3, 0.0, 62, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 4, 0.0, 33, 0.0, 0, 0, 0, 0, 0),
    # headings of an article, whatever follows
    (5, 0.0, 3, 0.0, 0, 0.0, 1, 0, 1, 0, 1), (2, 1.0, 4, 0.0, 6, 1.0, 1, 0, 1, 0, 1), (30, 0.0, 2, 0.0, 1, 0.0, 1, 0, 1, 0, 1),
    (8, 0.0, 6, 1.0, 60, 0.0, 1, 0, 1, 0, 1), (0, 0.0, 5, 0.0, 1, 1.0, 1, 0, 1, 0, 1), (3, 0.0, 3, 0.5, 20, 0.9, 1, 0, 1, 0, 1),
    (60, 0.0, 2, 0.0, 5, 1.0, 1, 0, 1, 0, 1), (5, 0.0, 2, 0.0, 0, 0.0, 1, 0, 1, 0, 1), (3, 0.0, 4, 1.0, 3, 1.0, 1, 0, 1, 1, 1),
    # after a heading: in an article; short text; links
    (2, 0.0, 30, 0.0, 40, 0.0, 1, 0, 0, 1, 1), (3, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1, 1), (1, 0.0, 1, 0.0, 0, 0.0, 1, 0, 0, 1, 1),
    (4, 0.0, 12, 0.9, 5, 0.0, 1, 0, 0, 1, 1), (5, 0.0, 40, 0.0, 9, 0.0, 1, 1, 0, 1, 0), (2, 0.0, 4, 1.0, 3, 1.0, 0, 1, 0, 1, 0),
    (3, 0.0, 20, 0.0, 30, 0.0, 0, 1, 0, 1, 0), (1, 0.0, 6, 0.1, 0, 0.0, 0, 1, 0, 1, 0),
    (7, 0.0, 6, 0.0, 8, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 5, 0.0, 3, 0.0, 0, 0, 0, 1, 1), (6, 0.0, 8, 0.1, 0, 0.0, 0, 0, 0, 1, 1),
    (9, 0.0, 4, 0.0, 12, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 7, 0.0, 4, 0.0, 0, 0, 0, 1, 1), (8, 0.0, 9, 0.0, 2, 1.0, 0, 0, 0, 1, 1),
    (2, 0.0, 12, 0.0, 9, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 6, 0.0, 60, 0.0, 0, 0, 0, 1, 1), (1, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 1, 1),
    (3, 0.0, 5, 0.0, 15, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 9, 0.1, 0, 0.0, 0, 0, 0, 1, 1), (2, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 1, 0),
    (1, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1, 0), (3, 0.0, 25, 0.8, 4, 1.0, 0, 0, 0, 1, 0),
    # short paragraphs in a row
    (12, 0.0, 10, 0.0, 9, 0.0, 0, 0, 0, 0, 1), (10, 0.0, 14, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 11, 0.0, 3, 0.0, 0, 0, 0, 0, 1),
    (11, 0.0, 12, 0.1, 16, 0.0, 0, 0, 0, 0, 1), (13, 0.0, 12, 0.0, 2, 0.0, 0, 0, 0, 0, 1),
], dtype=float)


def _labelled() -> np.ndarray:
    def hinted(rows: np.ndarray, hint: float) -> np.ndarray:
        rows = rows.copy()
        rows[:, 7] = hint
        return rows

    rows = np.vstack([np.hstack([_PLAIN[:, :8], np.zeros((len(_PLAIN), 2)), _PLAIN[:, 8:]]), _MORE])
    noise = rows[rows[:, 7] == 1]
    # A name around nearly all of the text says nothing, one around little of
    # it what a noise element does, in an article one around half of it too.
    return np.vstack([rows, hinted(rows[rows[:, 7] == 0], 0.1), hinted(noise, 0.9), hinted(noise[noise[:, 6] == 1], 0.4)])


#: Places of the features "is a heading" and "follows a heading".
HEADING, AFTER = 8, 9
#: Labelled blocks with all features.
LABELLED = _labelled()


def grow_tree(rows: np.ndarray, depth: int = 6):
    """A tree each for headings, blocks after one and other blocks."""
    heading, after = rows[:, HEADING] > 0.5, rows[:, AFTER] > 0.5
    others = AFTER, 0.5, _grow(rows[~heading & ~after], depth), _grow(rows[~heading & after], depth)
    return HEADING, 0.5, others, _grow(rows[heading], depth)


def _grow(rows: np.ndarray, depth: int):
    """Decision tree (feature, threshold, low, high) or a label, by Gini
    impurity; ties go to the first feature and the lowest threshold."""
    x, y = rows[:, :-1], rows[:, -1]
    if depth == 0 or len(set(y)) == 1:
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            score = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut, low)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut, low = best
    return f, float(cut), _grow(rows[low], depth - 1), _grow(rows[~low], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, cut, low, high = tree
    side = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[side], out[~side] = classify(low, x[side]), classify(high, x[~side])
    return out


def _hint(found: list) -> np.ndarray:
    """Of each block, what the noise words of names around it hint: 0 without
    any, else the share of the text (words outside links and noise elements,
    of the article's if it is in one) that does not lie under its rarest word.
    Outside an article, on a page that has one, that is all."""
    total, under = Counter(), Counter()
    for _, n, linked, main, noise, _, hints in found:
        if not noise:
            total[main] += n - linked
            under.update({(main, w): n - linked for w in hints})
    return np.array([0.0 if not b[6] else 1.0 if total[True] and not b[3] else
                     1.0 - min(under[b[3], w] for w in b[6]) / max(1, total[b[3]]) for b in found])


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found], float) / words
    main, noise, heading = (np.array([b[i] for b in found]) for i in (3, 4, 5))
    before = lambda a: np.concatenate([[0.0], a[:-1]])
    after = lambda a: np.concatenate([a[1:], [0.0]])
    words_after, density_after = after(words), after(density)
    # What a heading stands before is the next block that is none, in the same part.
    following = None
    for i in range(len(found) - 1, -1, -1):
        if not heading[i]:
            following = i
            continue
        there = following is not None and main[following] == main[i] and noise[following] == noise[i]
        words_after[i], density_after[i] = (words[following], density[following]) if there else (0.0, 0.0)
    x = np.column_stack([before(words), before(density), words, density, words_after, density_after,
                         main, np.maximum(noise, _hint(found)), heading, before(heading)])
    return "\n\n".join(b[0] for b, keep in zip(found, classify(tree, x), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    tree = grow_tree(LABELLED)

    @F.arrow_udf("string")
    def text_of(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py(), tree) for h in html], pa.string())

    return pages.select("page_id", "url", text_of("html").alias("text"))
