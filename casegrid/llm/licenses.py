"""Licence notices, headers and texts by the Dice coefficient of word bigrams.

A whole text is normalised (A-Z lower-cased, runs of other characters than
letters and digits of ASCII, line ends among them, as one space), and the set
of word bigrams of its windows of consecutive words is compared with the
templates'.  Dice = 2 |A and B| / (|A| + |B|) can reach the threshold t only if
|A| lies between t / (2 - t) and (2 - t) / t times |B|; windows have that many
bigrams, and begin and end with one of the template's (cutting off others never
lowers the coefficient).  Every line is a window too, whatever it repeats.

What is passed over cannot match: a window needs the lower bound's number of
the template's bigrams, so a text has one of a few chosen words, that many
bigrams of one template, and that many hits within the upper bound.  Only
built-in functions are used, and each row is judged by itself.

Defined results: null and empty texts, and texts without a window near enough,
have no licence, a coefficient of 0 and no lines; of equal coefficients the
template first in the table wins, then the first window; from left to right,
of windows that overlap the best counts as a match; rows are kept one by one;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.url_filter import ascii_lower

THRESHOLD = 0.8

# Notices by which texts name their licence (SPDX id, notice).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Released under the three clause BSD License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the"
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so, subject to the following conditions:")
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution.")
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.")


def _gnu(name: str, version: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as"
            f" published by the Free Software Foundation, either version {version} of the License, or (at your option) any"
            f" later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
            f" without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}"
            f" for more details.")


def _cc(name: str) -> str:
    return (f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions"
            f" of this Creative Commons {name} 4.0 International Public License (\"Public License\"). To the extent this Public"
            f" License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your"
            f" acceptance of these terms and conditions.")


# Standard headers, and whole texts or, of long ones, a passage of their own.
TEXTS = (
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial"
     " portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING"
     " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
     " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
     " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE"
     " SOFTWARE."),
    ("BSD-2-Clause", f"{_BSD_2} {_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_2}{_BSD_3} {_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
     " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
     " required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\""
     " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
     " governing permissions and limitations under the License."),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the"
     " GNU General Public License, supplemented by the additional permissions listed below."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
     " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", _cc("Attribution")),
    ("CC-BY-SA-4.0", _cc("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", _cc("Attribution-NonCommercial")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

# Words too common in prose to tell that a text may hold a licence.
_COMMON = frozenset(
    "a all and any are as at be but by can for from if in is it its may new no not of on one or other out see shall that the"
    " this to under use was will with without work you your 1 2 3 4 0".split())

def words_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of a set that can reach the threshold against one of ``n``."""
    sizes = [a for a in range(1, int(n * (2 / threshold)) + 2) if 2.0 * min(a, n) / (a + n) >= threshold]
    return min(sizes), max(sizes)



def cue_words(sets: list[tuple[list[str], int]]) -> list[str]:
    """Words of which any text has one that holds ``need`` bigrams of one of
    the ``sets`` (bigrams, need): those without a cue are fewer."""
    left = [set(grams) for grams, _ in sets]
    chosen: list[str] = []
    while short := [(g, need) for g, (_, need) in zip(left, sets, strict=True) if len(g) >= need]:
        gain = Counter(w for g, _ in short for gram in g for w in set(gram.split(" ")))
        best = min(gain, key=lambda w: (w in _COMMON, -gain[w], w))
        chosen.append(best)
        left = [{gram for gram in g if best not in gram.split(" ")} for g in left]
    return chosen


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dice(g: Column, t: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(g, t["b"])) / (F.size(F.array_distinct(g)) + F.size(t["b"]))


def _windows(g: Column, t: Column, threshold: float) -> Column:
    """Of every place of the bigrams ``g`` where a window near enough to the
    template begins: (at, worse, no, len) of the best one there, ``worse`` being
    the coefficient with its sign turned."""

    def of_hits(h: Column) -> Column:
        def near(p: Column, k: Column) -> Column:
            ends = F.filter(F.slice(h, k + t["low"], t["high"] - t["low"] + 1), lambda e: e - p < t["high"])
            each = F.transform(ends, lambda e: F.struct(
                (-_let(F.slice(g, p + 1, e - p + 1), lambda s: _dice(s, t))).alias("worse"), (e - p + 1).alias("len")))
            return _let(F.array_min(each), lambda b: F.struct(
                p.alias("at"), b["worse"].alias("worse"), t["no"].alias("no"), b["len"].alias("len")))

        return F.filter(F.transform(h, near), lambda m: m["worse"] <= -threshold)

    hits = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(t["b"], x), i)), lambda i: i.isNotNull())
    return F.when(F.size(F.array_intersect(g, t["b"])) >= t["low"], _let(hits, of_hits)).otherwise(
        F.array().cast("array<struct<at:int,worse:double,no:int,len:int>>"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + TEXTS,
         threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, line_no, n_lines): the best notice of each text,
    the line in which it begins (from 1), and in how many lines matches begin."""
    sets = [(name, bigrams_of(text)) for name, text in templates]
    sets = [(name, grams, *bounds(len(grams), threshold)) for name, grams in sets if grams]
    table = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(b).alias("b"))
                      for i, (_, b, low, high) in enumerate(sets)])
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    cue = F.lit(False)
    for word in cue_words([(b, low) for _, b, low, _ in sets]):
        cue = cue | F.col("padded").contains(f" {word} ")
    may = (docs.select("doc_id", "text", F.concat(F.lit(" "), plain, F.lit(" ")).alias("padded"))
           .select("doc_id", F.when(cue, F.col("text")).alias("text"), F.when(cue, F.split(F.trim("padded"), " ")).alias("w")))
    sizes = F.transform(F.split("text", "\n"), lambda x: F.size(F.filter(
        F.split(F.regexp_replace(ascii_lower(x), "[^a-z0-9]+", " "), " "), lambda w: w != "")))
    grams = F.transform(F.slice("w", 1, F.size("w") - 1), lambda w, i: F.concat(w, F.lit(" "), F.get("w", i + 1)))
    rows = may.select("doc_id", grams.alias("g"), F.flatten(F.transform(
        sizes, lambda n, i: F.array_repeat(i + 1, n))).alias("line_of"))
    # (line_no, at, n): each line's first word and number of words.
    ends = F.col("line_of")
    starts = F.filter(F.transform(ends, lambda x, i: F.when((i == 0) | (x != F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "g", "line_of", starts.alias("starts"))
    least = min(s[2] for s in sets)
    lines = F.filter(F.transform("starts", lambda p, i: F.struct(
        p.alias("at"), (F.coalesce(F.get("starts", i + 1), F.size("line_of")) - p - 1).alias("len"))), lambda x: x["len"] >= least)

    def whole_line(x: Column) -> Column:
        return _let(F.slice("g", x["at"] + 1, x["len"]), lambda s: _let(F.size(F.array_distinct(s)), lambda n: F.transform(
            F.filter(F.col("table"), lambda t: n.between(t["low"], t["high"])),
            lambda t: F.struct(x["at"].alias("at"), (-_dice(s, t)).alias("worse"), t["no"].alias("no"), x["len"].alias("len")))))

    rows = rows.select("doc_id", "g", "line_of", lines.alias("lines"), table.alias("table"))
    found = F.concat(F.flatten(F.transform("table", lambda t: _windows(F.col("g"), t, threshold))),
                     F.filter(F.flatten(F.transform("lines", whole_line)), lambda m: m["worse"] <= -threshold))
    rows = rows.select("doc_id", "line_of", F.array_sort(found).alias("found"))

    def line(m: Column) -> Column:
        return F.get("line_of", m["at"])

    def counted(acc: Column, m: Column) -> Column:
        """(end, worse, line, done, n): the match at hand, and the last line
        counted before it."""
        mine = [(m["at"] + m["len"]).alias("end"), m["worse"].alias("worse"), line(m).alias("line")]
        kept = [acc["done"].alias("done"), acc["n"].alias("n")]
        passed = [acc["line"].alias("done"), (acc["n"] + (acc["line"] != acc["done"]).cast("int")).alias("n")]
        return (F.when(m["at"] > acc["end"], F.struct(*mine, *passed))
                .when(m["worse"] < acc["worse"], F.struct(*mine, *kept)).otherwise(acc))

    none = F.struct(F.lit(-1).alias("end"), F.lit(0.0).alias("worse"), F.lit(0).alias("line"), F.lit(0).alias("done"), F.lit(0).alias("n"))
    n_lines = F.aggregate("found", none, counted, lambda a: a["n"] + (a["line"] != a["done"]).cast("int"))
    top = F.array_min(F.transform("found", lambda m: F.struct(m["worse"].alias("worse"), m["no"].alias("no"), m["at"].alias("at"))))
    names = F.lit([s[0] for s in sets])
    return (rows.select("doc_id", "line_of", n_lines.alias("n_lines"), top.alias("top"))
            .select("doc_id", F.get(names, F.col("top.no")).alias("license"), F.coalesce(-F.col("top.worse"), F.lit(0.0)).alias("dice"),
                    F.get("line_of", F.col("top.at")).alias("line_no"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")))
