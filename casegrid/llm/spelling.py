"""Spelling variants by permuterm rotations.

A word is closed by a terminator and turned round it: of ``w`` all rotations
of ``w`` + END are written.  A replaced, inserted or deleted character comes to
stand last in one of them, so what is before it is a prefix that both words
share: rotations of equal length with an equal prefix are replacements of one
another, and a whole rotation that is itself the prefix is a word with the
character left out.  Rotations are dealt by that prefix, sorted and scanned
group by group.  A group holds at most one word for each character there is,
and the scan emits one row a word (how many neighbours, and the best of them),
no pairs.

Words of more than ``LONG`` code points are not turned as texts, as that grows
with the square of their length: a rotation's prefix is named by the place of
the character and two polynomial hashes (122 bits) of the others, and the word
by a digest, resolved by a join after the scan.

Defined results: null texts have no words; a null ``doc_id`` is written as an
empty text where occurrences are drawn; rows of equal id count one by one; of
neighbours with equal counts the smallest in code-point order comes first; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import bounded_batches, staged

# Letters of a word, the modulus that draws occurrences, least
# length and count of a word, and how many times as frequent a form is.
LETTERS, DRAWN, LEAST_LENGTH, LEAST_COUNT, TIMES = "a-zÀ-ÿ", 31, 7, 2, 10
#: Below all letters, so that a word sorts before its extensions; and the mark of hashed prefixes.
END, HASHED = "\x00", "\x01"
LONG = 256
#: Words counted in a task before they are sent on, and rows of one batch.
KEPT, ROWS = 300_000, 50_000
#: Two prime moduli and bases of polynomial hashes.
_HASHES = (((1 << 61) - 1, 1_000_003), ((1 << 61) - 31, 911_382_323))


def spelled(doc_id, run: str) -> str:
    """The spelling of a run in a document: one code point is left out where
    the checksum of both says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DRAWN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text), counted over all whole texts."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # maximal: the first match takes all of a run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                # bytes.lower() changes A-Z only
                for found, n in Counter(runs.findall((text or b"").lower().decode("utf-8", "replace"))).items():
                    word = spelled(doc, found)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= KEPT:
                    yield flush()
        if counts:
            yield flush()

    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def digest(word: str) -> str:
    return HASHED + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def turned(word: str) -> Iterator[tuple[str, str | None]]:
    """(key, last): every rotation by its prefix and last character, and, with
    no last one, every rotation as a prefix itself."""
    closed = word + END
    for i in range(len(word)):
        yield closed[i + 1:] + closed[:i], closed[i]
    for i in range(len(closed)):
        yield closed[i:] + closed[:i], None


def turned_long(word: str) -> Iterator[tuple[str, str | None]]:
    """The same with hashed keys: the character that follows, the edited
    character's place and hashes of the others."""
    sides = []
    for p, base in _HASHES:
        head, tail, power = [0], [0], 1  # hashes of word[:i], and of word[i:] at its place from the end
        for c in word:
            head.append((head[-1] * base + ord(c) + 1) % p)
        for c in reversed(word):
            tail.append((tail[-1] + (ord(c) + 1) * power) % p)
            power = power * base % p
        sides.append((p, base, head, tail[::-1]))
    n, powers = len(word), [1] * len(sides)
    closed = word + END

    def key(i: int, hashes: list[int]) -> str:
        return f"{HASHED}{closed[i]}{i}:" + ":".join(f"{h:x}" for h in hashes)

    for i in range(n - 1, -1, -1):
        rest = [(head[i] * power + tail[i + 1]) % p for (p, _, head, tail), power in zip(sides, powers, strict=True)]
        yield f"{HASHED}{closed[i + 1]}{i}:" + ":".join(f"{h:x}" for h in rest), word[i]
        powers = [power * base % p for (p, base, _, _), power in zip(sides, powers, strict=True)]
    whole = [head[n] for _, _, head, _ in sides]
    for i in range(n + 1):
        yield key(i, whole), None


def rotations(words: DataFrame) -> DataFrame:
    """(key, last, n, ref) of ``words`` (word, n); ``ref`` names long words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: tuple[list, ...] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()),
                                                                            strict=True)], ["key", "last", "n", "ref"])
            for c in cols:
                c.clear()
            return out

        for b in batches:
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                ways = [(turned(word), None)] if len(word) <= LONG else [(turned_long(word), digest(word))]
                if len(word) == LONG:  # longer words look for it by its hash
                    ways.append(((w for w in turned_long(word) if w[1] is None), digest(word)))
                for way, ref in ways:
                    for key, last in way:
                        for c, x in zip(cols, (key, last, n, ref), strict=True):
                            c.append(x)
                        if len(cols[0]) >= ROWS:
                            yield flush()
        if cols[0]:
            yield flush()

    return words.mapInArrow(run, "key string, last string, n long, ref string")


def _name(rotation: str) -> str:
    """The word of a whole rotation."""
    at = rotation.index(END)
    return rotation[at + 1:] + rotation[:at]


def scan_group(key: str, rows: list[tuple[str | None, int, str | None]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near, best_n, best) of the words of one group.  A character left
    out of a run of equal ones is counted at the run's end only."""
    following = key[1] if key[0] == HASHED else key[0]
    less = next(((n, ref or _name(key)) for last, n, ref in rows if last is None), None)
    # All but the last character agree, so its order is that of the words.
    members = sorted(((-n, last, ref or _name(key + last)) for last, n, ref in rows if last is not None))
    for i, (_, last, word) in enumerate(members):
        other = members[1 if i == 0 else 0] if len(members) > 1 else None
        near, best = len(members) - 1, (other[0], other[2]) if other else None
        if less and last != following:
            near += 1
            if best and best[0] == -less[0]:
                yield word, 0, less[0], less[1]  # a tie is settled by the words themselves
            elif not best or -less[0] < best[0]:
                best = (-less[0], less[1])
        if best:
            yield word, near, -best[0], best[1]
    ends = [m for m in members if m[1] != following] if less else []
    if ends:
        yield less[1], len(ends), -ends[0][0], ends[0][2]


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best): for groups of rotations with a common
    prefix, what they say of each of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "near", "best_n", "best"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        tail = None

        def scan(t: pa.Table) -> pa.RecordBatch | None:
            key = t.column("key").combine_chunks()
            same = np.asarray(pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False), bool)
            keep = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
            if not len(keep):
                return None
            t = t.take(pa.array(keep))
            rows = list(zip(t.column("last").to_pylist(), t.column("n").to_pylist(), t.column("ref").to_pylist(), strict=True))
            keys, out, start = t.column("key").to_pylist(), [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    out.extend(scan_group(keys[start], rows[start:i]))
                    start = i
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([tail, t]) if tail is not None else t
            # The last group may go on in the next batch.
            last = t.column("key")[-1]
            cut = t.num_rows
            while cut and t.column("key")[cut - 1] == last:
                cut -= 1
            tail = t.slice(cut)
            if cut and (out := scan(t.slice(0, cut))) is not None:
                yield out
        if tail is not None and (out := scan(tail)) is not None:
            yield out

    turned_words = rotations(words).repartition("key").sortWithinPartitions("key")
    return turned_words.mapInArrow(run, "word string, near long, best_n long, best string")


def _resolved(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the names of long words in place of their digests."""
    long = words.where(F.length("word") >= LONG).select("word")
    if long.isEmpty():
        return found
    name = F.udf(digest, "string", useArrow=True)  # long words only
    refs = staged(long.select(name("word").alias("ref"), F.col("word").alias("name")), "long-words")
    hashed = F.col("word").startswith(HASHED) | F.col("best").startswith(HASHED)
    some = found.where(hashed)
    for col in ("word", "best"):
        r = refs.select(F.col("ref").alias(col), F.col("name").alias("name__"))
        some = some.join(r, col, "left").withColumn(col, F.coalesce("name__", col)).drop("name__")
    return found.where(~hashed).unionByName(some)


def spelling_groups(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id,
    text): a word's form is its most frequent near word, if that is ``times``
    as frequent; the root is where forms lead."""
    bounded_batches(docs.sparkSession)
    words = staged(word_counts(docs, least_length, least_count), "words")
    found = staged(neighbours(words), "neighbours")
    found = _resolved(found, words)
    none = words.select("word", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"),
                        F.lit(None).cast("string").alias("best"), "n")
    told = found.withColumn("n", F.lit(None).cast("long")).unionByName(none)
    first = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best"))
    told = told.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(first).alias("b"))
    fit = -F.col("b.m") >= times * F.col("n")
    forms = staged(told.select("word", "n", "n_near", F.when(fit, F.col("b.best")).alias("form"), F.when(fit, -F.col("b.m")).alias("form_n")),
                   "forms")
    # Counts grow tenfold with each form, so chains are short; each round doubles the way.
    ways = staged(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = staged(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "ways")
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return (forms.join(ways, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
