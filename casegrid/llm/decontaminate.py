"""Benchmark passages in documents, by a distributed positional inverted index.

Items are cut into windows of consecutive words (a shorter item is one
window).  The corpus is read once for the frequencies of the benchmark's
words; then, for the rarest words of each window, positional postings
(term, document, position) are written to the shared folder, in shards by
document, sorted by term.  A window is looked up by intersecting its rarest
terms' lists after taking off each term's place in the item: the documents and
starts at which all of them agree.  Those are compared word for word with the document, which
gives the exact phrase matches.  Where no phrase stands, but the starts of the
terms lie in the same or neighbouring cells of ``slack + 1`` words, there is a
proximity match, for which the terms of a window that the corpus has are enough
if they are as many as are looked up.

Defined results: words are runs of ASCII letters and digits and of all other
characters beyond ASCII, A-Z lower-cased; null and empty texts have no words;
an item without words has no windows and matches nothing; a repeated item
matches like its copy under its own id; rows of equal ``doc_id`` are judged
each by its own text; a null ``doc_id`` is kept; an empty benchmark or table
gives no matches; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.llm.common import bounded_batches, give_back, null_safe, pick, row_key, staged, trimmed

WINDOW, RAREST, SLACK = 13, 3, 5
#: Terms of one pass over the corpus (a Python set in each worker); a larger
#: benchmark vocabulary is taken in several passes.
TERMS = 1_000_000

# Every ASCII byte but letters and digits becomes a space.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_PLAIN).split()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of the items with words, as one text with spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, b" ".join(words_of(t))) for i, t in zip(b.column("item_id").to_pylist(), _texts(b), strict=True)]
            got = [(i, w) for i, w in got if w]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.string()),
                                              pa.array([w for _, w in got], pa.binary()).cast(pa.string())], ["item_id", "words"])

    return staged(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
                  .mapInArrow(trimmed(run), "item_id string, words string").distinct(), "items")


def _slices(terms: DataFrame) -> Iterator[frozenset[bytes]]:
    """The distinct terms (a column ``term``) in sets of at most about TERMS."""
    distinct = staged(terms.select("term").distinct(), "terms")
    n = -(-distinct.count() // TERMS)
    for i in range(n):
        part = distinct.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i)
        yield frozenset(r["term"].encode() for r in part.toLocalIterator())


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms occurs in the corpus."""

    def counted(vocabulary: frozenset[bytes]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for b in batches:
                for t in _texts(b):
                    seen.update(filter(vocabulary.__contains__, words_of(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()),
                                              pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        return docs.select("text").mapInArrow(trimmed(run), "term string, n long")

    out = docs.sparkSession.range(0).selectExpr("'' AS term", "id AS n")
    for vocabulary in _slices(terms):
        out = out.unionByName(counted(vocabulary))
    return out.groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, key, position) of the terms in ``docs`` (doc_id, key,
    text), written to the shared folder."""

    def listed(vocabulary: frozenset[bytes]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                term, row, position = [], [], []
                for r, t in enumerate(_texts(b)):
                    for p, w in enumerate(words_of(t)):
                        if w in vocabulary:
                            term.append(w)
                            row.append(r)
                            position.append(p)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term, pa.binary()).cast(pa.string()), b.column("doc_id").take(rows), b.column("key").take(rows),
                     pa.array(position, pa.int32())], ["term", "doc_id", "key", "position"])

        return docs.select("doc_id", "key", "text").mapInArrow(trimmed(run), "term string, doc_id long, key long, position int")

    out = docs.sparkSession.range(0).selectExpr("'' AS term", "id AS doc_id", "id AS key", "0 AS position")
    for vocabulary in _slices(terms):
        out = out.unionByName(listed(vocabulary))
    # Shards by document: a frequent term's list is spread over all of them.
    return staged(out.repartition("key").sortWithinPartitions("term", "doc_id", "position"), "postings")


def lookups(items: DataFrame, counts: DataFrame, window: int, rarest: int, partly: bool = False) -> DataFrame:
    """Of each distinct item text (words): the places to look up, and its
    windows as (first place, length, whether the corpus has all terms, places
    of its rarest terms).  A window with a term that the corpus lacks is left
    out, with ``partly`` only if too few terms remain to look up."""
    texts = items.select("words").distinct().withColumn("w", F.split("words", " "))
    n = F.least(F.size("w"), F.lit(window))
    windows = texts.select("words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("first"))
    terms = texts.select("words", F.posexplode("w").alias("place", "term")).join(counts, "term")
    inside = (windows.join(terms, "words").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n"))))
    whole = Window.partitionBy("words", "first")
    chosen = (inside.withColumn("have", F.count("*").over(whole))
              .where(F.col("have") >= (F.least(F.col("n"), F.lit(rarest)) if partly else F.col("n")))
              .withColumn("rank", F.row_number().over(whole.orderBy("count", "term", "place"))).where(F.col("rank") <= rarest))
    return staged(chosen.groupBy("words", "first", "n", (F.col("have") == F.col("n")).alias("whole")).agg(F.collect_list(F.struct("place", "term")).alias("rarest")), "lookups")


def _bit(place: Column) -> Column:
    """The bit of a place in a mask of 64; places of a window up to 64 words differ in it."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def _offsets(docs: DataFrame, items: DataFrame, window: int, rarest: int, partly: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings of the windows' rarest terms, each taken back by the term's
    place: (doc_id, key, item, start, place, bit, least), ``start`` being where
    the item's first word would stand, ``item`` a number in place of its text
    and ``least`` the fewest bits of one of its windows.  And the windows per
    item: (item, words, windows)."""
    terms = items.select(F.explode(F.split("words", " ")).alias("term"))
    found = lookups(items, term_counts(docs, terms).withColumnRenamed("n", "count"), window, rarest, partly)
    mask = F.aggregate("rarest", F.lit(0).cast("long"), lambda m, r: m.bitwiseOR(_bit(r["place"])))
    windows = staged(found.withColumn("mask", mask).groupBy("words").agg(
        F.min(F.bit_count("mask")).alias("least"), F.collect_list(F.struct("first", "n", "whole", "mask", F.col("rarest.place").alias("places"))).alias("windows"))
        .withColumn("item", F.monotonically_increasing_id()), "windows")
    places = staged(found.select("words", F.inline("rarest")).distinct().join(windows.select("words", "item", "least"), "words").drop("words"), "places")
    index = postings(docs, places)
    offsets = index.join(places, "term").select("doc_id", "key", "item", (F.col("position") - F.col("place")).alias("start"), "place",
                                                _bit(F.col("place")).alias("bit"), "least")
    return offsets, windows.drop("least")


def _agreeing(offsets: DataFrame, windows: DataFrame, by: str, *more: Column) -> DataFrame:
    """Intersect the lists: per document, item and ``by``, the windows all of
    whose rarest terms are there, by their bits, and ``more`` aggregates.  The
    lists are summed up as numbers; nearly all have too few bits for any window
    and end there."""
    lists = (offsets.groupBy("doc_id", "key", "item", by).agg(F.bit_or("bit").alias("there"), F.max("least").alias("least"), *more)
             .where(F.bit_count("there") >= F.col("least")).drop("least"))
    agreed = F.filter("windows", lambda w: F.col("there").bitwiseAND(w["mask"]) == w["mask"])
    return lists.join(windows, "item").withColumn("windows", agreed).where(F.size("windows") > 0).drop("there", "item")


def _with_candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, key, text, c) of the documents with candidates (doc_id, key,
    words, start, windows), ``c`` being these."""
    per_doc = staged(found.groupBy("doc_id", "key").agg(F.collect_list(F.struct(
        "words", "start", F.transform("windows", lambda w: F.struct(w["first"].alias("first"), w["n"].alias("n"))).alias("windows"))).alias("c")),
        "candidates")
    return null_safe(pick(docs, per_doc.select("key").distinct(), ["key"]).select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"]),
                     per_doc, ["doc_id", "key"], "inner")


def _standing(words: list[bytes], c: dict) -> Iterator[tuple[int, int]]:
    """(place, length) of a candidate's windows that stand in the text word for word."""
    item = c["words"].encode().split(b" ")
    for w in c["windows"]:
        i, n = w["first"], w["n"]
        s = c["start"] + i
        if s >= 0 and words[s:s + n] == item[i:i + n]:
            yield s, n


def _verified(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, key, n_hit, items): of the candidates (doc_id, key, words,
    start, windows), what stands in the text word for word: the words in it
    and the texts of the items with a window there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, items = [], []
            for t, cand in zip(_texts(b), b.column("c").to_pylist(), strict=True):
                words, got = words_of(t), set()
                cover = np.zeros(len(words) + 1, np.int64)
                for c in cand:
                    for s, n in _standing(words, c):
                        got.add(c["words"])
                        cover[s] += 1
                        cover[s + n] -= 1
                hits.append(int((np.cumsum(cover) > 0).sum()))
                items.append(sorted(got))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(hits, pa.int64()),
                                              pa.array(items, pa.list_(pa.string()))], ["doc_id", "key", "n_hit", "texts"])

    return _with_candidates(docs, found).mapInArrow(trimmed(run), "doc_id long, key long, n_hit long, texts array<string>")


def _phrases(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, key, words, start): the candidates of which a window stands in
    the text word for word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, words, start = [], [], []
            for r, (t, cand) in enumerate(zip(_texts(b), b.column("c").to_pylist(), strict=True)):
                text = words_of(t)
                for c in cand:
                    if any(_standing(text, c)):
                        row.append(r)
                        words.append(c["words"])
                        start.append(c["start"])
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("key").take(rows), pa.array(words, pa.string()),
                                              pa.array(start, pa.int32())], ["doc_id", "key", "words", "start"])

    return _with_candidates(docs, found).mapInArrow(trimmed(run), "doc_id long, key long, words string, start int")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST,
            slack: int = SLACK) -> DataFrame:
    """(doc_id, words, start, kind): items found by the index at ``start``,
    where the item's first word would stand; ``kind`` is "phrase" where a window
    stands word for word, "near" for a proximity match away from these
    (``start`` being the least of the terms')."""
    bounded_batches(docs.sparkSession)
    docs = _keyed(docs)
    offsets, windows = _offsets(docs, item_words(benchmark), window, rarest, partly=True)
    offsets = staged(offsets, "offsets")
    whole = windows.withColumn("windows", F.filter("windows", lambda w: w["whole"]))
    exact = staged(_phrases(docs, _agreeing(offsets, whole, "start")), "phrases")
    # Starts in cells of slack + 1 words; a start reaches into the cell before.
    cell = F.floor(F.col("start") / (slack + 1))
    in_cells = lambda df: df.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    there = _agreeing(in_cells(offsets), windows, "cell", F.collect_set(F.struct("start", "place")).alias("at"))
    stand = F.filter("windows", lambda w: F.forall(w["places"], lambda p: F.array_contains(F.col("at.place"), p)))
    there = there.withColumn("windows", stand).where(F.size("windows") > 0)
    agreed = F.filter("at", lambda a: F.exists("windows", lambda w: F.array_contains(w["places"], a["place"])))
    near = (there.join(in_cells(exact).select("key", "words", "cell").distinct(), ["key", "words", "cell"], "left_anti")
            .select("doc_id", "key", "words", F.array_min(agreed)["start"].alias("start")).distinct())
    return (exact.select("doc_id", "words", "start", F.lit("phrase").alias("kind"))
            .unionByName(near.select("doc_id", "words", "start", F.lit("near").alias("kind"))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST,
                  share: int = 20) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items, contaminated) of every row of
    ``docs`` (doc_id, text): its ``row_key``, its words, those inside exact occurrences of windows, the
    ids (as sorted strings) of the items with occurring windows, and whether
    at least one word in ``share`` is hit."""
    bounded_batches(docs.sparkSession)
    docs = _keyed(docs)
    items = item_words(benchmark)
    hit = staged(_verified(docs, _agreeing(*_offsets(docs, items, window, rarest), "start")).where("n_hit > 0"), "hits")
    by_item = (hit.select("doc_id", "key", F.explode("texts").alias("words")).join(items, "words")
               .groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    hits = null_safe(hit.select("doc_id", "key", "n_hit"), by_item, ["doc_id", "key"], "inner")

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        out = pa.array([len(words_of(t)) for t in text.cast(pa.binary()).to_pylist()], pa.int64())
        give_back()
        return out

    # Called nondeterministic, or a condition on n_words has the words counted twice, by two Python workers a task.
    rows = docs.select("doc_id", "key", count.asNondeterministic()("text").alias("n_words"))
    out = null_safe(rows, hits, ["doc_id", "key"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "key", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
