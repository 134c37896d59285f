"""Bounded-space best-fit packing of documents into training windows.

Each partition keeps at most ``open_windows`` windows open.  A document is cut
into full windows and a rest; the rest goes to the open window it fits most
tightly; when it fits none and no more may be opened, the fullest is topped up
with the rest's head and emitted.  At the end of a partition the open windows
are merged, which leaves one unfilled window; those of ``MERGE`` neighbouring
partitions are merged the same way, and the last one is cut into runs of
power-of-two length, which need no padding.

Defined results: a null text is an empty one; every document has the end id,
so an empty one is a piece of one id; equal rows are packed each for itself;
a null ``doc_id`` is kept as null; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import bounded_batches, staged, trimmed
from casegrid.llm.vocab import chunks, encoder

WINDOW, OPEN_WINDOWS, MERGE = 2048, 64, 64
#: Rows of one output batch (about 8 KB each at most).
_ROWS = 2000
_PIECE = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary,"
          " part int, leftover boolean")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()),
                    ("leftover", pa.bool_())])


class Packer:
    """Open windows; a piece is (doc_id, start, doc_tokens, ids as uint32)."""

    def __init__(self, window: int, limit: int, first_id: int):
        self.window, self.limit, self.next_id = window, limit, first_id
        self.open: list[tuple[int, list]] = []  # (free, pieces)
        self.done: list[tuple[int, list]] = []  # (sequence_id, pieces)

    def emit(self, pieces: list) -> None:
        self.done.append((self.next_id, pieces))
        self.next_id += 1

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, total, ids[:self.window])])
            start, ids = start + self.window, ids[self.window:]
        while len(ids):
            n = len(ids)
            best = min((i for i, w in enumerate(self.open) if w[0] >= n), key=lambda i: self.open[i][0], default=None)
            if best is not None:
                free, pieces = self.open[best]
                pieces.append((doc, start, total, ids))
                if free == n:
                    self.emit(pieces)
                    self.open[best] = self.open[-1]
                    self.open.pop()
                else:
                    self.open[best] = (free - n, pieces)
                return
            if len(self.open) < self.limit:
                self.open.append((self.window - n, [(doc, start, total, ids)]))
                return
            full = min(range(len(self.open)), key=lambda i: self.open[i][0])
            free, pieces = self.open[full]
            pieces.append((doc, start, total, ids[:free]))
            self.emit(pieces)
            self.open[full] = self.open[-1]
            self.open.pop()
            start, ids = start + free, ids[free:]

    def merge(self) -> None:
        """Fill the fullest open windows with the emptiest ones' pieces."""
        rest = sorted(self.open, key=lambda w: w[0])
        self.open = []
        for _, pieces in rest[:self.limit]:
            for p in pieces:
                self._fill(*p)

    def _fill(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids):
            free, pieces = self.open.pop() if self.open else (self.window, [])
            pieces.append((doc, start, total, ids[:free]))
            start, ids, free = start + min(free, len(ids)), ids[free:], free - min(free, len(ids))
            if free:
                self.open.append((free, pieces))
            else:
                self.emit(pieces)

    def finish(self) -> None:
        """Cut what is left into runs of power-of-two length."""
        left = [p for _, pieces in self.open for p in pieces]
        self.open = []
        n = sum(len(p[3]) for p in left)
        while left:
            want, run = 1 << (n.bit_length() - 1), []
            n -= want
            while want:
                doc, start, total, ids = left.pop(0)
                run.append((doc, start, total, ids[:want]))
                if len(ids) > want:
                    left.insert(0, (doc, start + want, total, ids[want:]))
                want -= min(want, len(ids))
            self.emit(run)

    def rows(self, part: int, windows: list[tuple[int, list]], leftover: bool) -> Iterator[tuple]:
        for seq, pieces in windows:
            at = 0
            for doc, start, total, ids in pieces:
                yield doc, start, len(ids), total, seq, at, ids.tobytes(), part, leftover
                at += len(ids)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), _ROWS):
        cols = list(zip(*rows[i:i + _ROWS], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, vocab: str, style: str = "word", end_id: int = 1, window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, kept_words: int | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of
    all of ``docs`` (doc_id, text); ``ids`` little-endian unsigned 32-bit.  A
    worker remembers ``kept_words`` words (KEPT_WORDS of ``vocab``): fewer take
    less memory and more time."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, style, kept_words)
        part = TaskContext.get().partitionId()
        kind, p = ("<u2" if enc.width == 2 else "<u4"), Packer(window, open_windows, part << 32)
        end = array(enc.code, [end_id]).tobytes()
        for b in batches:
            for ids, texts in chunks(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for doc, raw in zip(ids, enc.encode(texts), strict=True):
                    tokens = np.frombuffer(raw + end, kind).astype("<u4")
                    p.add(doc, 0, len(tokens), tokens)
                yield from _batches(list(p.rows(part, p.done, False)))
                p.done = []
        p.merge()
        yield from _batches(list(p.rows(part, p.done, False)) + list(p.rows(part, [(0, w) for _, w in p.open], True)))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "offset"])
        group = int(pdf["part"].iloc[0]) // MERGE
        p = Packer(window, MERGE, (1 << 62) | (group << 32))
        has = pdf["doc_id"].notna()
        for r, known in zip(pdf.itertuples(index=False), has, strict=True):
            p._fill(int(r.doc_id) if known else None, int(r.start), int(r.doc_tokens), np.frombuffer(r.ids, "<u4"))
        p.finish()
        out = pd.DataFrame(list(p.rows(group, p.done, False)), columns=_ARROW.names)
        return out.astype({"doc_id": "Int64"})

    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = staged(text.mapInArrow(trimmed(first, keep_encoder=True), _PIECE), "packed")
    merged = (made.where("leftover").groupBy(F.floor(F.col("part") / MERGE).alias("g")).applyInPandas(last, _PIECE))
    return made.where("NOT leftover").unionByName(merged).drop("part", "leftover")
