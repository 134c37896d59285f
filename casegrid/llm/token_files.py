"""Token ids in binary blocks, compressed per document with a shared dictionary.

Layout of a token folder: ``dictionary`` holds one row (hash, bytes, vocabulary
path, width of an id); ``blocks`` holds the blocks in ascending order of
(part, block), each with the documents' ids, an offset index into its payload,
token counts, and the number of tokens that precede it in its part.  A payload
is a run of zstandard frames, one per document, each made with the dictionary
whose hash the block names; so a short document is read by its slice alone.

Defined results: a null text is an empty one; an empty text has the end id
only; a null ``doc_id`` sorts first; rows of equal ``doc_id`` are all kept,
ordered by the hash of their text; an empty table gives no blocks and an empty
dictionary; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegrid.llm.common import at_most, bounded_batches, drawn
from casegrid.llm.vocab import chunks, encoder

#: Documents (about) whose ids train the dictionary, its size, and the piece
#: of an id array that is one training sample.
SAMPLE_DOCS, DICT_BYTES, SAMPLE_BYTES = 2000, 64 << 10, 16 << 10
#: A block ends at so many payload bytes or documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 1024
LEVEL = 3

_BLOCK = ("part int, block int, first_doc long, last_doc long, part_offset long, dict_hash string, width int,"
          " doc_ids array<long>, offsets array<int>, tokens array<int>, payload binary")


def _ordered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def train_dictionary(docs: DataFrame, vocab: str, style: str, sample_docs: int = SAMPLE_DOCS,
                     dict_bytes: int = DICT_BYTES) -> bytes:
    """Dictionary from a hash sample of about ``sample_docs`` documents, trained
    in one task; empty when there is too little to train on."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = at_most(drawn(docs, share), 2 * sample_docs)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pieces = encoder(vocab, style), []
        for b in batches:
            texts = b.column("text").to_pylist()
            for _, part in chunks(texts, texts):
                for ids in enc.encode(part):
                    pieces += [ids[i:i + SAMPLE_BYTES] for i in range(0, len(ids), SAMPLE_BYTES)]
        try:
            made = zstandard.train_dictionary(dict_bytes, [p for p in pieces if len(p) >= 8]).as_bytes()
        except zstandard.ZstdError:  # too few samples for a dictionary
            made = b""
        yield pa.RecordBatch.from_pydict({"d": pa.array([made], pa.binary())})

    rows = sample.select("text").mapInArrow(train, "d binary").collect()
    return bytes(rows[0]["d"]) if rows else b""


def write_tokens(docs: DataFrame, path: str, vocab: str, style: str = "byte", end_id: int = 2,
                 sample_docs: int = SAMPLE_DOCS) -> None:
    """Write the token folder of ``docs`` (doc_id, text) in ascending doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = train_dictionary(docs, vocab, style, sample_docs)
    name, width = hashlib.sha256(shared).hexdigest(), encoder(vocab, style).width

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(vocab, style)
        end = array(enc.code, [end_id]).tobytes()
        how = {}
        if shared:
            d = zstandard.ZstdCompressionDict(shared)
            d.precompute_compress(level=LEVEL)
            how = {"dict_data": d}
        press = zstandard.ZstdCompressor(level=LEVEL, **how)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        frames: list[bytes] = []
        counts: list[int] = []

        def made() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = (part, block, min(known, default=None), max(known, default=None), before, name, width,
                   list(ids), offsets, list(counts), b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(),
                 pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        names = [c.split()[0] for c in _BLOCK.replace(", ", ",").split(",")]
        size = 0
        for b in batches:
            for some, texts in chunks(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for doc, raw in zip(some, enc.encode(texts), strict=True):
                    raw += end
                    frame = press.compress(raw)
                    ids.append(doc)
                    frames.append(frame)
                    counts.append(len(raw) // enc.width)
                    size += len(frame)
                    if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield made()
                        before += sum(counts)
                        block, size = block + 1, 0
                        ids.clear(), frames.clear(), counts.clear()
        if ids:
            yield made()

    spark.range(1).select(F.lit(name).alias("dict_hash"), F.lit(shared).alias("dictionary"), F.lit(vocab).alias("vocab"),
                          F.lit(width).alias("width")).write.parquet(f"{path}/dictionary")
    (_ordered(docs).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
     .mapInArrow(blocks, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the folder; ``ids`` little-endian
    unsigned 32-bit.  With ``doc_ids``, only those documents: blocks outside
    their range are not read, and in a block only their slices are."""
    bounded_batches(spark)
    head = spark.read.parquet(f"{path}/dictionary").first()
    shared, name = bytes(head["dictionary"]), head["dict_hash"]
    if hashlib.sha256(shared).hexdigest() != name:
        raise ValueError("the dictionary's bytes do not match its hash")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # One row per part, so at most one per task that wrote.
    parts = blocks.groupBy("part").agg(
        F.max(F.col("part_offset") + F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    want = set(doc_ids) if doc_ids is not None else None
    if want is not None:
        low, high = (min(want), max(want)) if want else (1, 0)
        blocks = blocks.where((F.col("first_doc") <= high) & (F.col("last_doc") >= low))
    rows = blocks.join(F.broadcast(starts), "part")

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        how = {"dict_data": zstandard.ZstdCompressionDict(shared)} if shared else {}
        open_ = zstandard.ZstdDecompressor(**how)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                if r["dict_hash"].as_py() != name:
                    raise ValueError("a block names another dictionary")
                payload = memoryview(r["payload"].as_buffer())
                ids, offsets = r["doc_ids"].as_py(), r["offsets"].as_py()
                tokens, kind = r["tokens"].as_py(), "<u2" if r["width"].as_py() == 2 else "<u4"
                at = r["part_start"].as_py() + r["part_offset"].as_py()
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                for k, doc in enumerate(ids):
                    if want is None or doc in want:
                        raw = open_.decompress(payload[offsets[k]:offsets[k + 1]])
                        out["doc_id"].append(doc)
                        out["start"].append(at)
                        out["n_tokens"].append(tokens[k])
                        out["ids"].append(np.frombuffer(raw, kind).astype("<u4").tobytes())
                    at += tokens[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["start"], pa.int64()),
                     pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids"], pa.binary())], list(out))

    return rows.select("part_start", "part_offset", "dict_hash", "width", "doc_ids", "offsets", "tokens",
                       "payload").mapInArrow(docs, "doc_id long, start long, n_tokens long, ids binary")
