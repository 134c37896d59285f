"""One JSON document written from Spark frames, without a collect (K6, K7).

The members of the document are JSON texts and sections.  A section is a frame
with one text per row (``line``) in the order it is to have; Spark writes it
as text files, one for each range of the sort.  One task then streams the parts
into the document, in order and a block at a time, and renames it when it is
whole: the driver handles file names only, the task one block.  Entries of an
array stand one to a line, so the document can also be read back in parallel.

A single file has a single writer.  Runs too large for one are better kept as
tables (``publish.write_results``, ``report.manifest_rows``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.session import stage_path
from casegrid.sources import storage

BLOCK = 1 << 20
#: JSON as written: explicit nulls.
JSON_KEEP_NULLS = {"ignoreNullFields": "false"}


@dataclass
class Section:
    """Ordered rows of ``line``: entries of an array, or with ``text`` pieces of
    one string (JSON-escaped, without quotes)."""

    rows: DataFrame
    text: bool = False


def escaped(text: Column) -> Column:
    """The inside of a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substr(whole, F.lit(7), F.length(whole) - F.lit(8))


def _joined(paths: list[str], between: bytes) -> Iterator[bytes]:
    """Contents of text files whose lines are to be joined by ``between``."""
    held = False  # a line break that only counts if more follows
    for path in paths:
        system, name = storage.resolve(path)
        with system.open_input_stream(name) as stream:
            while block := stream.read(BLOCK):
                if held:
                    yield between
                held = block.endswith(b"\n")
                yield (block[:-1] if held else block).replace(b"\n", between)


def pieces(members: list[tuple[str, str | list[str], bool]]) -> Iterator[bytes]:
    """The document's bytes.  A member is (name, JSON text) or (name, files of
    a section in order, whether it is a string)."""
    for i, (name, value, text) in enumerate(members):
        yield (",\n" if i else "{").encode() + json.dumps(name).encode() + b": "
        if isinstance(value, str):
            yield value.encode()
        elif text:
            yield b'"'
            yield from _joined(value, b"")
            yield b'"'
        else:
            yield b"[\n"
            yield from _joined(value, b",\n")
            yield b"\n]"
    yield b"}\n"


def write_json_document(spark: SparkSession, path: str, members: list[tuple[str, str | Section]]) -> None:
    """Write the object of ``members`` to ``path``, in place of an earlier file."""
    plan, folders = [], []
    for name, value in members:
        if isinstance(value, str):
            plan.append((name, value, False))
            continue
        folder = stage_path(spark, "section")
        folders.append(folder)
        value.rows.select("line").write.text(folder)
        plan.append((name, sorted(f for f in spark.read.text(folder).inputFiles()), value.text))
    target = storage.canonical(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            draft = f"{target}.{uuid.uuid4().hex}.tmp"
            system, name = storage.resolve(draft)
            with system.open_output_stream(name) as out:
                for block in pieces(plan):
                    out.write(block)
            storage.move(draft, target)
            yield pd.DataFrame({"path": [target]})

    if "/" in target:
        storage.make_folder(target.rsplit("/", 1)[0])
    spark.range(1).coalesce(1).mapInPandas(run, "path string").count()
    for folder in folders:
        storage.remove_folder(folder)
