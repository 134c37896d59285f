"""Bytes to text by file type (S3-S6) and the directory ingest.

``.txt`` decodes natively (invalid UTF-8 becomes U+FFFD).  ``.docx`` and
``.pdf`` need a parser, so those rows (and only those: filtered first,
since ``when`` does not stop a Python function from running) go through a
``mapInPandas`` job and are unioned back.  A parser failure is a per-row
``DOCUMENT_READ_ERROR``, never a task failure.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid.functions.text import decode_utf8
from casegrid.schema import DOCUMENT_READ_ERROR, NO_PDF_DECODER_MESSAGE

PdfDecoder = Callable[[bytes], list[str]]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _run_text(run: ET.Element) -> str:
    out = []
    for e in run:
        tag = e.tag
        if tag == _W + "t":
            out.append(e.text or "")
        elif tag in (_W + "tab", _W + "ptab"):
            out.append("\t")
        elif tag == _W + "cr":
            out.append("\n")
        elif tag == _W + "br":
            out.append("" if e.get(_W + "type") in ("page", "column") else "\n")
        elif tag == _W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _main_part(z: zipfile.ZipFile) -> str:
    """Name of the package's main document part, by its relationships; the
    usual name where a package has none."""
    try:
        rels = ET.fromstring(z.read("_rels/.rels"))
    except KeyError:
        return "word/document.xml"
    for r in rels:
        if r.get("Type", "").endswith("/officeDocument") and r.get("TargetMode") != "External":
            return r.get("Target", "").lstrip("/")
    raise ValueError("no main document part")


def docx_text(data: bytes) -> str:
    """Body paragraphs of a .docx joined with LF (tables, headers and
    footers are not read).  Raises on anything that is not a docx."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read(_main_part(z)))
    body = root.find(_W + "body")
    if body is None:
        raise ValueError("no document body")
    paras = []
    for p in body.findall(_W + "p"):
        parts = []
        for child in p:
            if child.tag == _W + "r":
                parts.append(_run_text(child))
            elif child.tag == _W + "hyperlink":
                parts.extend(_run_text(r) for r in child.findall(_W + "r"))
        paras.append("".join(parts))
    return "\n".join(paras)


def _decoded_schema(df: DataFrame) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name not in ("content", "text", "read_error", "read_message")]
    return T.StructType(fields + [
        T.StructField("text", T.StringType()),
        T.StructField("read_error", T.StringType()),
        T.StructField("read_message", T.StringType()),
    ])


def _parse_job(df: DataFrame, parse: Callable[[bytes], str] | None, what: str) -> DataFrame:
    schema = _decoded_schema(df)
    keep = [f.name for f in schema.fields if f.name not in ("text", "read_error", "read_message")]

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, codes, msgs = [], [], []
            for data, err, msg in zip(pdf["content"], pdf["read_error"], pdf["read_message"]):
                if err is not None and not pd.isna(err):
                    texts.append(None), codes.append(err), msgs.append(msg)
                    continue
                if parse is None:
                    texts.append(None), codes.append(DOCUMENT_READ_ERROR)
                    msgs.append(NO_PDF_DECODER_MESSAGE if what == ".pdf" else f"no decoder for {what}")
                    continue
                try:
                    texts.append(parse(bytes(data))), codes.append(None), msgs.append(None)
                except Exception:  # noqa: BLE001 - any parser failure is a read error
                    texts.append(None), codes.append(DOCUMENT_READ_ERROR), msgs.append(None)
            out = pdf[keep].copy()
            out["text"], out["read_error"], out["read_message"] = texts, codes, msgs
            yield out

    return df.mapInPandas(fn, schema)


def _pdf_parser(decoder: PdfDecoder | None) -> Callable[[bytes], str] | None:
    if decoder is None:
        return None

    def parse(data: bytes) -> str:
        return "\n".join(decoder(data))

    return parse


def decode_documents(read: DataFrame, pdf_decoder: PdfDecoder | None = None) -> DataFrame:
    """``content`` -> ``text`` by lower-cased ``suffix``; read errors pass
    through.  Output has ``text, read_error, read_message`` and no bytes."""
    sfx = F.lower(F.col("suffix"))
    if "read_message" not in read.columns:
        read = read.withColumn("read_message", F.lit(None).cast("string"))
    schema = _decoded_schema(read)
    cols = [f.name for f in schema.fields]
    txt = (
        read.where(~sfx.isin(".docx", ".pdf"))
        .withColumn("text", F.when(F.col("read_error").isNull(), decode_utf8(F.col("content"))))
        .select(*cols)
    )
    docx = _parse_job(read.where(sfx == ".docx"), docx_text, ".docx").select(*cols)
    pdf = _parse_job(read.where(sfx == ".pdf"), _pdf_parser(pdf_decoder), ".pdf").select(*cols)
    return txt.unionByName(docx).unionByName(pdf)
