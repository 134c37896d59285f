"""Path parts and deterministic document ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_STEM_MAX = 40
ID_HASH_CHARS = 8


def base_name(path: Column) -> Column:
    """Last path component."""
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(name: Column) -> Column:
    """Suffix by the last dot; none when that dot is first or last."""
    return F.regexp_extract(name, "(?s)^.+(\\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    """Name without its suffix."""
    return F.left(name, F.length(name) - F.length(suffix(name)))


def lower_suffix(name: Column) -> Column:
    return F.lower(suffix(name))


def id_stem(name: Column) -> Column:
    """Stem with runs of non-alphanumerics as ``_``, trimmed, lower, <= 40."""
    cleaned = F.lower(F.btrim(F.regexp_replace(stem(name), "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    cleaned = F.when(cleaned == "", F.lit("document")).otherwise(cleaned)
    return F.left(cleaned, F.lit(ID_STEM_MAX))


def document_id(rel_path: Column, name: Column | None = None) -> Column:
    """``{stem}_{first 8 hex of sha256(relative posix path)}``; for listed files
    the path is the resolved one (``listing.id_path``), the name the listed one."""
    name = base_name(rel_path) if name is None else name
    digest = F.left(F.sha2(rel_path, 256), F.lit(ID_HASH_CHARS))
    return F.concat(id_stem(name), F.lit("_"), digest)
