"""Uploaded batches: file-name checks and collision-safe names.

Naming rule per batch, in upload order: a name (compared
case-insensitively) that is already taken becomes ``stem_1.ext``,
``stem_2.ext``, ... -- the first one not taken by an earlier row.

Only names in one *family* can collide: strip every trailing ``_<digits>``
from the stem and lower-case it with the suffix; a generated name stays in
its original's family.  So rows are grouped by (batch, family):

* a family whose rows all carry the same name (the common case, however
  large) is numbered by a two-level rank over upload position -- exact, no
  Python, and a hot name is spread over many tasks;
* a family mixing names (``a.txt`` with ``a_1.txt``) is resolved exactly
  without gathering its rows or its names.  Of the distinct names, those that
  the rule may generate from another one (children) are settled parent by
  parent, in the order of their numbers and in blocks of bounded size; a block
  takes from the one before it a single number.  Every other row's number is
  its rank plus the kept numbers below it, counted by a window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrid.functions.ids import base_name, stem, suffix
from casegrid.schema import SUPPORTED_SUFFIXES
from casegrid.session import stage_table


def name_problem(filename) -> F.Column:
    """Why an uploaded file name is rejected (F8), or null."""
    name = base_name(F.coalesce(filename, F.lit("")))
    sfx = F.lower(suffix(name))
    return (
        F.when((name == "") | name.isin(".", "..") | (stem(name) == ""), F.lit("Choose a file with a name."))
        .when(~sfx.isin(*SUPPORTED_SUFFIXES),
              F.concat(F.lit("Unsupported file type '"), F.when(sfx == "", name).otherwise(sfx),
                       F.lit("'. Use .docx, .pdf, .txt.")))
    )


NO_BATCH_MESSAGE = "The upload names no batch."
BATCH_REFUSED_MESSAGE = "Another file of the batch was refused."


def check_batches(uploads: DataFrame) -> DataFrame:
    """Adds ``name_error`` per row and ``batch_ok``: a batch is accepted
    only if every name in it passes (one aggregate, no collect).  Rows without
    a batch id are refused, and none is lost (null keys join null-safe)."""
    u = uploads.withColumn("name_error", F.when(F.col("batch_id").isNull(), F.lit(NO_BATCH_MESSAGE))
                           .otherwise(name_problem(F.col("filename"))))
    bad = u.groupBy(F.col("batch_id").alias("_batch")).agg(F.count_if(F.col("name_error").isNotNull()).alias("_bad"))
    return (u.join(bad, F.col("batch_id").eqNullSafe(F.col("_batch")))
            .withColumn("batch_ok", F.col("_bad") == 0).drop("_bad", "_batch"))


def quarantine(uploads: DataFrame) -> DataFrame:
    """The refused rows (all rows of refused batches) with a ``reason`` each;
    ``stored_names`` takes the rest, so no row is in both or in neither."""
    reason = F.coalesce(F.col("name_error"), F.lit(BATCH_REFUSED_MESSAGE))
    return check_batches(uploads).where("NOT batch_ok").withColumn("reason", reason).drop("name_error", "batch_ok")


def accepted(uploads: DataFrame, strict: bool = False) -> DataFrame:
    """The rows of accepted batches.  With ``strict`` the job fails on the
    first refused row, with its reason, and an empty upload is refused."""
    checked = check_batches(uploads)
    if strict:
        if uploads.isEmpty():
            raise ValueError("an upload needs at least one file")
        reason = F.concat(F.lit("upload refused: "), F.coalesce("name_error", F.lit(BATCH_REFUSED_MESSAGE)))
        checked = checked.withColumn("batch_ok", F.when(F.col("batch_ok"), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean")))
    return checked.where("batch_ok").drop("name_error", "batch_ok")


RANK_CHUNK = 1 << 16  # positions per rank chunk
CHILD_BLOCK = 1 << 16  # children of one parent that are settled together
NAMES_PER_BUCKET = 4096  # children in one call, in the mean


def _dense_rank_by_pos(d: DataFrame, keys: list[str]) -> DataFrame:
    """1-based rank by ``pos`` within ``keys``, without a single-group window.

    Rows are split into chunks of ``pos`` (so a huge group spreads over many
    tasks), each chunk is numbered by a window, and each chunk's offset is the
    number of rows of its group in earlier chunks: a small aggregate, prefix
    summed over chunks and joined back."""
    d = d.withColumn("_chunk", F.floor(F.col("pos") / RANK_CHUNK))
    sizes = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(prior), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("pos"))
    return (d.withColumn("_local", local).join(offsets, [*keys, "_chunk"])
            .withColumn("_rank", F.col("_local") + F.col("_off")).drop("_chunk", "_local", "_off"))


_CHILD = "^(.+)_([1-9][0-9]*)$"  # a stem the rule generates from its parent


def kept_numbers(children: list[tuple[int, int]], kept: int) -> list[bool]:
    """Which children of one parent keep their names.

    A child ``(k, over)`` has the number ``k`` and is preceded by ``over`` rows
    that overflow from the parent; children come in the order of their numbers,
    ``kept`` of the smaller ones keep theirs.  An overflow takes the smallest
    free number.  So of the numbers below ``k`` all but the kept ones go to
    overflows before ``k`` does, and the child keeps its own if no more than
    those have come before it."""
    out = []
    for k, over in children:
        keep = over <= k - 1 - kept
        out.append(keep)
        kept += keep
    return out


def _settle_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of children of every parent in the frame."""
    pdf = pdf.sort_values(["batch_id", "_pslot", "_k"], kind="stable").reset_index(drop=True)
    keep: list[bool] = []
    for _, g in pdf.groupby(["batch_id", "_pslot"], sort=False):
        keep += kept_numbers(list(zip(g["_k"].tolist(), g["_over"].tolist(), strict=True)), int(g["_kept"].iloc[0]))
    return pd.DataFrame({"batch_id": pdf["batch_id"], "_pslot": pdf["_pslot"], "_slot": pdf["_slot"], "_k": pdf["_k"], "_keep": keep})


def _settled_children(events: DataFrame) -> DataFrame:
    """``(batch_id, _pslot, _slot, _k, _keep)`` of the names that may have been
    generated from another name of their batch.

    ``events`` has one row per distinct name: ``_slot``, the name it is
    generated from and its number (``_pslot``, ``_k``), how often that can be
    done to it (``_level``), its first position, and the rows of ``_pslot``
    before that.  Names are settled level by level, as a child depends on
    whether its parent kept its name."""
    parents = events.select("batch_id", F.col("_slot").alias("_pslot"), F.col("_first").alias("_pfirst"))
    kids = stage_table(events.where(F.col("_k").isNotNull()).join(parents, ["batch_id", "_pslot"]), "children")
    schema = f"batch_id {dict(events.dtypes)['batch_id']}, _pslot string, _slot string, _k bigint, _keep boolean"
    settled = None
    for level in sorted(r["_level"] for r in kids.select("_level").distinct().collect()):  # as many as a name has numbers at its end
        now = kids.where(F.col("_level") == level)
        if settled is None:
            now = now.withColumn("_pkeep", F.lit(True))
        else:
            up = settled.select("batch_id", F.col("_slot").alias("_pslot"), F.col("_keep").alias("_pkeep"))
            now = now.join(up, ["batch_id", "_pslot"], "left").withColumn("_pkeep", F.coalesce("_pkeep", F.lit(True)))
        over = F.col("_before") - F.when(F.col("_pkeep") & (F.col("_pfirst") < F.col("_first")), F.lit(1)).otherwise(F.lit(0))
        ranked = _dense_rank_by_pos(now.select("batch_id", "_pslot", "_slot", F.col("_k").alias("pos"), over.alias("_over")), ["batch_id", "_pslot"])
        ranked = stage_table(ranked.withColumnRenamed("pos", "_k").withColumn("_block", F.floor((F.col("_rank") - 1) / CHILD_BLOCK)), "ranked")
        n, last = ranked.agg(F.count("*"), F.max("_block")).first()
        buckets = max(1, -(-n // NAMES_PER_BUCKET))
        kept = None
        for block in range(last + 1):
            part = ranked.where(F.col("_block") == block)
            if kept is None:
                part = part.withColumn("_kept", F.lit(0).cast("bigint"))
            else:
                part = part.join(kept, ["batch_id", "_pslot"])
            done = stage_table(part.withColumn("_bucket", F.pmod(F.hash("batch_id", "_pslot"), F.lit(buckets))).groupBy("_bucket")
                               .applyInPandas(_settle_block, schema), "settled")
            settled = done if settled is None else settled.unionByName(done)
            if block < last:
                more = done.groupBy("batch_id", "_pslot").agg(F.count_if("_keep").alias("_kept"))
                kept = stage_table(more if kept is None else more.unionByName(kept).groupBy("batch_id", "_pslot").agg(F.sum("_kept").alias("_kept")),
                                   "kept")
    return events.sparkSession.createDataFrame([], schema) if settled is None else settled


def _claims_below(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """``rows`` (batch_id, _slot, _j, ...) with ``_below``: how many of the
    slot's ``claims`` (batch_id, _slot, _gap) have ``_gap`` below ``_j``.

    In chunks of numbers, as a slot may have any number of rows: a running
    count within the chunk, plus the counts of the chunks before it."""
    keys = ["batch_id", "_slot"]
    rows = rows.withColumn("_chunk", F.floor(F.col("_j") / RANK_CHUNK))
    claims = claims.withColumn("_chunk", F.floor(F.col("_gap") / RANK_CHUNK))
    counts = claims.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    marks = rows.select(*keys, "_chunk").distinct().withColumn("_n", F.lit(0).cast("bigint"))
    upto = Window.partitionBy(*keys).orderBy("_chunk").rangeBetween(Window.unboundedPreceding, -1)
    chunks = (counts.unionByName(marks).groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_n"))
              .withColumn("_pre", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n"))
    both = rows.withColumn("_claim", F.lit(0)).unionByName(
        claims.select(*keys, "_chunk", F.col("_gap").alias("_j"), F.lit(1).alias("_claim")), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_j", "_claim").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_in", F.sum("_claim").over(inside)).where("_claim = 0").drop("_claim")
    return counted.join(chunks, [*keys, "_chunk"]).withColumn("_below", F.col("_in") + F.col("_pre")).drop("_in", "_pre", "_chunk")


def _rows_before(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """For each marker ``(batch_id, _key, _mpos, _slot)``: the number of rows
    ``(batch_id, _key, pos)`` with ``pos < _mpos``.

    Chunked like ``_dense_rank_by_pos``: rows in earlier chunks come from a
    running sum over per-chunk counts merged with the markers (one record
    per chunk or marker, not per row); rows in the marker's own chunk from a
    running count inside that chunk (at most ``RANK_CHUNK`` rows)."""
    keys = ["batch_id", "_key"]
    chunk = F.floor(F.col("pos") / RANK_CHUNK)
    r = rows.select(*keys, "pos", chunk.alias("_chunk"))
    m = markers.select(*keys, F.col("_mpos").alias("pos"), "_slot").withColumn("_chunk", chunk)
    # rows of the key in chunks before the marker's chunk
    counts = r.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"))
    recs = counts.select(*keys, "_chunk", "_cnt", F.lit(1).alias("_order"),
                         F.lit(None).cast("string").alias("_slot")).unionByName(
        m.select(*keys, "_chunk", F.lit(0).cast("bigint").alias("_cnt"), F.lit(0).alias("_order"), "_slot"))
    upto = Window.partitionBy(*keys).orderBy("_chunk", "_order").rowsBetween(Window.unboundedPreceding, 0)
    earlier = recs.withColumn("_pre", F.sum("_cnt").over(upto)).where(F.col("_order") == 0) \
        .select("batch_id", "_slot", "_pre")
    # rows of the key in the marker's own chunk, before the marker
    u = r.select(*keys, "pos", "_chunk", F.lit(1).alias("_row"), F.lit(None).cast("string").alias("_slot")) \
        .unionByName(m.select(*keys, "pos", "_chunk", F.lit(0).alias("_row"), "_slot"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    same = u.withColumn("_in", F.sum("_row").over(inside)).where(F.col("_row") == 0).select("batch_id", "_slot", "_in")
    return earlier.join(same, ["batch_id", "_slot"]).select(
        "batch_id", "_slot", (F.col("_pre") + F.col("_in")).alias("_before"))


def _mixed_names(d: DataFrame) -> DataFrame:
    """Exact names for rows of mixed families, without gathering rows."""
    lstem = F.lower("_stem")
    d = d.withColumn("_slot", F.col("_lname"))
    d = d.withColumn("_pslot", F.when(lstem.rlike(_CHILD),
                                      F.concat(F.regexp_extract(lstem, _CHILD, 1), F.lower("_sfx"))))
    d = d.withColumn("_k", F.when(F.col("_pslot").isNotNull(),
                                  F.regexp_extract(lstem, _CHILD, 2).try_cast("bigint")))
    level = F.regexp_count(F.regexp_extract(lstem, "((?:_[1-9][0-9]*)*)$", 1), F.lit("_"))
    events = d.groupBy("batch_id", "_family", "_slot", "_pslot", "_k", level.alias("_level")).agg(F.min("pos").alias("_first"))
    before = _rows_before(
        d.select("batch_id", F.col("_slot").alias("_key"), "pos"),
        events.where(F.col("_pslot").isNotNull()).select(
            "batch_id", F.col("_pslot").alias("_key"), F.col("_first").alias("_mpos"), "_slot"),
    )
    events = stage_table(events.join(before, ["batch_id", "_slot"], "left").withColumn("_before", F.coalesce("_before", F.lit(0))), "names")
    ranked = _dense_rank_by_pos(d.drop("_pslot", "_k"), ["batch_id", "_slot"])
    settled = _settled_children(events)
    # A kept number k of a parent stands after k - rank numbers that are not kept.
    claims = _dense_rank_by_pos(settled.where("_keep").select("batch_id", F.col("_pslot").alias("_slot"), F.col("_k").alias("pos")),
                                ["batch_id", "_slot"]).select("batch_id", "_slot", (F.col("pos") - F.col("_rank")).alias("_gap"))
    r = ranked.join(settled.select("batch_id", "_slot", "_keep"), ["batch_id", "_slot"], "left")
    keep_first = F.coalesce(F.col("_keep"), F.lit(True))
    r = r.withColumn("_j", F.col("_rank") - F.when(keep_first, F.lit(1)).otherwise(F.lit(0)))
    r = _claims_below(r, claims)
    stored = F.when((F.col("_rank") == 1) & keep_first, F.col("_name")).otherwise(
        F.concat(F.col("_stem"), F.lit("_"), (F.col("_j") + F.col("_below")).cast("string"), F.col("_sfx")))
    return r.withColumn("stored_name", stored).drop("_slot", "_keep", "_rank", "_j", "_below")


def stored_names(uploads: DataFrame) -> DataFrame:
    """``uploads(batch_id, pos, filename, ...)`` -> adds ``stored_name``.

    A row without batch, position or name takes no name (``stored_name`` null)
    and keeps no other row from one."""
    whole = F.col("batch_id").isNotNull() & F.col("pos").isNotNull() & F.col("filename").isNotNull()
    unnamed = uploads.where(~whole).withColumn("stored_name", F.lit(None).cast("string"))
    d = uploads.where(whole).withColumn("_name", base_name(F.col("filename")))
    d = d.withColumn("_stem", stem(F.col("_name"))).withColumn("_sfx", suffix(F.col("_name")))
    d = d.withColumn(
        "_family",
        F.concat(F.lower(F.regexp_replace("_stem", "(_[0-9]+)+$", "")), F.lit("\u0000"), F.lower("_sfx")),
    ).withColumn("_lname", F.lower("_name"))
    # Families mixing names: a partial aggregate (skew-safe), joined back.
    mixed_fams = (
        d.groupBy("batch_id", "_family")
        .agg((F.min("_lname") != F.max("_lname")).alias("_mixed"))
        .where("_mixed")
    )
    d = d.join(mixed_fams, ["batch_id", "_family"], "left").withColumn(
        "_mixed", F.coalesce(F.col("_mixed"), F.lit(False)))
    ranked = _dense_rank_by_pos(d.where(~F.col("_mixed")), ["batch_id", "_lname"])
    simple = ranked.withColumn(
        "stored_name",
        F.when(F.col("_rank") == 1, F.col("_name")).otherwise(
            F.concat(F.col("_stem"), F.lit("_"), (F.col("_rank") - 1).cast("string"), F.col("_sfx"))),
    ).drop("_rank")
    mixed = _mixed_names(d.where(F.col("_mixed")))
    drop = ("_name", "_stem", "_sfx", "_family", "_mixed", "_lname")
    return simple.drop(*drop).unionByName(mixed.drop(*drop)).unionByName(unnamed)


def upload_candidates(uploads: DataFrame, strict: bool = False) -> DataFrame:
    """Uploaded batches as triage input (S9): accepted batches only (the rest
    is ``quarantine``), stored names as the path inside the batch, bytes
    decoded as files.  The id is made from batch and name, so equal names in
    different batches get different ids."""
    from casegrid.functions.ids import document_id
    from casegrid.sources.decode import decode_documents

    named = stored_names(accepted(uploads, strict))
    path = F.concat_ws("/", F.col("batch_id").cast("string"), F.col("stored_name"))
    rows = named.select(
        document_id(path, F.col("stored_name")).alias("document_id"),
        path.alias("source_file"),
        suffix(F.col("stored_name")).alias("suffix"),
        "content",
        F.lit(None).cast("string").alias("read_error"),
        F.lit(None).cast("string").alias("read_message"),
    )
    return decode_documents(rows)
