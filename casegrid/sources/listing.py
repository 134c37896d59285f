"""Listing of documents as Spark jobs (S1), their order (O1) and id paths.

``list_documents(spark, root)`` gives one row per regular file under ``root``,
recursively: ``source_file, rel_path, name, length, id_path``.  Only file
*names* starting with ``.`` are skipped; dot- and underscore-directories,
``_names`` and zero-byte files are listed (``binaryFile`` drops all of those).

The tree is walked in rounds.  A task takes directories and walks down from
them until it has seen ``BUDGET`` entries; the directories that are left go
back to be dealt to all tasks in the next round, so no subtree, however deep or
lopsided, stays with one task.  A directory of more than ``FLAT`` files is
given back in slices by name: each task of a slice reads the names and looks
up and emits only its own.  Each round is written to the shared folder; the
driver holds the root and a count.

The walk goes through ``sources.storage``: paths on a mount that all executors
share, or URIs that Arrow's file systems open.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.session import stage_table
from casegrid.sources import storage

#: Entries a task sees before it gives directories back (few in the first
#: round, which one task walks), and files of one directory in one slice.
BUDGET, FIRST_BUDGET, FLAT = 50_000, 1_000, 20_000
_ROWS = 10_000  # rows of an output batch

WALK_SCHEMA = "kind string, path string, name string, length bigint, target string, slice int, slices int"
LISTING_COLUMNS = ("source_file", "rel_path", "name", "length", "id_path")


def _directory(path: str, slice_no: int, slices: int, flat: int) -> tuple[list[tuple], list[tuple], int]:
    """(files, units, entries seen) of one slice of a directory.  One that
    turns out too large gives its slices as units instead of files."""
    files, units, seen, count = [], [], 0, 0
    for e in storage.entries(path):
        seen += 1
        if e.is_dir:
            if slice_no == 0:  # sub-directories belong to the first slice
                units.append(("unit", e.path, e.name, None, None, 0, 1))
            continue
        if e.name.startswith("."):
            continue
        count += 1
        if slices == 1 and count > flat:
            files.clear()  # only counted from here on
            continue
        if zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % slices == slice_no:
            try:
                target = e.target()
                files.append(("file", e.path, e.name, e.size(), target if target != e.path else None, 0, 1))
            except FileNotFoundError:
                pass  # gone since the directory was read
    if slices == 1 and count > flat:
        n = -(-count // flat)
        # The first slice of many has no sub-directories left to give.
        units += [("unit", path, None, None, None, i, n) for i in range(n)]
    return files, units, seen


def walk(units: list[tuple[str, int, int]], budget: int, flat: int) -> Iterator[tuple]:
    """Files, and the units left over once ``budget`` entries have been seen."""
    queue, seen = deque(units), 0
    while queue and seen < budget:
        path, slice_no, slices = queue.popleft()
        files, more, n = _directory(path, slice_no, slices, flat)
        seen += n + 1
        if slices > 1:  # its sub-directories were given with the first look
            more = []
        yield from files
        for u in more:
            if u[6] > 1:
                yield u  # slices are for other tasks
            else:
                queue.append((u[1], 0, 1))
    for path, slice_no, slices in queue:
        yield "unit", path, None, None, None, slice_no, slices


def _round(units: DataFrame, budget: int, flat: int) -> DataFrame:
    columns = [c.split()[0] for c in WALK_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [(r.path, int(r.slice), int(r.slices)) for b in batches for r in b.itertuples(index=False)]
        rows = []
        for row in walk(mine, budget, flat):
            rows.append(row)
            if len(rows) >= _ROWS:
                yield pd.DataFrame(rows, columns=columns).astype({"length": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({"length": "Int64"})

    return units.select("path", "slice", "slices").mapInPandas(run, WALK_SCHEMA)


def list_documents(spark: SparkSession, root: str, num_partitions: int | None = None, *, budget: int = BUDGET,
                   first_budget: int = FIRST_BUDGET, flat: int = FLAT) -> DataFrame:
    """Listing frame for ``root``, unordered; the walk runs when this is called."""
    n = num_partitions or spark.sparkContext.defaultParallelism
    top = storage.canonical(root)
    units = spark.createDataFrame([(top, 0, 1)], "path string, slice int, slices int").coalesce(1)
    rounds, allowed = [], first_budget
    while True:
        found = stage_table(_round(units, allowed, flat), "listing")
        rounds.append(found.where("kind = 'file'"))
        left = found.where("kind = 'unit'")
        if left.isEmpty():
            break
        units, allowed = left.repartition(n, "path", "slice"), budget
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    return _named(files, root, top)


def _named(files: DataFrame, root: str, top: str) -> DataFrame:
    """Listing columns.  The id path (P1) is that of the resolved file below
    the resolved root; a link that leads out of it is known by the base name of
    what it leads to."""
    head = top.rstrip("/") + "/"

    def below(path: Column) -> Column:
        return F.substr(path, F.lit(len(head) + 1))

    rel = below(F.col("path"))
    target = F.col("target")
    id_path = (F.when(target.isNull(), rel).when(target.startswith(head), below(target))
               .otherwise(F.substring_index(target, "/", -1)))
    given = root.rstrip("/") + "/" if root.strip("/") else root
    return files.select(F.concat(F.lit(given), rel).alias("source_file"), rel.alias("rel_path"), "name", "length",
                        id_path.alias("id_path"))


def path_parts(path: Column) -> Column:
    """Sort key of the listing order (O1): the path's parts, compared one after
    the other by code points, so ``a/x`` comes before ``a-b/x``."""
    return F.split(path, "/")


def ordered(listed: DataFrame, path: str = "rel_path") -> DataFrame:
    """``listed`` in listing order (O1): range-partitioned on the path parts,
    sorted within partitions."""
    return listed.orderBy(path_parts(F.col(path)))


def with_positions(listed: DataFrame, path: str = "rel_path", position: str = "position") -> DataFrame:
    """``listed`` with the 0-based place of each row in listing order (paths are
    unique in a listing; rows of equal paths get places in any order).

    Ranges of path parts go to tasks, which sort and number their own rows; a
    row's place is its number plus the rows of earlier ranges, of which the
    driver knows one count per task.  The sorted rows are written first, so
    that numbers and counts are of the same rows."""
    spark = listed.sparkSession
    run = stage_table(listed.withColumn("_parts", path_parts(F.col(path))).repartitionByRange("_parts").sortWithinPartitions("_parts")
                      .drop("_parts").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, local = F.shiftrightunsigned("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = run.groupBy(part.alias("_part")).count().collect()  # one row a task
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["count"]
    table = spark.createDataFrame(offsets, "_part int, _before long")
    return (run.withColumn("_part", part).join(F.broadcast(table), "_part")
            .withColumn(position, F.col("_before") + local).drop("_at", "_part", "_before"))
