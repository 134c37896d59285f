"""Exact Jaccard self-join of word n-gram sets by PartEnum signatures.

Sets of a similarity s or more differ in few features: in at most k, which
is (1 - s) / (1 + s) of their sizes' sum.  Sizes are divided into bands.  For a
band, the feature domain is cut into n1 = k / 2 + m cells by hash (rounded
down), each cell into n2 parts; at least m of the cells hold at most one of k
differences, and there all but one of the parts are equal.  Each choice of
n2 - 1 parts of a cell is one signature (a hash of the features in them), so
linked sets share at least one.  A set signs for its own band and for the
smaller bands its partners may lie in.

A signature of parts without features would be shared by unlike sets.  A set
with fewer than m cells that have such a one drops them all: one of the m cells
it agrees in with a partner is not among them.  Only a set with m or more keeps
them, so they are shared by those few sets alone.  n2 and m are chosen for each
band by cost: the number of signatures, and how likely a set is to keep empty
ones.

Documents of equal sets are one node.  Rather than all pairs of a signature,
each is compared with one centre (its smallest node; within a map task, the
task's smallest): first the one it shares most signatures with, then those in
other components; linked nodes are joined into components.  What may be left,
links between nodes of different components that signatures connect, is
settled exactly.  Sets most of whose features no set of another component has
are done.  Similar sets cannot be without a common one among their rarest
features (a prefix in one fixed order), so the others, as far as signatures
connect them, are grouped by these; groups within one component are done, and the nodes of the others are compared
in blocks of bounded size, but for those of a family's largest component with
one another.  Blocks give links only, so no pair list is written.

Nodes are 64-bit digests of the sets.  A second digest is kept with each row;
where unequal second digests meet in one node, the nodes of those documents are
made from the second one, so 128 bits tell sets apart.  Features are 64-bit
hashes, compared within pairs only.

Defined results: words are runs of other characters than ASCII white space,
A-Z lower-cased; a document of fewer words than n has the whole sequence as
its one feature; null and empty texts have none and are linked with nothing; a
component is named by its smallest ``doc_id`` (nulls are passed over; null if
there is no other); rows of equal ``doc_id`` are kept one by one; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.llm.common import bounded_batches, discard, give_back, pick, row_id, staged, trimmed
from casegrid.llm.graph import components

_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))  # mixing constants
#: Signatures combined at once.
CHUNK = 400_000
#: Nodes and features of one block (in the mean), and features of one matrix product.
BLOCK_NODES, BLOCK_FEATURES, COLUMNS = 1024, 1 << 18, 4096
#: Features per hash cell whose counts are compared before sets are, the least
#: number of cells, and (as a power of two) those that order features by commonness: 2 MB.
PER_CELL, CELLS, ORDER_BITS = 8, 128, 18
#: A band's largest size is at most so many times its smallest.
BAND = 1.4
#: Coinciding 64-bit digests that are sent to tasks (some 6e12 documents).
MOST_COINCIDING = 1_000_000
#: What it costs if a set keeps its empty signatures, in signatures; the most
#: parts of a cell, and the most of them left out of a signature.
EMPTY_COST, MOST_PARTS, MOST_MISSING = 300, 12, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _ODD[1]
    x = (x ^ (x >> _U(27))) * _ODD[2]
    return x ^ (x >> _U(31))


def features(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles (uint64)."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))
    m = max(1, len(h) - n + 1)
    out = np.full(m, _U(min(n, len(h))))
    for i in range(min(n, len(h))):
        out = _mix(out + h[i:i + m] * _ODD[0])
    return np.unique(out)


def digest(f: np.ndarray, taken: frozenset[int] = frozenset()) -> int:
    """A set's node; of sets whose nodes coincide (``taken``) by the second digest."""
    from xxhash import xxh3_64_intdigest

    raw = f.tobytes()
    first = int(np.int64(_U(xxh3_64_intdigest(raw)).astype(np.int64)))
    return second_digest(raw) if first in taken else first


def second_digest(raw: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.int64(_U(xxh3_64_intdigest(raw, seed=1)).astype(np.int64)))


def _keeps_empty(size: int, n1: int, n2: int, k2: int, m: int) -> float:
    """About how likely ``m`` or more of ``n1`` cells have an empty signature,
    all features being in ``k2`` parts (Poisson), for sets of ``size`` features."""
    none = math.exp(-size / n1 / n2)
    p = sum(math.comb(n2, j) * (1 - none) ** j * none ** (n2 - j) for j in range(k2 + 1))
    mean = n1 * p
    return max(0.0, 1.0 - sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(m))) if mean else 0.0


def _cheapest(size: int, k: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, m) for up to ``k`` differences of sets of ``size`` and more."""
    best = None
    for k2 in range(1, min(k, MOST_MISSING) + 1):
        for n2 in range(k2 + 1, MOST_PARTS + 1):
            m = 1
            while (n1 := k // (k2 + 1) + m) <= 2 * size:
                number = n1 * math.comb(n2, k2)
                if best is not None and number >= best[0]:
                    break
                cost = number + EMPTY_COST * _keeps_empty(size, n1, n2, k2, m)
                if best is None or cost < best[0]:
                    best = (cost, n1, n2, k2, m)
                m += max(1, m // 8)
    return best[1:]


@lru_cache
def _choices(n2: int, k2: int) -> np.ndarray:
    """One row for each choice of ``n2 - k2`` parts."""
    out = np.ones((math.comb(n2, k2), n2), _U)
    for row, left in zip(out, itertools.combinations(range(n2), k2), strict=True):
        row[list(left)] = 0
    return out


@lru_cache(maxsize=8)
def bands(num: int, den: int) -> list[tuple[int, int, int, int, int, int]]:
    """(low, high, n1, n2, k2, m) of each size band, up to 2 ** 31."""
    out, low = [], 1
    while low < 1 << 31:
        high = max(low, int(low * BAND))
        partner = high * den // num
        k = (den - num) * (high + partner) // (den + num)
        if k == 0:
            out.append((low, high, 1, 1, 0, 1))
        elif low <= 1 << 12:
            out.append((low, high, *_cheapest(low, k)))
        else:  # as the last one, in proportion
            n2, k2, m = out[-1][3:]
            spare = math.ceil(m * low / out[-1][0])
            out.append((low, high, k // (k2 + 1) + spare, n2, k2, spare))
        low = high + 1
    return out


def signatures(f: np.ndarray, num: int, den: int) -> np.ndarray:
    """Distinct signatures of a set, for all bands it takes part in."""
    size, table = len(f), bands(num, den)
    out = []
    own = next(i for i, b in enumerate(table) if b[1] >= size)
    for i in range(own, -1, -1):
        _, high, n1, n2, k2, m = table[i]
        if i < own and high * den < num * size:
            break
        spread = _mix(f + _U((i + 1) * int(_ODD[0]) % (1 << 64)))
        if n2 == 1:
            sums = np.array([spread.sum(dtype=_U)])
            keys = np.zeros(1, _U)
        else:
            cell = ((spread >> _U(40)) % _U(n1)).astype(np.int64)
            place = cell * n2 + ((spread >> _U(8)) % _U(n2)).astype(np.int64)
            parts = np.zeros(n1 * n2, _U)
            np.add.at(parts, place, _mix(spread))
            parts = parts.reshape(n1, n2)
            count = np.bincount(place, minlength=n1 * n2).reshape(n1, n2)
            chosen = _choices(n2, k2)
            sums = (parts @ chosen.T).ravel()
            empty = ((count > 0) @ chosen.T.astype(np.int64) == 0)
            keys = np.arange(len(sums), dtype=_U)
            if int(empty.any(axis=1).sum()) < m:
                sums, keys = sums[~empty.ravel()], keys[~empty.ravel()]
        out.append(_mix(sums ^ _mix(keys + _U(((i << 40) + int(_ODD[2])) % (1 << 64)))))
    return np.unique(np.concatenate(out))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_id().alias("key"))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, n_shingles, node, second) of every row; node null without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, node, second = [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                f = features(t or b"", n)
                size.append(len(f))
                node.append(digest(f) if len(f) else None)
                second.append(second_digest(f.tobytes()) if len(f) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(second, pa.int64())],
                ["doc_id", "key", "n_shingles", "node", "second"])

    return docs.mapInArrow(trimmed(run), "doc_id long, key string, n_shingles long, node long, second long")


def _combine(sig: np.ndarray, node: np.ndarray) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows (sig, node, centre, n) of one chunk: its smallest node for every
    signature, and the pairs of the other nodes with it, n times each."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.concatenate([[True], sig[1:] != sig[:-1]])
    centre = node[np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))]
    rest = ~head & (node != centre)
    pairs, times = np.unique(np.stack([node[rest], centre[rest]]), axis=1, return_counts=True)
    key = _mix(pairs[0].astype(_U) * _ODD[0] + pairs[1].astype(_U))
    names = ["sig", "node", "centre", "n"]
    return (pa.RecordBatch.from_arrays([pa.array(sig[head].view(np.int64)), pa.array(node[head]),
                                        pa.nulls(int(head.sum()), pa.int64()), pa.nulls(int(head.sum()), pa.int32())], names),
            pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pairs[0]), pa.array(pairs[1]),
                                        pa.array(times.astype(np.int32))], names))


def _signed(docs: DataFrame, n: int, num: int, den: int, taken: frozenset[int] = frozenset()) -> DataFrame:
    """(sig, node, centre, n): signatures with a node each, and pairs found
    ``n`` times within a task (centre not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if sigs:
                counts = [len(s) for s in sigs.values()]
                yield from (r for r in _combine(np.concatenate(list(sigs.values())), np.repeat(
                    np.fromiter(sigs, np.int64, len(sigs)), counts)) if r.num_rows)
                sigs.clear()

        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                f = features(t or b"", n)
                if len(f) and (d := digest(f, taken)) not in sigs:
                    sigs[d] = signatures(f, num, den)
                    held += len(sigs[d])
                if held >= CHUNK:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select("text").mapInArrow(trimmed(run), "sig long, node long, centre long, n int")


def cells(f: np.ndarray) -> np.ndarray:
    """Features in each hash cell, about PER_CELL of them; a power of two of cells."""
    n = max(CELLS, 1 << (len(f) // PER_CELL).bit_length())
    return np.minimum(np.bincount((f & _U(n - 1)).astype(np.int64), minlength=n), 65535).astype(np.uint16)


def apart(a: bytes, b: bytes) -> int:
    """In how many features two sets differ at least, by their cells' counts;
    those of the finer one are added up to the other's cells."""
    x, y = (np.frombuffer(v, np.uint16).astype(np.int64) for v in (a, b))
    if len(x) < len(y):
        x, y = y, x
    return int(np.abs(x.reshape(-1, len(y)).sum(axis=0) - y).sum())


def _arrays(docs: DataFrame, n: int, taken: frozenset[int] = frozenset()) -> DataFrame:
    """(node, f, c): the set of each document as an array, and how many of its
    features fall into each hash cell (``cells``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 500):
                sets = [f for f in (features(t or b"", n) for t in texts[i:i + 500]) if len(f)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(f, taken) for f in sets], pa.int64()),
                     pa.array([f.view(np.int64) for f in sets], pa.list_(pa.int64())),
                     pa.array([cells(f).tobytes() for f in sets], pa.binary())],
                    ["node", "f", "c"])

    return docs.select("text").mapInArrow(trimmed(run), "node long, f array<long>, c binary")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact intersection.
    Sets differ in no fewer features than their cell counts do, so pairs whose
    counts differ too much are left out before any set is sent."""
    def side(name: str, *cols: Column) -> DataFrame:
        return sets.select(F.col("node").alias(name), *cols)

    near = (pairs.select("a", "b").join(side("a", F.col("c").alias("ca"), F.size("f").alias("na")), "a")
            .join(side("b", F.col("c").alias("cb"), F.size("f").alias("nb")), "b")
            .where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            most = (t.column("na").to_numpy() + t.column("nb").to_numpy()) * (den - num)
            least = [apart(x.as_py(), y.as_py()) * (den + num) for x, y in zip(t.column("ca"), t.column("cb"), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(np.array(least, np.int64) <= most))

    near = near.mapInArrow(trimmed(close), "a long, b long")
    near = staged(near.select("a", "b"), "near")
    # Only the sets of these pairs are sent.
    sets = pick(sets, staged(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-nodes"), ["node"])
    both = F.size(F.array_intersect("fa", "fb"))
    return (near.join(side("a", F.col("f").alias("fa")), "a").join(side("b", F.col("f").alias("fb")), "b")
            .where(both * den >= (F.size("fa") + F.size("fb") - both) * num).select("a", "b"))


def _settled(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among ``pairs`` (a, b, n) that make the same components as all of
    them: each node b is compared with the centre it shares most signatures
    with, then with its others as far as they are in other components yet."""
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    first = staged(_links(staged(best.select("a", "b"), "best"), sets, num, den), "links")
    comp = components(first)
    left = pairs.join(best, ["a", "b"], "left_anti").select("a", "b")
    for side in ("a", "b"):
        c = comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        left = left.join(c, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    left = staged(left.where("ca != cb").select("a", "b"), "left")
    return first.unionByName(staged(_links(left, sets, num, den), "links"))


def _commonness(sets: DataFrame) -> np.ndarray:
    """How many features of ``sets`` fall into each of 2 ** ORDER_BITS hash
    cells: a fixed-size table that orders features from rare to common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for b in batches:
            f = b.column("f").flatten().to_numpy().view(_U)
            counts += np.bincount((f >> _U(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    table = sets.select("f").mapInArrow(trimmed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << ORDER_BITS, np.int64)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out


def rarest(f: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """A set's first features in the order (commonness, hash): so many that two
    similar sets cannot be without a common one among them."""
    order = np.lexsort((f, common[(f >> _U(64 - ORDER_BITS)).astype(np.int64)]))
    return f[order[:len(f) - -(-num * len(f) // den) + 1]]


def _families(b: pa.RecordBatch) -> np.ndarray:
    """The families of a batch's nodes, as signs that are mixed into hashes."""
    return _mix(b.column("family").to_numpy().view(_U) * _ODD[1])


def _sharing(nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``nodes`` (node, family, component) that may be near one of
    another component of their family: of a set's features a partner lacks
    (den - num) / den at most, so a set goes when more are in no set of another
    component.  This is counted on the features in a part of the hash range."""
    share = min(1.0, 1.6 * (den - num) / den)

    def sample(f: np.ndarray) -> np.ndarray:
        h = _mix(f * _ODD[2])
        return h[h < _U(int(share * ((1 << 64) - 1)))]

    def within(h: np.ndarray, family: np.uint64) -> np.ndarray:
        # 32 bits of a hash: features that coincide only keep more sets.
        return (_mix(h ^ family) & _U(0x7FFFFFFF)).astype(np.int32)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                some = [within(sample(f.values.to_numpy().view(_U)), k) for f, k in zip(b.column("f"), _families(b), strict=True)]
                times = [len(x) for x in some]
                if sum(times):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(some)), *(pa.array(np.repeat(b.column(x).to_numpy(), times)) for x in ("node", "component"))],
                        ["h", "node", "component"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [(len(f), len(sample(f.values.to_numpy().view(_U)))) for f in b.column("f")]
            yield pa.RecordBatch.from_arrays([b.column("node"), *(pa.array([x[i] for x in sizes], pa.int64()) for i in (0, 1))],
                                             ["node", "size", "sampled"])

    w = Window.partitionBy("h")
    posted = (pick(sets.select("node", "f"), nodes, ["node"], "inner").select("node", "family", "component", "f")
              .mapInArrow(trimmed(post), "h int, node long, component long"))
    shared = (posted.withColumn("lo", F.min("component").over(w)).withColumn("hi", F.max("component").over(w)).where("lo < hi")
              .groupBy("node").agg(F.count("*").alias("shared")))
    # Of all sets, so that their features meet the nodes once only.
    sizes = sets.select("node", "f").mapInArrow(trimmed(count), "node long, size long, sampled long")
    unshared = F.col("sampled") - F.coalesce("shared", F.lit(0))
    return sizes.join(shared, "node", "left").where(unshared * den <= F.col("size") * (den - num)).select("node").join(nodes, "node")


def _undecided(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, component) of ``nodes`` (node, family, component, f): a rare
    feature that nodes of several components of one family have among their
    rarest, as a hash of both."""
    common = nodes.sparkSession.sparkContext.broadcast(_commonness(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                keys = [_mix(rarest(f.values.to_numpy().view(_U), common.value, num, den) ^ k)
                        for f, k in zip(b.column("f"), _families(b), strict=True)]
                times = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.repeat(b.column(x).to_numpy(), times)) for x in ("node", "component"))],
                    ["key", "node", "component"])

    keyed = staged(nodes.select("node", "family", "component", "f").mapInArrow(trimmed(run), "key long, node long, component long"), "rarest")
    mixed = keyed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    out = staged(keyed.join(staged(mixed.select("key"), "mixed"), "key"), "undecided")
    discard(keyed)
    return out


def _block_links(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between the components in one block: all intersections by products
    of incidence matrices, and of the links found a forest."""
    sets = [np.asarray(f, np.int64) for f in pdf["f"]]
    nodes, comps = pdf["node"].to_numpy(), pdf["component"].to_numpy()
    n, size = len(sets), np.array([len(f) for f in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1  # the others are in no intersection
    row, col = np.repeat(np.arange(n), size)[shared], (np.cumsum(times > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col, both = row[order], col[order], np.zeros((n, n))
    for at in range(0, int((times > 1).sum()), COLUMNS):
        i, j = np.searchsorted(col, (at, at + COLUMNS))
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[i:j], col[i:j] - at] = 1.0
        both += m @ m.T
    near = (both * den >= (size[:, None] + size[None, :] - both) * num) & (comps[:, None] != comps[None, :])
    root = {c: c for c in comps.tolist()}
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near))), strict=True):
        ends = []
        for c in (comps[i], comps[j]):
            while root[c] != c:
                c = root[c]
            ends.append(c)
        if ends[0] != ends[1]:
            root[ends[1]] = ends[0]
            out.append((nodes[i], nodes[j]))
    del sets, row, col, both, near
    give_back()
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _rest(pairs: DataFrame, sets: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components of the nodes that ``pairs``
    connect, in one step or more: two linked sets share a signature, and its
    stars hang together.  Of the nodes so connected, those of several components
    that have a rare feature in common form families; a family is compared in
    blocks, all with all but for two nodes of its largest component."""
    spark = pairs.sparkSession
    nothing = spark.range(0).selectExpr("id AS a", "id AS b")
    whole = components(pairs).withColumnRenamed("component", "family")
    of = staged(whole.join(comp, "node", "left").select("node", "family", F.coalesce("component", "node").alias("component")), "members")
    mixed = of.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_nodes = staged(of.join(staged(mixed.select("family"), "families"), "family").select("node", "family", "component"), "open")
    if open_nodes.isEmpty():
        return nothing
    sharing = staged(_sharing(open_nodes, sets, num, den), "sharing")
    left = _undecided(pick(sets.select("node", "f"), sharing, ["node"], "inner"), num, den)
    # Nodes of one feature hang together through its smallest node.
    least = staged(left.groupBy("key").agg(F.min("node").alias("centre")), "centres")
    families = components(left.join(least, "key").select("node", "centre").where("node != centre").distinct(), "node", "centre")
    member = staged(families.withColumnRenamed("component", "family").join(left.select("node", "component").distinct(), "node")
                    .join(sets.select("node", F.size("f").alias("size")), "node"), "members")
    if member.isEmpty():
        return nothing
    parts = member.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    need = F.greatest(F.ceil(F.sum("n") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_FEATURES))
    main = parts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    split = staged(parts.join(main, "family").groupBy("family", "main", (F.col("component") == F.col("main")).alias("large"))
                   .agg(need.cast("int").alias("blocks")), "blocks")
    counts = staged(split.groupBy("family", "main").agg(F.coalesce(F.max(F.when(~F.col("large"), F.col("blocks"))), F.lit(0)).alias("minor"),
                                                        F.coalesce(F.max(F.when(F.col("large"), F.col("blocks"))), F.lit(0)).alias("major")),
                    "families")
    dealt = staged(member.join(counts, "family"), "dealt")
    # Blocks are numbered, those outside the largest component first.  A node
    # goes to every pair of its own block and another, if one of them is such.
    large = F.col("component") == F.col("main")
    hashed = F.xxhash64("node")
    own = F.when(large, F.col("minor") + F.pmod(hashed, F.greatest("major", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("minor", F.lit(1)))).cast("int")
    last = F.when(large, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1
    dealt = (dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
             .select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component"))
    return dealt.join(sets.select("node", "f"), "node").groupBy("family", "i", "j").applyInPandas(lambda pdf: _block_links(pdf, num, den), "a long, b long")


def _coinciding(rows: DataFrame) -> frozenset[int]:
    """Nodes that unequal sets have, by their second digests: about n * n / 4e19
    of n, so some sixty in 5e10."""
    found = (rows.where("node IS NOT NULL").groupBy("node").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
             .where("lo < hi").select("node").limit(1 + MOST_COINCIDING).collect())
    if len(found) > MOST_COINCIDING:
        raise RuntimeError(f"more than {MOST_COINCIDING} digests coincide")
    return frozenset(r["node"] for r in found)


def similar_classes(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, keep) of every row of ``docs``
    (doc_id, text): classes of documents linked by a Jaccard similarity of at
    least ``num / den`` of their n-word shingle sets; ``keep`` marks the row of
    the smallest id in its class (equal rows alike), ``key`` is ``row_id``."""
    bounded_batches(docs.sparkSession)
    docs = _keyed(docs)
    rows = staged(_sets(docs, n), "sets")
    taken = _coinciding(rows)
    if taken:
        rows = rows.withColumn("node", F.when(F.col("node").isin(*taken), F.col("second")).otherwise(F.col("node")))
    # Of each node, one document's key, and how many equal rows have it.
    sizes = (rows.where("node IS NOT NULL").groupBy("node", "key").agg(F.first("n_shingles").alias("size"), F.count("*").alias("n"))
             .groupBy("node").agg(F.first("size").alias("size"), F.min("key").alias("key"), F.min_by("n", "key").alias("n")))
    w = Window.partitionBy("sig")
    star = (_signed(docs, n, num, den, taken).withColumn("least", F.min("node").over(w))
            .select(F.coalesce("centre", "least").alias("a"), F.col("node").alias("b"), F.coalesce("n", F.lit(1)).alias("n")).where("a != b")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))
    pairs = staged(star, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = staged(sizes.join(nodes, "node"), "nodes")
    chosen = pick(docs.select("key", "text"), known.select("key"), ["key"])
    if not known.where("n > 1").isEmpty():  # repeated rows
        chosen = chosen.dropDuplicates(["key"])
    sets = staged(_arrays(chosen, n, taken), "arrays")
    links = _settled(pairs, sets, num, den)
    comp = components(links)
    more = staged(_rest(pairs.select("a", "b"), sets, comp, num, den), "links")
    comp = components(links.unionByName(more))
    for t in (pairs, sets, links, more):
        discard(t)
    named = rows.where("node IS NOT NULL").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Of each component the row with the smallest id stays, nulls last.  Written
    # first, so that the join of a large component's rows can be split.
    least = staged(named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("least")), "least")
    cols = ["doc_id", "n_shingles", "component_id", "key", "keep"]
    return (named.join(least, "component")
            .select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), "key",
                    (F.col("key") == F.col("least.key")).alias("keep")).select(cols)
            .unionByName(rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key",
                                                           F.lit(True).alias("keep"))))
