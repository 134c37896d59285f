import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrid.llm import centroids, exact_dedup, spelling
from casegrid.llm.queries import QUERIES

# -- exact duplicates -------------------------------------------------------


@pytest.mark.parametrize("values", [[0], [5], [0, 1, 2, 3], [7, 1 << 20, (1 << 40) + 1], list(range(0, 5000, 7)), [(1 << 63) + 5]])
def test_golomb_round_trip(values):
    v = np.array(values, np.uint64)
    k, code = exact_dedup.golomb_encode(v)
    assert exact_dedup.golomb_decode(k, code, len(v)).tolist() == values


def test_golomb_code_is_short():
    v = np.unique(np.random.default_rng(1).integers(0, 256 * 10_000, 10_000, dtype=np.uint64))
    _, code = exact_dedup.golomb_encode(v)
    assert len(code) * 8 / len(v) < 10.5  # log2(256) + 1.5 and rounding; 64 as they are


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _dedup_brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(_lower(t), []).append((d, i))
    out = []
    for text, members in groups.items():
        ids = [d for d, _ in members if d is not None]
        keep = max(ids, default=None)
        sha, first = hashlib.sha256(text.encode()).hexdigest(), True
        for d, _ in members:
            out.append((d, keep, len(members), d == keep and first, sha))
            first = first and d != keep
    return sorted(map(str, out))


ODD = [(1, "Same"), (2, "sAME"), (3, "same "), (None, None), (4, ""), (5, None), (6, "ÀB"), (7, "àb"), (8, "Àb"), (9, "rep"), (9, "rep"),
       (9, "rep"), (None, "null ids"), (None, "NULL ids"), (10, "long " * 200_000), (11, "LONG " * 200_000), (12, "one of its own")]


def test_dedup_of_odd_rows(spark, docs_of):
    got = exact_dedup.exact_duplicates(docs_of(ODD).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == _dedup_brute(ODD)
    assert sum(r.kept for r in got) == len({_lower(t) for _, t in ODD})


@pytest.mark.parametrize("of", [lambda t: 7, lambda t: len(t) % 3, lambda t: (1 << 64) - 1 - len(t)])
def test_dedup_does_not_depend_on_the_fingerprint(spark, docs_of, of):
    rows = [(i, f"text {i % 17}") for i in range(60)] + ODD
    got = exact_dedup.exact_duplicates(docs_of(rows).repartition(4), of).collect()
    assert sorted(map(str, map(tuple, got))) == _dedup_brute(rows)


def test_dedup_of_a_large_group(spark):
    docs = spark.range(0, 20_000, 1, 7).select(F.col("id").alias("doc_id"),
                                               F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.exact_duplicates(docs)
    assert got.count() == 20_000
    assert [tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()] == [(19_998, 6667)]
    assert got.where("kept").count() == 20_000 - 6666


def test_dedup_of_several_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK_ROWS", 2 * exact_dedup.BLOCK_ROWS)  # sent to the tasks with the function
    docs = spark.range(0, 14_000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 9000).cast("string")).alias("text"))
    sent = exact_dedup.messages(docs, 14_000 * exact_dedup.SPARE, 3).collect()
    assert {(r.part, r.chunk) for r in sent} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert sorted(len(r.blocks) for r in sent if r.blocks) == [2, 2, 2, 2]
    got = exact_dedup.exact_duplicates(docs)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [
        (i, i % 9000 + 9000 if i % 9000 < 5000 else i, 2 if i % 9000 < 5000 else 1, i >= 5000) for i in range(14_000)]


def test_rows_of_changed_blocks_are_suspects():
    h = np.array([5, 6], np.uint64).tobytes()
    block = ([1, None], [b"a", b"b"], h)
    none = (zlib.crc32(h), np.empty(0, np.uint64).tobytes())
    assert [m[4] for m in exact_dedup._marked(2, [(block, none)], 1000)] == [None, None]
    assert [m[4] for m in exact_dedup._marked(2, [(block, (zlib.crc32(h), np.array([6], np.uint64).tobytes()))], 1000)] == [None, "b"]
    assert [m[4] for m in exact_dedup._marked(2, [(block, (1, none[1]))], 1000)] == ["a", "b"]


def test_dedup_of_nothing(spark, docs_of):
    got = exact_dedup.exact_duplicates(docs_of([]))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and not got.collect()


# -- spelling variants ------------------------------------------------------


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(counts, times=10):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if _near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(map(str, rows))


def _counted(rows):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in _lower(text) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
                if len(word) >= 7:
                    counts[word] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def _rows(df):
    return sorted(str(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_query_equals_brute_force(spark, sf, texts):
    got = QUERIES["op12_spelling_variants"](spark, sf)
    assert _rows(got) == _variants(_counted(texts.items()))


def test_spelling_of_odd_rows(spark, docs_of):
    run = "abcdefgh" * 60
    rows = [(None, "Wordsmith wordsmith Wordsmith"), (1, None), (1, ""), (2, "wordsmiths wordsmith"), (2, "wordsmiths wordsmith"),
            (3, "aaaaaaaa aaaaaaa " * 40 + "aaaaaaab aaaaaaab"), (4, "Ààààààà×÷ ààààààà×÷ Àààààààa÷"), (5, "wordsmith " * 30_000),
            (6, f"{run} {run}"), (7, f"{run} {run}x {run}x"), (8, (run[:-1] + "q ") * 30), (9, run[:256] + " " + run[:256]),
            (10, (run[:257] + " ") * 20), (11, f"{run[:255]} {run[:255]} {run[1:256]} {run[1:256]}")]
    assert _rows(spelling.spelling_groups(docs_of(rows))) == _variants(_counted(rows))


@pytest.mark.parametrize("long", [2, 5])
def test_hashed_rotations_give_the_same_groups(long):
    words = ["".join(w) for n in (1, 2, 3, 4) for w in itertools.product("ab", repeat=n)] + ["abcabc", "abcab", "abccabc"]
    counts = {w: zlib.crc32(w.encode()) % 5 + 1 for w in words}
    names = {spelling.digest(w): w for w in words}
    groups = {}
    for w, n in counts.items():
        ways = [(spelling.turned(w), None)] if len(w) <= long else [(spelling.turned_long(w), spelling.digest(w))]
        if len(w) == long:
            ways.append(((x for x in spelling.turned_long(w) if x[1] is None), spelling.digest(w)))
        for way, ref in ways:
            for key, last in way:
                groups.setdefault(key, []).append((last, n, ref))
    near, best = Counter(), {}
    for key, rows in groups.items():
        for w, m, n, b in spelling.scan_group(key, rows):
            w, b = names.get(w, w), names.get(b, b)
            near[w] += m
            best[w] = min(best.get(w, (0, "")), (-n, b))
    for w in words:
        want = [v for v in words if _near(v, w)]
        assert near[w] == len(want)
        assert best[w][1] == min(want, key=lambda v: (-counts[v], v))


def test_chains_of_forms(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghik": 2000, "zbcdefg": 19}
    rows = [(i, f"{w} ") for w, n in counts.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(spelling.spelling_groups(docs)) == _variants(_counted(rows))


def test_spelling_of_nothing(spark, docs_of):
    assert not spelling.spelling_groups(docs_of([])).collect()


# -- centroids --------------------------------------------------------------


def _lloyd(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, [int(np.floor(scale * float(x))) if abs(x) < 1e15 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    by = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(v) for _, v in by[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        label = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), c in zip(kept, label, strict=True) if c == j]
            if own:
                cs[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [near(v) for _, v in kept]
    total = Counter()
    for d, j in last:
        total[j] += d
    long = lambda x: x if x < 1 << 63 else None
    return sorted(str((i, j, long(d), total[j] if d < 1 << 63 else None, sum(total.values()) if d < 1 << 63 else None,
                       hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest())) for (i, _), (d, j) in zip(kept, last, strict=True))


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, shard string")


@pytest.mark.parametrize("dims", [3, 16, 40])
def test_centroids_equal_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, (rng.normal(size=dims) + 3 * (i % 4)).tolist()) for i in range(150)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (500, None), (501, []), (502, [0.0] * dims), (503, [float("nan")] + [0.0] * (dims - 1)),
             (504, [None] + [0.0] * (dims - 1)), (505, [float("inf")] * dims), (506, [1.0] * (dims + 1)), (507, [-0.0004] * dims)]
    got = centroids.clusters(_vectors(spark, rows).repartition(3), 5, 6, dims)
    assert sorted(str(tuple(r)) for r in got.collect()) == _lloyd(rows, 5, 6, dims)


def test_centroids_of_few_or_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert sorted(str(tuple(r)) for r in centroids.clusters(_vectors(spark, rows), 8, 10, 2).collect()) == _lloyd(rows, 8, 10, 2)
    none = centroids.clusters(_vectors(spark, []), 8, 10, 2)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not none.collect()


def test_centroids_of_large_components(spark):
    rows = [(i, [float(i), 1e14 * (i % 3), 1e30 if i == 5 else 0.5]) for i in range(12)]
    got = {r.vec_id: r.cluster for r in centroids.clusters(_vectors(spark, rows), 3, 4, 3).collect()}
    import ast
    assert got == {r[0]: r[1] for r in map(ast.literal_eval, _lloyd(rows, 3, 4, 3))}


def test_a_chunk_in_several_shards(spark):
    assert centroids.WIDTH < 64 and centroids.CHUNK > 1
    df = _vectors(spark, [(i, [float(i % 5)] * 20) for i in range(40)])
    blocks = centroids._blocks(centroids.usable(df, 20), 20, 1024).collect()
    assert {r.shard for r in blocks} == {0, 1} and all((r.ids is None) == (r.shard > 0) for r in blocks)
