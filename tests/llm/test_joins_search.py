import hashlib
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrid.llm import decontaminate, ngram_join, permutation_index
from casegrid.llm.graph import components
from casegrid.llm.queries import QUERIES


def shingles(text, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows, n, num, den):
    """{doc_id: (size, smallest id reachable)} by comparing all pairs."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def got_classes(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_op6_against_all_pairs(spark, sf, texts):
    assert got_classes(QUERIES["op6_ngram_join"](spark, sf)) == classes(texts.items(), 3, 90, 100)


def near_copies(seed):
    rnd, rows = random.Random(seed), []
    for size in (1, 2, 3, 6, 9, 14, 25, 60, 200, 700):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(size)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, size // 12))):
                copy[rnd.randrange(size)] = f"v{rnd.randint(0, 40)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 60)])
def test_near_copies_of_every_degree(spark, docs_of, n, num):
    rows = near_copies(n * num)
    assert got_classes(ngram_join.similar_classes(docs_of(rows).repartition(6, "doc_id"), n, num, 100)) == classes(rows, n, num, 100)


@pytest.mark.parametrize(("n", "num", "nodes", "size"), [(5, 80, 3, 1 << 20), (3, 90, 1000, 300)])
def test_families_are_settled_in_blocks(spark, docs_of, monkeypatch, n, num, nodes, size):
    """All nodes in one family, and no link found before."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)
    monkeypatch.setattr(ngram_join, "BLOCK_FEATURES", size)
    rows = near_copies(n + num)
    docs = docs_of(rows)
    sets = ngram_join._arrays(docs, n).dropDuplicates(["node"]).cache()
    nodes = sorted(r["node"] for r in sets.select("node").collect())
    pairs = spark.createDataFrame([(nodes[0], x) for x in nodes[1:]], "a long, b long")
    for known in (0, 40):  # so many of the links beforehand, which make a large component
        want = classes(rows, n, num, 100)
        by_text = {t: ngram_join.digest(ngram_join.features(t.encode(), n)) for _, t in rows}
        group = {by_text[t]: want[d][1] for d, t in rows}
        first = [(min(x for x in nodes if group[x] == group[y]), y) for y in nodes][:known]
        comp = components(spark.createDataFrame([e for e in first if e[0] != e[1]], "a long, b long"))
        found = ngram_join._rest(pairs, sets, comp, num, 100).collect()
        links = [e for e in first if e[0] != e[1]] + [(r["a"], r["b"]) for r in found]
        root = {x: x for x in nodes}
        for _ in range(60):
            for x, y in links:
                root[x] = root[y] = min(root[x], root[y])
        assert {frozenset(x for x in nodes if root[x] == root[y]) for y in nodes} == {frozenset(x for x in nodes if group[x] == group[y]) for y in nodes}


def test_unlike_sets_share_few_signatures():
    rnd = np.random.default_rng(5)
    for size in (30, 150, 600, 2000):
        held = {}
        for i in range(300):
            for s in ngram_join.signatures(np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64)), 80, 100).tolist():
                held.setdefault(s, set()).add(i)
        assert max(map(len, held.values())) <= 30
        assert len(set().union(*(v for v in held.values() if len(v) > 1))) <= 30


def test_cell_counts_never_exceed_the_difference():
    rnd = np.random.default_rng(7)
    for size in (3, 100, 1000, 1100, 5000):
        for other in (size, int(size * 1.2) + 1):
            a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[:int(size * 0.7)], rnd.integers(0, 1 << 63, other - int(size * 0.7)).astype(np.uint64)]))
            got = ngram_join.apart(ngram_join.cells(a).tobytes(), ngram_join.cells(b).tobytes())
            assert got <= len(np.setxor1d(a, b)) and got == ngram_join.apart(ngram_join.cells(b).tobytes(), ngram_join.cells(a).tobytes())
    a, b = (np.unique(rnd.integers(0, 1 << 63, 5000).astype(np.uint64)) for _ in range(2))
    assert ngram_join.apart(ngram_join.cells(a).tobytes(), ngram_join.cells(b).tobytes()) > 10_000 * 20 // 180  # unlike sets of any size are told apart


def test_coinciding_digests_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7), (None, None)], "node long, second long")
    assert ngram_join._coinciding(rows) == {2}
    f = ngram_join.features(b"one two three four", 2)
    assert ngram_join.digest(f, frozenset([ngram_join.digest(f)])) == ngram_join.second_digest(f.tobytes()) != ngram_join.digest(f)


def test_chains_are_joined_without_a_link_to_the_centre(spark, docs_of):
    """Each text is near the next only; the first is not near the last."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * 6:i * 6 + 200])) for i in range(20)]
    assert got_classes(ngram_join.similar_classes(docs_of(rows).repartition(8, "doc_id"), 3, 90, 100)) == classes(rows, 3, 90, 100)


def test_signatures_meet_the_bound():
    rnd = np.random.default_rng(2)
    for num in (80, 90):
        for size in (5, 12, 30, 100, 333, 900):
            for _ in range(20):
                a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
                b = a[rnd.random(len(a)) < 0.97]
                b = np.unique(np.concatenate([b, rnd.integers(0, 1 << 63, max(0, int(size * 0.03))).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both):
                    assert np.intersect1d(ngram_join.signatures(a, num, 100), ngram_join.signatures(b, num, 100)).size


def test_join_edge_rows(spark, docs_of):
    rows = [(3, "a b c d"), (3, "a b c d"), (4, "A  b\tC\nd"), (None, "a b c d"), (5, None), (6, ""), (7, " \n"), (8, "x"), (9, "X"),
            (None, None), (1, "long " * 40000), (2, "long " * 39999), (3, "other text here")]
    got = sorted(map(str, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_classes(docs_of(rows)).collect()]))
    want = [(3, 2, 3), (3, 2, 3), (4, 2, 3), (None, 2, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (None, 0, None), (1, 1, 1),
            (2, 1, 1), (3, 1, 3)]
    assert got == sorted(map(str, want))
    assert ngram_join.similar_classes(docs_of([])).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randint(0, 60), 100 + rnd.randint(0, 60)) for _ in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7_equals_its_sql_on_edge_rows(spark, docs_of):
    items = [("1", " ".join(f"k{i}" for i in range(20))), ("2", "short item"), ("3", None), ("4", "..."), ("5", "short ITEM"), (None, "rare thing"),
             ("6", "the the the the the the the the the the the the the")]
    long = " ".join(f"k{i}" for i in range(3, 17))
    rows = [(1, f"x {long} y"), (2, None), (3, ""), (4, "Short, item!"), (5, "item short"), (None, "a short item"), (1, "other"), (1, "other"),
            (6, "the " * 40), (7, "rare thing"), (8, "w " * 20000 + "short item"), (9, " ".join(f"k{i}" for i in range(12)))]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id string, text string, phrase string")
    got = sorted(map(str, [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"])
                           for r in decontaminate.contamination(docs_of(rows), bench).collect()]))
    want = [(1, 16, 14, ["1"], True), (2, 0, 0, [], False), (3, 0, 0, [], False), (4, 2, 2, ["2", "5"], True), (5, 2, 0, [], False),
            (None, 3, 2, ["2", "5"], True), (1, 1, 0, [], False), (1, 1, 0, [], False), (6, 40, 40, ["6"], True), (7, 2, 2, [], True),
            (8, 20002, 2, ["2", "5"], False), (9, 12, 0, [], False)]
    assert got == sorted(map(str, want))
    assert decontaminate.contamination(docs_of([]), bench).count() == 0
    assert decontaminate.contamination(docs_of(rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_phrase_and_proximity_matches(spark, docs_of):
    bench = spark.createDataFrame([("1", "alpha beta gamma delta")], "item_id string, text string")
    rows = [(1, "q alpha beta gamma delta"), (2, "alpha beta q gamma q delta"), (3, "alpha " + "q " * 60 + "beta gamma delta"), (4, "alpha beta gamma")]
    got = sorted((r["doc_id"], r["start"], r["kind"]) for r in decontaminate.matches(docs_of(rows), bench).collect())
    assert got == [(1, 1, "phrase"), (2, 0, "near")]


def test_lists_carry_no_texts(spark, docs_of):
    """What is shuffled for each posting is numbers; words are counted once."""
    bench = spark.createDataFrame([("1", "alpha beta gamma delta")], "item_id string, text string")
    docs = docs_of([(1, "alpha beta gamma delta")])
    offsets, windows = decontaminate._offsets(decontaminate._keyed(docs), decontaminate.item_words(bench), 13, 3)
    assert {kind for _, kind in offsets.dtypes} <= {"bigint", "int"}
    plan = decontaminate._agreeing(offsets, windows, "start")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan
    found = decontaminate.contamination(docs, bench).where("contaminated").select("key")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert found.count() == 1


def test_windows_wider_than_a_mask(spark, docs_of):
    """Places 64 apart share a bit; the word-for-word check decides."""
    item = [f"k{i:03}" for i in range(200)]
    bench = spark.createDataFrame([("1", " ".join(item))], "item_id string, text string")
    rows = [(1, " ".join(["q"] * 3 + item)), (2, " ".join(item[:130])), (3, " ".join(item[:100] + ["x"] + item[100:])), (4, "k000 " + "q " * 63 + "k064 k065 k066")]
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.contamination(docs_of(rows), bench, window=100).collect()}
    assert got == {1: (200, ["1"]), 2: (130, ["1"]), 3: (200, ["1"]), 4: (0, [])}


def test_vocabulary_in_slices(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "TERMS", 3)
    bench = spark.createDataFrame([("1", "one two three four"), ("2", "five six")], "item_id string, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs_of([(1, "one two three four five six"), (2, "two one")]), bench).collect()}
    assert got == {1: ["1", "2"], 2: []}


def exact(rows, queries, k=10):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_op9_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    want = exact(rows, [i for i, _ in rows if i % 100 == 0])
    got = {}
    for r in QUERIES["op9_permutation_index"](spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = 0
    vectors = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(np.linalg.norm(np.array(vectors[q], float) - np.array(vectors[i], float)), rel=1e-12)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_search_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 9), (1, [1.0, 0.0], 9), (2, [0.0, 1.0], 9), (3, None, 9), (4, [0.0, 0.0], 9), (5, [nan, 1.0], 9), (6, [inf, 1.0], 9),
            (7, [None, 1.0], 9), (None, [1.0, 1.0], 9), (8, [], 9), (9, [1.0, 2.0, 3.0], 9), (2, [0.0, 1.0], 9), (100, [5.0, 5.0], 9), (200, [1.0, 1.0, 1.0], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in permutation_index.search(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, round(2**0.5, 6)), (0, 3, 100, round(41**0.5, 6)), (100, 1, 0, round(41**0.5, 6)), (100, 2, 1, round(41**0.5, 6)),
                   (100, 3, 2, round(41**0.5, 6)), (200, 1, 9, round(5**0.5, 6))]
    assert permutation_index.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_a_crowd_of_equal_vectors_is_searched_whole(spark):
    rnd = np.random.default_rng(1)
    centre = rnd.standard_normal(16)
    rows = [(i, (centre + 1e-3 * rnd.standard_normal(16)).tolist()) for i in range(600)] + [(600 + i, rnd.standard_normal(16).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.search(frame, F.col("vec_id") % 100 == 0).collect()
    want = exact(rows, range(0, 1200, 100))
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * 120


def test_items_digest(spark, sf):
    rows = QUERIES["op7_decontaminate"](spark, sf).collect()
    assert {r["items_sha256"] for r in rows if not r["n_items"]} == {hashlib.sha256(b"").hexdigest()}


def test_matches_by_place(spark, docs_of):
    item = [f"k{i:02}" for i in range(13)]
    bench = spark.createDataFrame([("1", " ".join(item)), ("2", "one two three four missing")], "item_id string, text string")
    apart = " ".join(f"{w} " + "q " * 30 for w in item[3:]) * 12
    same_places = " ".join(item[:3] + ["z"] * 10)
    near = "k00 q q k01 k02"
    rows = [(1, " ".join(item)), (2, same_places), (3, apart), (4, " ".join(["q"] * 7 + item + ["q"] * 80) + f" {near} " + "q " * 100 + near),
            (5, "q " * 50 + "one two q three four"), (6, "q " * 40 + "k00 " + "q " * 59 + near)]
    got = sorted((r["doc_id"], r["start"], r["kind"]) for r in decontaminate.matches(docs_of(rows), bench).collect())
    assert got == [(1, 0, "phrase"), (2, 0, "near"), (4, 7, "phrase"), (4, 100, "near"), (4, 205, "near"), (5, 50, "near"), (6, 100, "near")]
