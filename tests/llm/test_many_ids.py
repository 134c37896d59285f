"""Ids too many to be held by the driver: rows are picked by a map of one size and a shuffle."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casegrid.llm import common, ngram_join

from .test_joins_search import classes, got_classes, near_copies


@pytest.fixture
def unhinted(spark):
    """Spark broadcasts nothing of its own accord."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("how", "kept"), [("left_semi", 120_000), ("left_anti", 30_000), ("inner", 120_000)])
def test_many_ids_are_not_broadcast(spark, unhinted, how, kept):
    rows = spark.range(150_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("key"), "id")
    ids = common.staged(rows.where("id < 120000").select("key"), "ids")
    got = common.pick(rows, ids, ["key"], how)
    assert "Broadcast" not in plan(got)
    assert got.agg(F.count("*"), F.countDistinct("id"), F.sum(F.when(F.col("id") < 120000, 1).otherwise(0))).first()[:] == (
        kept, kept, 0 if how == "left_anti" else kept)
    few = ids.limit(50)
    assert "Broadcast" in plan(common.pick(rows, few, ["key"], how))


@pytest.mark.parametrize("bits", [6, 25])
def test_picking_by_the_map(spark, monkeypatch, bits):
    """Null keys, repeated rows, integers of another width, several columns; a map with nearly all bits set, too."""
    monkeypatch.setattr(common, "PICKED_IDS", 0)
    monkeypatch.setattr(common, "MAP_BITS", bits)
    rows = spark.createDataFrame([(i % 500 if i % 7 else None, f"t{i % 3}") for i in range(1500)], "k int, t string")
    ids = spark.range(200).selectExpr("id * 2 AS k")
    picked = [(k, t) for k, t in map(tuple, rows.collect()) if k is not None and k % 2 == 0 and k < 400]
    other = [(k, t) for k, t in map(tuple, rows.collect()) if k is None or k % 2 or k >= 400]
    for how, want in (("left_semi", picked), ("left_anti", other)):
        got = common.pick(rows, ids, ["k"], how)
        assert got.columns == ["k", "t"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    pairs = spark.createDataFrame([(2, "t0"), (2, "t1"), (499, "t2"), (None, "t0")], "k long, t string")
    want = [x for x in map(tuple, rows.collect()) if x in {(2, "t0"), (2, "t1"), (499, "t2")}]
    assert sorted(map(tuple, common.pick(rows, pairs, ["k", "t"]).collect())) == sorted(want)
    assert common.pick(rows, ids.limit(0), ["k"]).count() == 0 and common.pick(rows, ids.limit(0), ["k"], "left_anti").count() == 1500


@pytest.mark.parametrize(("bits", "n", "num"), [(4, 5, 80), (25, 3, 90)])
def test_classes_with_many_ids(spark, docs_of, monkeypatch, bits, n, num):
    monkeypatch.setattr(common, "PICKED_IDS", 0)
    monkeypatch.setattr(common, "MAP_BITS", bits)
    rows = near_copies(n + num)
    assert got_classes(ngram_join.similar_classes(docs_of(rows), n, num, 100)) == classes(rows, n, num, 100)


@pytest.mark.parametrize("known", [False, True])
@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_families_with_many_nodes(spark, docs_of, monkeypatch, ids, known):
    """All nodes hang together by signatures, and no link or every second one is known."""
    monkeypatch.setattr(common, "PICKED_IDS", ids)
    monkeypatch.setattr(common, "MAP_BITS", 6)
    rows = near_copies(11)
    docs = docs_of(rows)
    sets = ngram_join._arrays(docs, 5).dropDuplicates(["node"]).cache()
    of = {d: ngram_join.digest(ngram_join.features(t.encode(), 5)) for d, t in rows}
    want = classes(rows, 5, 80, 100)
    nodes = sorted(set(of.values()))
    pairs = spark.createDataFrame([(nodes[0], x) for x in nodes[1:]], "a long, b long")
    links = [(of[c], of[d]) for d, (_, c) in want.items() if of[c] != of[d] and known and d % 2]
    comp = ngram_join.components(spark.createDataFrame(links, "a long, b long"))
    links += [(r["a"], r["b"]) for r in ngram_join._rest(pairs, sets, comp, 80, 100).collect()]
    root = {x: x for x in nodes}
    for _ in range(60):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    groups = {}
    for d, (_, c) in want.items():
        groups.setdefault(c, set()).add(of[d])
    assert {frozenset(x for x in nodes if root[x] == root[y]) for y in nodes} == {frozenset(g) for g in groups.values()}


def test_duplicates_go_with_many_ids(spark, docs_of, monkeypatch):
    monkeypatch.setattr(common, "PICKED_IDS", 0)
    text = "one two three four five six seven"
    docs = docs_of([(1, text), (1, text), (2, text), (None, text), (3, None), (3, None), (4, "quite other words in this text")])
    kept = corpus_pipeline.without_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(1, text), (3, None), (3, None), (4, "quite other words in this text")], key=str)
