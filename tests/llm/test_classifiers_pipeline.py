import random
import tracemalloc
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casegrid.llm import quality, toxicity
from casegrid.llm.common import at_most, drawn
from casegrid.llm.queries import QUERIES, QUALITY_FOLD, TOXIC_FOLD

from .test_joins_search import classes

LARGE = "/root/testdata/sf0.1"


def crc(doc, mod):
    return zlib.crc32(str(doc).encode()) % mod


# In this table some toxic labels are of texts that later turned to junk and
# hold no toxic word, so not all of them can be found.
@pytest.mark.parametrize(("name", "label", "fold", "least", "share"), [
    ("op8_toxicity", "toxic", TOXIC_FOLD, 0.5, (0.99, 0.85)), ("op10_quality", "quality", QUALITY_FOLD, 0.7, (0.95, 0.95))])
def test_held_out_accuracy(spark, name, label, fold, least, share):
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{LARGE}/labels.parquet'").fetchall())
    ids = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{LARGE}/documents.parquet'").fetchall()}
    rows = QUERIES[name](spark, LARGE).collect()
    assert {r["doc_id"] for r in rows} == ids and len(rows) == len(ids)
    right = {0: [0, 0], 1: [0, 0]}
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"], fold[0]) == fold[1])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
        if r["held_out"] and r["doc_id"] in labels:
            tally = right[labels[r["doc_id"]]]
            tally[0] += r["predicted"] == labels[r["doc_id"]]
            tally[1] += 1
    assert all(right[k][0] >= share[k] * right[k][1] > 0 for k in (0, 1)), right


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_teach_nothing(spark, module, label):
    """Turning every held-out label round changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = toxicity.learnable(5, 0)
    turned = labels.withColumn(label, F.when(learn, F.col(label)).otherwise(1 - F.col(label)))
    a, b = ({r["doc_id"]: r["s"] for r in module.score(docs, module.train(docs, x, learn), "s").collect()} for x in (labels, turned))
    assert a == b and len(set(a.values())) > 10


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_edge_rows(spark, docs_of, module, label):
    rows = [(i, t) for i, t in enumerate(["good plain words here and there", "awful idiot words", None, "", " \n", "word " * 60000, "!" * 30000])]
    rows += [(None, "no id"), (1, "awful idiot words"), (1, "other words")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (99, 0), (5, 0)], f"doc_id long, {label} int")
    for some in (labels, labels.limit(0)):
        scored = module.score(docs, module.train(docs, some, F.lit(True)), "my_score").collect()
        assert len(scored) == len(rows) and all(0 <= r["my_score"] <= 1 and r["score"] == 2.0 for r in scored)
        by_text = {}
        for r in scored:
            by_text.setdefault(r["text"] or "", set()).add(r["my_score"])
        assert all(len(s) == 1 for s in by_text.values())
    assert module.score(docs.limit(0), module.train(docs.limit(0), labels, F.lit(True)), "my_score").count() == 0


def test_positive_unlabelled_learning_finds_hidden_positives():
    clean = [f"some words about topic number {i % 7} and more" for i in range(300)]
    bad = [f"{w} words about topic number {i % 7}" for i in range(60) for w in ("rotten", "vile")]
    # A fifth of the unlabelled texts is toxic, and no text is marked clean.
    model = toxicity.fit(bad[:60] + clean + bad[60:], [True] * 60 + [False] * 360, 60 / 360)
    assert min(map(model.score, bad)) >= 0.5 > max(map(model.score, clean))


def test_training_holds_words_once():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices([f"word{i}" for i in range(3000)], k=150) + [f"u{rnd.random()}" for _ in range(30)]) for _ in range(1300)]
    tracemalloc.start()
    toxicity.fit([f"awful{i % 40} " + t for i, t in enumerate(texts[:300])] + texts[300:], [True] * 300 + [False] * 1000, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000


def test_nearest_labels_decide():
    good, poor = ["Plain words of a sentence, and more."] * 5, ["x *** y *** z ***"] * 5
    model = quality.fit(good + poor, [1] * 5 + [0] * 5)
    a, b, c = model.score(["Other plain words, in a sentence.", "q *** r ***", ""])
    assert a > 0.7 > 0.3 > b and c == 0.5


def test_pipeline_stage_by_stage(spark):
    """Each stage on all its predecessor kept, against brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, bench = docs.columns, [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, sf)
        rows = after.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == before.keys()
            break
        assert after.columns == columns
        kept = {r["doc_id"]: r["text"] for r in rows}
        assert kept.items() <= before.items() and len(rows) == len(kept)
        if name == "near_duplicates":
            assert kept.keys() == {c for _, c in classes(before.items(), 5, 80, 100).values()}
        if name == "decontamination":
            assert kept.keys() == {d for d, t in before.items() if not contaminated(t, bench)}
        docs = spark.createDataFrame(rows, docs.schema)


def contaminated(text, bench):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower() if (t or "").isascii() else "".join(
        c.lower() if c.isascii() else c for c in t))
    w, hit = words(text), set()
    for item in map(words, bench):
        n = min(13, len(item))
        wanted = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
        hit |= {j for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in wanted for j in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_equal_rows_leave_one(spark, docs_of):
    text = "one two three four five six seven"
    docs = docs_of([(1, text), (1, text), (2, text), (None, text), (3, None), (3, None), (4, "quite other words in this text")])
    kept = corpus_pipeline.without_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(1, text), (3, None), (3, None), (4, "quite other words in this text")], key=str)


def test_pipeline_query(spark):
    rows = QUERIES["pipeline"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows[0].asDict())


def test_samples_stay_bounded_where_ids_are_null_or_repeat(spark):
    rows = [(None, f"text {i}") for i in range(3000)] + [(7, f"words {i}") for i in range(3000)] + [(8, "same")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = drawn(docs.where("doc_id is null or doc_id = 7"), 0.1).collect()
    assert 150 < sum(r["doc_id"] is None for r in got) < 450 and 150 < sum(r["doc_id"] == 7 for r in got) < 450
    few = at_most(docs, 500)
    assert few.count() == 500 and few.rdd.getNumPartitions() == 1
    assert at_most(docs.where("doc_id = 8"), 500).count() == 1


def test_training_takes_a_bounded_part_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"some words {i}") for i in range(300)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality.train(docs, labels, F.lit(True), sample_rows=20).labels) == 40
