"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings is trained
from confirmed toxic texts and unlabelled ones only.  With prior p, the risk is
p R(toxic as toxic) + max(0, R(unlabelled as clean) - p R(toxic as clean)),
with the sigmoid loss; where the second part would fall below zero, the step
climbs it instead.  Training takes a bounded hash sample (``positives``,
``unlabelled``: rows in the mean) in one task, with numpy; scoring runs in
Arrow batches over every whole text.

Defined results: null and empty texts get the score of a text without
features; rows are scored each by its own text, so equal texts get equal
scores; labels that are null, or of documents that are not there, teach
nothing; of several labels of one document the highest counts; without any
toxic label every score is 0; an empty table gives no rows; extra columns stay
as they are.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import at_most, bounded_batches, crc_mod, drawn, give_back, pick, staged, trimmed

POSITIVES, UNLABELLED, FEATURES = 1500, 4000, 1000
#: Word beginnings, in bytes.
BEGINNINGS = (4, 5, 6)
KEPT_WORDS = 400_000
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_PLAIN).split())


def word_features(word: bytes) -> list[bytes]:
    return [b"=" + word] + [b"%d" % n + word[:n] for n in BEGINNINGS if len(word) >= n]


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def __post_init__(self):
        self.words: dict[bytes, tuple[bytes, ...]] = {}

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        known, found = self.words, set()
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(x for x in word_features(w) if x in self.weights)
            if f:
                found.update(f)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def fit(texts: list[str | None], toxic: list[bool], prior: float, n_features: int = FEATURES, steps: int = 250,
        rate: float = 0.08, decay: float = 1e-4) -> Model:
    """Train on ``toxic`` texts (True) and unlabelled ones (False)."""
    y = np.array(toxic, bool)
    n_p, n_u = int(y.sum()), int((~y).sum())
    if not n_p or not n_u:
        return Model({}, 0.0)
    same: dict[bytes, bytes] = {}  # equal words of several texts are kept once
    words = [{same.setdefault(w, w) for w in words_of(t)} for t in texts]
    in_p, in_u = Counter(), Counter()
    for s, p in zip(words, toxic, strict=True):
        if p:
            in_p.update({f for w in s for f in word_features(w)})
    least = 2 if n_p < 200 else 4
    some = {f for f, c in in_p.items() if c >= least}
    in_p = {f: in_p[f] for f in some}
    known = {w: fs for w in same if (fs := [f for f in word_features(w) if f in some])}
    features = lambda s: {f for w in s for f in known.get(w, ())}  # noqa: E731 - one text's at a time
    for s, p in zip(words, toxic, strict=True):
        if not p:
            in_u.update(features(s))
    lift = {f: (in_p[f] / n_p) / ((in_u[f] + 1) / (n_u + 1)) for f in some}
    names = sorted((f for f, v in lift.items() if v >= 1.5),
                   key=lambda f: (-in_p[f] * math.log(lift[f]), f))[:n_features]
    if not names:
        return Model({}, 0.0)
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(words), len(names)), np.float32)
    for i, s in enumerate(words):
        x[i, [place[f] for f in features(s) & place.keys()]] = 1.0
    xp, xu = x[y], x[~y]
    w, b = np.zeros(len(names)), -1.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        w32 = w.astype(np.float32)
        sp = 1 / (1 + np.exp(-np.clip(xp @ w32 + b, -50, 50)))
        su = 1 / (1 + np.exp(-np.clip(xu @ w32 + b, -50, 50)))
        # Sigmoid loss: of a toxic text as toxic 1 - s, of a text as clean s.
        gp, gu = sp * (1 - sp) / n_p, su * (1 - su) / n_u
        negative = su.mean() - prior * sp.mean()
        up, uu = (-prior * gp - prior * gp, gu) if negative >= 0 else (prior * gp, -gu)
        g = np.concatenate([up.astype(np.float32) @ xp + uu.astype(np.float32) @ xu + decay * w, [up.sum() + uu.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model({f: float(c) for f, c in zip(names, w, strict=True) if c}, float(b))


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES,
          unlabelled: int = UNLABELLED) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), of
    both only rows where ``learn`` (an expression over doc_id) is true."""
    bounded_batches(docs.sparkSession)
    known = staged(labels.where(learn & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                   .agg(F.max("toxic").alias("toxic")), "labels")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model({}, 0.0)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(learn)
    share = min(1.0, positives / toxic)
    some = known.where("toxic = 1").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(share * (1 << 24))).select("doc_id")
    sure = at_most(pick(texts, staged(some, "positives"), ["doc_id"]).select("doc_id", "text"), 2 * positives)
    other = at_most(drawn(texts, unlabelled / max(1, texts.count())).select("doc_id", "text"), 2 * unlabelled)
    rows = sure.withColumn("toxic", F.lit(True)).unionByName(other.withColumn("toxic", F.lit(False)))
    prior = toxic / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In an order of its own: rows arrive as the tasks before end.
        got = sorted({(r["toxic"], -1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for b in batches for r in b.to_pylist()})
        model = fit([t for *_, t in got], [p for p, *_ in got], prior)
        yield pa.RecordBatch.from_pydict({"m": pa.array([pickle.dumps((model.weights, model.bias))], pa.binary())})

    made = rows.repartition(1).mapInArrow(trimmed(run), "m binary").collect()
    return Model(*pickle.loads(made[0]["m"])) if made else Model({}, 0.0)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        m = shared.value
        out = pa.array([m.score(t.as_py()) for t in text], pa.float64())
        give_back()
        return out

    return docs.withColumn(name, run("text"))


def learnable(mod: int, held: int) -> Column:
    """True for documents outside the held-out fold; null ids teach nothing."""
    return F.coalesce(crc_mod("doc_id", mod) != held, F.lit(False))
