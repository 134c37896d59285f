"""Quality by votes of the nearest labelled texts in a latent-semantic space.

The terms of a text are its words' shapes (runs of letters and digits as one
sign, other characters as they are), pairs of neighbouring shapes, and words
that repeat the one before.  The labelled sample's terms,
weighted by the root of their share and by idf, are reduced by a truncated
singular value decomposition.  The labelled vectors (at most about
``sample_rows``) are broadcast; for every document the cosines with all of
them are computed exactly, in blocks, and the nearest vote with their
similarity as weight.

Defined results: a null, empty or blank text, and one without a known term,
gets the labelled rows' mean; without labels every score is 0; equal texts get
equal scores; labels that are null, or of documents that are not there, teach
nothing; of several labels of one document the lowest counts; an empty table
gives no rows; extra columns stay as they are.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import at_most, bounded_batches, give_back, pick, staged, trimmed

#: Labelled rows (in the mean), terms, latent dimensions, voters, documents of
#: one block of products.
SAMPLE_ROWS, TERMS, DIMENSIONS, NEIGHBOURS, BLOCK = 4000, 1500, 48, 15, 256
KEPT_WORDS = 400_000
_RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+", re.S), r"\1"))


def _letters(m: re.Match) -> str:
    s = m.group()
    return "A" if s.isupper() and len(s) > 1 else "Aa" if s[0].isupper() else "a"


def shape(word: str) -> str:
    word = _RUNS[0][0].sub(_letters, word[:64]) if len(word) <= 64 else "LONG"
    return _RUNS[2][0].sub(r"\1", _RUNS[1][0].sub("9", word))


class _Cache(dict):
    """``make(word)``, remembered for a bounded number of words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) > KEPT_WORDS:
            self.clear()
        v = self[word] = self.make(word)
        return v


_shapes = _Cache(shape)


def repeats(words: list[str]) -> int:
    return sum(map(str.__eq__, words, words[1:]))


def terms_of(text: str | None) -> tuple[Counter, int]:
    """Counts of the terms (shapes, pairs of shapes, "=="), and of the words."""
    words = (text or "").split()
    s = list(map(_shapes.__getitem__, words))
    out = Counter(s)
    out.update(zip(s, s[1:], strict=False))
    out["=="] = repeats(words)
    return out, len(words)


@dataclass
class Model:
    terms: dict = field(default_factory=dict)
    basis: np.ndarray | None = None  # idf times the right singular vectors
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None

    def __post_init__(self):
        """Tables from words to shapes and from pairs of shapes to terms;
        shape 0 and term len(terms) stand for all unknown ones."""
        none = len(self.terms)
        shapes = sorted({t for t in self.terms if isinstance(t, str)} | {x for t in self.terms if isinstance(t, tuple) for x in t})
        at = {x: i + 1 for i, x in enumerate(shapes)}
        self.single = np.full(len(at) + 1, none)
        self.pair = np.full((len(at) + 1, len(at) + 1), none)
        for t, i in self.terms.items():
            if isinstance(t, tuple):
                self.pair[at[t[0]], at[t[1]]] = i
            else:
                self.single[at[t]] = i
        self.words = _Cache(lambda w: at.get(shape(w), 0))

    def __reduce__(self):
        return Model, (self.terms, self.basis, self.vectors, self.labels)

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        none = len(self.terms)
        for i, t in enumerate(texts):
            words = (t or "").split()
            if not words:
                continue
            s = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            counts = np.bincount(np.concatenate([self.single[s], self.pair[s[:-1], s[1:]]]), minlength=none + 1)
            if "==" in self.terms:
                counts[self.terms["=="]] = repeats(words)
            hit = np.flatnonzero(counts[:none])
            out[i] = np.sqrt(counts[hit] / len(words)).astype(np.float32) @ self.basis[hit]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.vectors is None:
            return np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(texts))
        for i in range(0, len(texts), BLOCK):
            near = self.embed(texts[i:i + BLOCK]) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(near, top, 1), 0.0).astype(float)
            votes, total = (w * self.labels[top]).sum(1), w.sum(1)
            out[i:i + BLOCK] = np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.labels.mean())
        return out


def fit(texts: list[str | None], labels: list[int], n_terms: int = TERMS, dimensions: int = DIMENSIONS) -> Model:
    """Decompose the labelled texts; singular vectors by subspace iteration."""
    if not texts:
        return Model()
    counted = [terms_of(t) for t in texts]
    df = Counter(k for c, _ in counted for k, v in c.items() if v)
    names = sorted(df, key=lambda k: (-df[k], str(k)))[:n_terms]
    place = {k: i for i, k in enumerate(names)}
    x = np.zeros((len(texts), len(names)), np.float32)
    for i, (c, n) in enumerate(counted):
        for k, v in c.items():
            if v and k in place:
                x[i, place[k]] = np.sqrt(v / n)
    if not names or not x.any():
        return Model()
    idf = (1.0 + np.log(len(texts) / np.array([df[k] for k in names]))).astype(np.float32)
    x *= idf
    d = min(dimensions, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(d + 10, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt[:d].T).astype(np.float32)
    model = Model(place, basis * idf[:, None])
    model.vectors, model.labels = model.embed(texts), np.array(labels, float)
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), of
    both only rows where ``learn`` (an expression over doc_id) is true."""
    bounded_batches(docs.sparkSession)
    known = staged(labels.where(learn & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                   .agg(F.min("quality").cast("int").alias("quality")), "labels")
    share = min(1.0, sample_rows / max(1, known.count()))
    some = staged(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(share * (1 << 24))), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = at_most(pick(texts, some.select("doc_id"), ["doc_id"]).join(F.broadcast(some), "doc_id"), 2 * sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({(r["doc_id"], r["text"] or "", r["quality"]) for b in batches for r in b.to_pylist()})
        m = fit([t for _, t, _ in got], [q for *_, q in got])
        yield pa.RecordBatch.from_pydict({"m": pa.array([pickle.dumps(m)], pa.binary())})

    made = rows.mapInArrow(trimmed(run), "m binary").collect()
    return pickle.loads(made[0]["m"]) if made else Model()


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        out = pa.array(shared.value.score(text.to_pylist()), pa.float64())
        give_back()
        return out

    return docs.withColumn(name, run("text"))
