"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every term (a lower-cased word, or a word's shape such as ``Aa.`` or ``A!!``)
falls in a bucket, and every bucket owns a sparse random index vector.  A
term's vector is the sum of the index vectors of the words and shapes around
it in the labelled rows used for fitting.  A document is the mean of its terms'
vectors; a network of one hidden layer scores it, and a temperature fitted on
rows left out of the network's training calibrates the probability.

Only fitting works on a sample: at most ``sample`` labelled rows, least hashes
of ``doc_id`` first.  Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import encode, groups

#: Labelled rows used for fitting, at most.
SAMPLE = 6000
WORD_BUCKETS, SHAPE_BUCKETS, DIM = 1 << 14, 1 << 10, 32
WINDOW = 2
#: Features beside the pooled vectors: log length, share of words equal to the one before, share of distinct words.
EXTRA = 3
THRESHOLD = 0.7
#: Distinct words that a worker remembers.
CACHE = 200_000

_CLASS = bytes(0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: four of ``DIM`` places are plus or minus one."""
    rng, out = np.random.default_rng(seed), np.zeros((rows, DIM), np.float32)
    places = rng.permuted(np.tile(np.arange(DIM), (rows, 1)), axis=1)[:, :4]
    np.put_along_axis(out, places, rng.choice(np.float32([-1, 1]), (rows, 4)), axis=1)
    return out


class Terms:
    """Buckets of words, remembered."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty((len(words), 2), np.int64)
        known = self.known
        for i, w in enumerate(words):
            found = known.get(w)
            if found is None:
                shape = _RUN.sub(rb"\1", w.translate(_CLASS))
                found = xxhash.xxh32_intdigest(w.lower()) % WORD_BUCKETS, xxhash.xxh32_intdigest(shape, 1) % SHAPE_BUCKETS
                if len(w) <= 40:
                    if len(known) >= CACHE:
                        known.clear()
                    known[w] = found
            out[i] = found
        return out[:, 0], out[:, 1]


def _terms(table: pa.Table, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape buckets of all words of all texts, and the offsets of texts."""
    codes, offsets, distinct = encode(table.column(1))
    word, shape = terms(distinct)
    real = np.fromiter(map(len, distinct), np.int64, len(distinct)) > 0
    keep = real[codes]
    offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    codes = codes[keep]
    return word[codes], shape[codes], offsets


def _context(word: np.ndarray, shape: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the index vectors around every bucket, within documents."""
    index_w, index_s = index_vectors(WORD_BUCKETS, 1), index_vectors(SHAPE_BUCKETS, 2)
    sums_w, sums_s = np.zeros((WORD_BUCKETS, DIM), np.float32), np.zeros((SHAPE_BUCKETS, DIM), np.float32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for at in range(0, len(word), 1 << 16):
        here = slice(at, min(len(word), at + (1 << 16)))
        near = index_w[word[here]] * 0.25 + index_s[shape[here]]
        for d in range(1, WINDOW + 1):
            for step in (-d, d):
                other = np.arange(here.start, here.stop) + step
                valid = (other >= 0) & (other < len(word))
                valid[valid] = owner[other[valid]] == owner[here][valid]
                near[valid] += index_w[word[other[valid]]] + index_s[shape[other[valid]]]
        np.add.at(sums_w, word[here], near)
        np.add.at(sums_s, shape[here], near)
    return sums_w, sums_s


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def _pool(word: np.ndarray, shape: np.ndarray, offsets: np.ndarray, vec_w: np.ndarray, vec_s: np.ndarray) -> np.ndarray:
    """A row of features for each document: mean word vector, mean shape vector, and the ``EXTRA`` ones."""
    out = np.zeros((len(offsets) - 1, 2 * DIM + EXTRA), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        total = np.zeros(2 * DIM)
        for at in range(a, b, 1 << 14):
            part = slice(at, min(b, at + (1 << 14)))
            total[:DIM] += np.bincount(word[part], minlength=WORD_BUCKETS) @ vec_w if part.stop - at > 8192 else vec_w[word[part]].sum(axis=0)
            total[DIM:] += vec_s[shape[part]].sum(axis=0)
        if b > a:
            out[i, : 2 * DIM] = total / (b - a)
            out[i, 2 * DIM :] = np.log1p(b - a) / 8, np.count_nonzero(word[a + 1 : b] == word[a : b - 1]) / (b - a), len(np.unique(word[a:b])) / (b - a)
    return out


@dataclass
class Model:
    """Everything a score needs; a few megabytes whatever the corpus."""

    vec_w: np.ndarray
    vec_s: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((features - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(features).astype(np.float64) / self.temperature, -40, 40)))


def train(features: np.ndarray, labels: np.ndarray, hidden: int = 32, epochs: int = 300, seed: int = 3) -> tuple:
    """Adam on the logistic loss with weight decay, full batches."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(features.shape[1]), (features.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        h = np.tanh(features @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
        out = (p - labels) / len(labels)
        back = out[:, None] * params[2] * (1 - h * h)
        grads = [features.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ out + 1e-4 * params[2], np.array([out.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return params[0], params[1], params[2], float(params[3][0])


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least logistic loss on rows the network hasn't seen."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -np.where(labels > 0, 1, -1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", held_out: bool = True) -> Model:
    """Fit on labelled rows.

    Labels of rows whose ``crc32(doc_id as text) mod 4`` is 2 are never read when
    ``held_out`` is set.  An id that is labelled twice takes its least label;
    null labels are skipped.  Without rows, or with rows of one label only, the
    model scores that label's share (0.5 if there is none) for every text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if held_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
        .select("y", "text", "doc_id")
    )
    rows = materialize(rows, "sample")  # read twice below; the corpus once
    kinds = "kind int, bucket int, doc_id long, y int, v array<float>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_w, total_s, terms = np.zeros((WORD_BUCKETS, DIM), np.float32), np.zeros((SHAPE_BUCKETS, DIM), np.float32), Terms()
        for table in groups(batches):
            w, s = _context(*_terms(table, terms))
            total_w += w
            total_s += s
        for kind, total in ((0, total_w), (1, total_s)):
            hit = np.flatnonzero(np.abs(total).any(axis=1))
            yield _rows(np.full(len(hit), kind), hit, np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64), total[hit])

    def _rows(kind, bucket, doc_id, y, v) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel().astype(np.float32)))
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(doc_id.astype(np.int64)), pa.array(y.astype(np.int32)), lists], names=["kind", "bucket", "doc_id", "y", "v"])

    vectors = [np.zeros((WORD_BUCKETS, DIM)), np.zeros((SHAPE_BUCKETS, DIM))]
    added = rows.mapInArrow(sums, kinds).groupBy("kind", "bucket").agg(*[F.sum(F.col("v")[i].cast("double")).alias(f"d{i}") for i in range(DIM)])
    for r in added.collect():  # a row for each bucket at most
        vectors[r[0]][r[1]] = r[2:]
    vec_w, vec_s = _unit(vectors[0].round(3)), _unit(vectors[1].round(3))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for table in groups(batches):
            features = _pool(*_terms(table, terms), vec_w, vec_s)
            n = len(features)
            yield _rows(np.full(n, 2), np.zeros(n), table.column(2).to_numpy(), table.column(0).to_numpy(), features)

    got = sorted((r.doc_id, r.y, r.v) for r in rows.mapInArrow(pooled, kinds).collect())  # at most `sample` rows of numbers
    y = np.array([r[1] for r in got], float)
    x = np.array([r[2] for r in got], float).reshape(len(got), 2 * DIM + EXTRA)
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(2 * DIM + EXTRA), np.ones(2 * DIM + EXTRA))
    if len(set(y.tolist())) < 2:
        return Model(vec_w, vec_s, mean, scale, (), constant=share)
    aside = np.array([xxhash.xxh32_intdigest(str(r[0])) % 5 == 0 for r in got])
    if aside.all() or not aside.any() or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    model = Model(vec_w, vec_s, mean, scale, train((x[~aside] - mean) / scale, y[~aside]))
    if aside.any():
        model.temperature = temperature(model.logits(x[aside]), y[aside])
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score`` and the columns in ``keep`` of every row, from its whole text (null: empty)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(k) for k in keep if k not in ("doc_id", "text")])
    out = ["doc_id", "score", *[k for k in keep if k not in ("doc_id",)]]
    fields = {f.name: f.dataType.simpleString() for f in source.schema} | {"score": "double"}
    made: list[Terms] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Terms())
        for table in groups(batches):
            found = model.score(_pool(*_terms(table, made[0]), model.vec_w, model.vec_s))
            table = table.append_column("score", pa.array(found, pa.float64()))
            yield from table.select(out).combine_chunks().to_batches()

    return source.mapInArrow(run, ", ".join(f"`{n}` {fields[n]}" for n in out))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; a null id is not held out."""
    return score(docs, fit(docs, labels, sample)).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
