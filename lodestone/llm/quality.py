"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: each white-space word as written, its character n-grams, and a marker for a
word that repeats the one before it. Feature vectors are learned; their average over the document, plus the
average of a few whole-document features (length, share of distinct words), goes through a softmax. Training is
mini-batch stochastic gradient descent in numpy on a bounded sample of labelled rows; scoring every row is an
Arrow map with the model's fixed-size projection (buckets x 2 numbers), so it never shuffles text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fold, labelled_sample

BUCKETS = 1 << 17
NGRAMS = (2, 3, 4)
REPEAT = "\x00repeat"


def bucket(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams, word by word, and how many each word has.

    A word is written <word>; its n-grams are hashed over code points, all words at once. Its own bucket counts
    as one more n-gram, first of the word's.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "<" + "><".join(words) + ">"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(code))  # code points from here to the word's end
    word = np.repeat(np.arange(len(words)), size)
    found, owner = [np.array([bucket("\x01" + w) for w in words])], [np.arange(len(words))]
    h = code.copy()
    for n in range(2, NGRAMS[-1] + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            mixed = (h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            found.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owner.append(word[at])
    flat, own = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return flat[order], np.bincount(own, minlength=len(words))


def document_words(text: str | None) -> tuple[Counter, list[str]]:
    """Counts of the words of the whole text, and its whole-document features."""
    words = (text or "").split()
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    if repeats:
        counts[REPEAT] = repeats
    n = len(words)
    shape = [f"\x02len{min(14, n.bit_length())}"]
    if n:
        shape.append(f"\x02distinct{int(10 * (len(counts) - bool(repeats)) / n)}")
        shape.append(f"\x02upper{sum(k for w, k in counts.items() if w.isupper()) * 5 // n}")
    return counts, shape


@dataclass
class Model:
    """logit(label 1) = bias + mean over word features of words[f] + mean over document features of shape[f]."""

    words: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[float, int]] = {}

    def scores(self, texts: list[str | None], part: int = 256) -> list[float]:
        """Of each whole text; the words that are new to this process are hashed together."""
        out: list[float] = []
        for at in range(0, len(texts), part):
            docs = [document_words(t) for t in texts[at : at + part]]
            if len(self.known) > 400_000:
                self.known.clear()
            new = list({w for counts, _ in docs for w in counts} - self.known.keys())
            flat, size = word_features(new)
            if new:
                sums = np.add.reduceat(self.words[flat], np.cumsum(size) - size, dtype=np.float64)
                self.known.update(zip(new, zip(sums.tolist(), size.tolist())))
            for counts, shape in docs:
                total, n = 0.0, 0
                for w, k in counts.items():
                    s, m = self.known[w]
                    total += k * s
                    n += k * m
                logit = self.bias + (total / n if n else 0.0) + sum(float(self.words[bucket(s)]) for s in shape) / len(shape)
                out.append(1 / (1 + math.exp(-min(60.0, max(-60.0, logit)))))
        return out


def fit(texts: list[str], y: np.ndarray, prior: float | None = None, dim: int = 12, epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 3) -> Model:
    """Train on texts with labels y in {0, 1}; prior is label 1's share among all eligible labels, to which the
    class-balanced sample's probabilities are shifted. One class only: a constant model."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rng = np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for t in texts:
        counts, shape = document_words(t)
        flat, size = word_features(list(counts))
        weight = np.repeat(np.array(list(counts.values()), np.float64), size)
        own, at = np.unique(flat, return_inverse=True)
        weight = np.bincount(at, weight, len(own)) / max(1.0, float(weight.sum()))
        doc = np.array([bucket(s) for s in shape])
        rows.append((np.concatenate((own, doc)).astype(np.int32), np.concatenate((weight, np.full(len(doc), 1 / len(doc)))).astype(np.float32)))
    vectors = (rng.normal(size=(BUCKETS, dim)) / dim).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    steps, step = epochs * (len(rows) // batch + 1), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            size = [len(rows[i][0]) for i in some]
            f, w = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            hidden = np.add.reduceat(vectors[f] * w[:, None], starts, axis=0)
            z = hidden @ out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            back = p @ out.T
            out -= lr * hidden.T @ p / len(some)
            grad = np.repeat(back, size, axis=0) * w[:, None]
            key = np.argsort(f, kind="stable")
            own, first = np.unique(f[key], return_index=True)
            vectors[own] -= lr * 4 * np.add.reduceat(grad[key], first, axis=0)
    weights = vectors @ (out[:, 1] - out[:, 0])
    share = float(np.mean(y))
    prior = share if prior is None else min(max(prior, 1e-4), 1 - 1e-4)
    return Model(weights, float(np.log(prior / (1 - prior)) - np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, per_class: tuple[int, int] = (1200, 1200)) -> Model:
    """Fit on at most sum(per_class) labelled rows outside the held-out fold."""
    keep = F.coalesce(fold("doc_id", folds) != held, F.lit(False))
    rows = labelled_sample(docs, labels, label, keep, per_class).orderBy("doc_id").collect()
    share = labels.where(F.col(label).isin(0, 1) & keep).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64), share)


def score(docs: DataFrame, model: Model, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null texts score as empty ones, from the whole-document features alone. A null doc_id counts as held out.
    Repeated rows are scored alike. An empty table gives no rows; other columns of docs are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            s = own.scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(True))
    out = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(scan, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold. The score is computed beside
    the row in one Arrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            keep = pa.array([s >= threshold for s in own.scores(b.column(at).to_pylist())], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(scan, docs.schema)
