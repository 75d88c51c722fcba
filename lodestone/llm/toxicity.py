"""Toxicity: class-conditional Kneser-Ney models.

Each word of a text, lower-cased and written <word>, is a sequence of code points. Two models give a code point's
probability after up to ORDER - 1 earlier ones: one counted over toxic training texts, one over ordinary ones.
Their highest order is the class's own; what it discounts goes to lower orders that both share, Kneser-Ney
continuation counts over all training words. So expressions too rare to tell the classes apart get the same
probability from both and weigh nothing. The log-likelihoods' difference, normalised by the number of words, with
the share and size of strongly toxic words, is calibrated by logistic regression on cross-fitted training scores.

Counts are taken over a bounded sample of labelled rows; the tables that scoring needs are two sorted arrays of
n-gram hashes, broadcast once. Scoring is an Arrow map without any shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fold, labelled_sample

ORDER = 7
DISCOUNT = 0.75
CLASS_DISCOUNTS = (0.0, 1.0, 1.5, 2.0)  # of n-grams that a class has 0, 1, 2, 3 or more times
STRONG = 2.5
N_FEATURES = 5
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x100000001B3)


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def mix(h: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(n).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


@dataclass
class Places:
    """Every code point after each word's opening mark: the hashes of the n-grams that end there."""

    size: np.ndarray  # of each word, in places
    grams: list[np.ndarray]  # by length 1 .. ORDER: hash of the n-gram ending at the place (0: it would cross the word's start)
    depth: np.ndarray  # the length of the longest n-gram there

    @staticmethod
    def of(words: list[str]) -> Places:
        code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.array([len(w) + 2 for w in words])
        at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        grams, h = [], np.zeros(len(code) + 1, np.uint64)
        for n in range(1, ORDER + 1):
            h = np.concatenate((np.zeros(1, np.uint64), h[:-1] * BASE + code + np.uint64(1)))
            h[1:][at < n - 1] = 0
            grams.append(h[1:])
        inner = at > 0
        return Places(size - 1, [g[inner] for g in grams], np.minimum(at[inner] + 1, ORDER))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place its longest n-gram, and that n-gram's context."""
        full, context = np.zeros(len(self.depth), np.uint64), np.zeros(len(self.depth), np.uint64)
        for n in range(2, ORDER + 1):
            here = self.depth == n
            full[here] = mix(self.grams[n - 1][here], n)
        # The context ends one place earlier; its hash follows from the n-gram's by taking the last point off.
        last = self.grams[0] - np.uint64(1)
        for n in range(2, ORDER + 1):
            here = self.depth == n
            context[here] = mix(self.grams[n - 1][here] - last[here], 100 + n)
        return full, context


@dataclass
class Model:
    full: np.ndarray
    full_value: np.ndarray
    context: np.ndarray
    context_value: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[float, float]] = {}  # of the whole word, and of its most telling beginning

    def learn_words(self, words: list[str]) -> None:
        if not words:
            return
        places = Places.of(words)
        full, context = places.keys()
        value = look_up(self.full, self.full_value, full, look_up(self.context, self.context_value, context, 0.0))
        starts = np.cumsum(places.size) - places.size
        running = np.cumsum(value)
        running -= np.repeat(running[starts] - value[starts], places.size)
        ends = starts + places.size - 1
        self.known.update(zip(words, zip(running[ends].tolist(), np.maximum.reduceat(running, starts).tolist())))

    def features(self, texts: list[str | None], part: int = 256) -> np.ndarray:
        """Per text: 1, the mean log-likelihood difference of its words, and of the words' beginnings, measured from
        that mean: the share above STRONG (root), their mean excess (root), the largest."""
        out = np.zeros((len(texts), N_FEATURES))
        out[:, 0] = 1
        for at in range(0, len(texts), part):
            counts = [words_of(t) for t in texts[at : at + part]]
            if len(self.known) > 400_000:
                self.known.clear()
            self.learn_words(list({w for c in counts for w in c} - self.known.keys()))
            for i, c in enumerate(counts):
                n = sum(c.values())
                if n:
                    v = np.array([self.known[w] for w in c])
                    k = np.array(list(c.values()), np.float64)
                    mean = float(v[:, 0] @ k) / n
                    over = v[:, 1] - min(mean, 0.0)
                    strong = over > STRONG
                    out[at + i, 1:] = mean, math.sqrt(k[strong].sum() / n), math.sqrt((k * over)[strong].sum() / n), min(12.0, max(0.0, over.max())) / 4
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -60, 60)))


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(np.asarray(other, np.float64), wanted.shape).copy()
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def count_models(vocabulary: list[str], counts: np.ndarray) -> Model:
    """The two class models over a vocabulary with its counts by class (words x 2), as tables of log-probability
    differences."""
    used = np.flatnonzero(counts.any(axis=1))
    words, counts = [vocabulary[i] for i in used.tolist()], counts[used]
    if not words:
        none = np.zeros(0, np.uint64)
        return Model(none, np.zeros(0), none, np.zeros(0))
    places = Places.of(words)
    full, context = places.keys()
    own, rep, back = np.unique(full, return_index=True, return_inverse=True)
    ctx, of_ctx = np.unique(context[rep], return_inverse=True)
    del full, context
    depth, back_off = places.depth[rep], np.zeros(len(own))

    # Shared orders: continuation counts of every m-gram that something precedes. ``level`` has, at every place, the
    # probability by its longest m-gram so far; an n-gram of the class models backs off to order n - 1.
    level = np.full(len(places.depth), 1.0 / max(2, len(np.unique(places.grams[0]))))
    for m in range(1, ORDER):
        here = np.flatnonzero(places.depth > m)
        _, first = np.unique(places.grams[m][here], return_index=True)
        gram, at, of_gram = np.unique(places.grams[m - 1][here], return_index=True, return_inverse=True)
        n_own = np.bincount(of_gram[first], minlength=len(gram)).astype(np.float64)
        _, of_start = np.unique(gram - (places.grams[0][here][at] - np.uint64(1)), return_inverse=True)
        n_start, kinds = np.bincount(of_start, n_own), np.bincount(of_start)
        p = (np.maximum(n_own - DISCOUNT, 0) + DISCOUNT * kinds[of_start] * level[here][at]) / n_start[of_start]
        level[here] = p[of_gram]
        mine = depth == m + 1
        back_off[mine] = level[rep[mine]]

    logs, free = [], []
    for c in (0, 1):
        count = np.bincount(back, np.repeat(counts[:, c].astype(np.float64), places.size), len(own))
        at_ctx = np.bincount(of_ctx, count, len(ctx))
        off = np.array(CLASS_DISCOUNTS)[np.minimum(count, 3).astype(int)]
        weight = np.where(at_ctx > 0, np.bincount(of_ctx, off, len(ctx)) / np.maximum(at_ctx, 1), 1.0)
        seen = np.where(at_ctx[of_ctx] > 0, (count - off) / np.maximum(at_ctx[of_ctx], 1), 0.0)
        logs.append(np.log(seen + weight[of_ctx] * back_off))
        free.append(np.log(weight))
    return Model(own, logs[1] - logs[0], ctx, free[1] - free[0])


def calibrate(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept is moved from the sample's class share to ``share``."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    own, share = min(max(float(y.mean()), 1e-4), 1 - 1e-4), min(max(share, 1e-4), 1 - 1e-4)
    w[0] += math.log(share / (1 - share)) - math.log(own / (1 - own))
    return w


def fit(texts: list[str], y: np.ndarray, share: float | None = None, parts: int = 3) -> Model:
    """Cross-fit the calibration, then count over all texts. One class only: a constant score."""
    ids: dict[str, int] = {}
    bags = []
    for t in texts:
        c = words_of(t)
        bags.append((np.array([ids.setdefault(w, len(ids)) for w in c], np.int32), np.array(list(c.values()), np.int32)))
    vocabulary = list(ids)
    del ids

    def counted(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vocabulary), 2))
        for i in rows.tolist():
            out[bags[i][0], y[i]] += bags[i][1]
        return out

    every = np.arange(len(texts))
    if len(set(y.tolist())) < 2:
        model = count_models(vocabulary, counted(every))
        model.weights = np.array([0.0 if not len(y) else (4.0 if y[0] else -4.0)] + [0.0] * (N_FEATURES - 1))
        return model
    x = np.zeros((len(texts), N_FEATURES))
    for p in range(parts):
        own = every % parts == p
        x[own] = count_models(vocabulary, counted(every[~own])).features([texts[i] for i in every[own].tolist()])
    model = count_models(vocabulary, counted(every))
    model.weights = calibrate(x, y.astype(np.float64), float(y.mean()) if share is None else share)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, per_class: tuple[int, int] = (2400, 1200)) -> Model:
    """Fit on at most sum(per_class) labelled rows outside the held-out fold."""
    keep = F.coalesce(fold("doc_id", folds) != held, F.lit(False))
    rows = labelled_sample(docs, labels, label, keep, per_class).orderBy("doc_id").collect()
    share = labels.where(F.col(label).isin(0, 1) & keep).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64), share)


def score(docs: DataFrame, model: Model, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and wordless texts get the score of a text without evidence. A null doc_id counts as held out. Repeated
    rows are scored alike. An empty table gives no rows; other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            s = own.scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(True))
    out = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(scan, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
