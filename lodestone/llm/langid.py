"""Language ID: multilingual mixture inference.

A language is a distribution over the character n-grams of its words. A document is a mixture: each word comes
from one language, and expectation-maximisation estimates the languages' shares from the words' n-gram
likelihoods. The language set is grown from the likeliest one and kept while the likelihood, less a penalty per
further language, rises. The prediction is the largest share of the chosen set.

Models are fitted on a bounded sample per language; scoring is an Arrow map over whole texts in which EM runs on
all documents of a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fold

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
NGRAMS = (1, 2, 3, 4)
SMOOTH = 0.2
UNKNOWN = "und"


def words_of(text: str | None) -> Counter:
    """The text's words with their counts, of letters only: number letters and fractions part words."""
    found = Counter(WORD.findall((text or "").lower()))
    for w in [w for w in found if not w.isalpha()]:
        k = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += k
    return found


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the words <word>, word by word, and each word's number of them."""
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    word = np.repeat(np.arange(len(words)), size)
    found, owner, h = [], [], np.zeros(len(code) + 1, np.uint64)
    for n in range(1, NGRAMS[-1] + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :]
        at = np.flatnonzero(left[:m] >= n)
        mixed = (h[at] ^ (h[at] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB + 2 * n)
        found.append((mixed >> np.uint64(48)).astype(np.int64))
        owner.append(word[at])
    flat, own = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return flat[order], np.bincount(own, minlength=len(words))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets x languages

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)), np.float32)

    def learn_words(self, words: list[str], limit: int = 400_000) -> None:
        if len(self.known) > limit:
            self.known.clear()
            self.table = self.table[:0]
        new = [w for w in words if w not in self.known]
        if new:
            flat, size = grams(new)
            sums = np.add.reduceat(self.logs[flat], np.cumsum(size) - size, axis=0)
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate((self.table, (sums / len(NGRAMS)).astype(np.float32)))


@dataclass
class Batch:
    """The distinct words of several documents, document by document."""

    starts: np.ndarray
    owner: np.ndarray
    counts: np.ndarray
    like: np.ndarray  # likelihoods, scaled so that a word's largest is 1
    top: np.ndarray  # what was taken off their logarithms

    def only(self, docs: np.ndarray) -> Batch:
        """The batch of these documents (a mask)."""
        mine = docs[self.owner]
        size = np.bincount(self.owner, minlength=len(docs))[docs]
        return Batch(np.cumsum(size) - size, (np.cumsum(docs) - 1)[self.owner[mine]], self.counts[mine], self.like[mine], self.top[mine])

    def run(self, allowed: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the allowed languages in each document, and its log-likelihood under them."""
        n = np.add.reduceat(self.counts, self.starts)
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            part = self.like * share[self.owner]
            part *= (self.counts / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            share = np.add.reduceat(part, self.starts, axis=0) / n[:, None]
        total = (self.like * share[self.owner]).sum(axis=1)
        return share, np.add.reduceat(self.counts * (np.log(np.maximum(total, 1e-300)) + self.top), self.starts)


def infer(model: Model, texts: list[str | None], penalty: float = 3.0, part: int = 256) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """(language, its share, the chosen set with shares) of each text; UNKNOWN with score 0 where none has a letter."""
    out: list[tuple[str, float, list[tuple[str, float]]]] = []
    k = len(model.languages)
    for at in range(0, len(texts), part):
        bags = [words_of(t) for t in texts[at : at + part]]
        got: list[tuple[str, float, list[tuple[str, float]]]] = [(UNKNOWN, 0.0, [])] * len(bags)
        out_at = [i for i, b in enumerate(bags) if b]
        if out_at and k:
            model.learn_words(list(dict.fromkeys(w for i in out_at for w in bags[i])))
            rows = np.array([model.known[w] for i in out_at for w in bags[i]])
            size = np.array([len(bags[i]) for i in out_at])
            logs = model.table[rows].astype(np.float64)
            top = logs.max(axis=1)
            batch = Batch(np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), np.array([c for i in out_at for c in bags[i].values()], np.float64), np.exp(logs - top[:, None]), top)
            n = np.add.reduceat(batch.counts, batch.starts)
            alone = np.add.reduceat(logs * batch.counts[:, None], batch.starts, axis=0)
            share, _ = batch.run(np.ones((len(size), k)))
            # Candidate sets: the likeliest single language, then it with the largest other shares.
            first = alone.argmax(axis=1)
            rank = share.copy()
            rank[np.arange(len(size)), first] = 2
            order = np.argsort(-rank, axis=1, kind="stable")
            best = alone.max(axis=1)
            chosen = np.zeros((len(size), k))
            chosen[np.arange(len(size)), first] = 1
            # A document's set grows until a further language does not raise its penalised likelihood.
            growing = np.arange(len(size))
            for m in range(2, k + 1):
                if not len(growing):
                    break
                allowed = np.zeros((len(growing), k))
                np.put_along_axis(allowed, order[growing, :m], 1, axis=1)
                s, like = batch.run(allowed)
                value = like - penalty * (m - 1) * np.log(n[growing] + 1)
                better = value > best[growing]
                growing = growing[better]
                best[growing], chosen[growing] = value[better], s[better]
                batch = batch.only(better)
            for row, i in enumerate(out_at):
                found = sorted(((float(chosen[row, j]), model.languages[j]) for j in np.flatnonzero(chosen[row] > 0)), key=lambda x: (-x[0], x[1]))
                got[i] = (found[0][1], min(1.0, found[0][0]), [(name, p) for p, name in found])
        out += got
    return out


def fit(texts: list[str], languages: list[str]) -> Model:
    """Per-language smoothed n-gram distributions over the given texts."""
    names = sorted(set(languages))
    counts = np.full((BUCKETS, len(names)), SMOOTH)
    by: dict[str, Counter] = {name: Counter() for name in names}
    for t, name in zip(texts, languages):
        by[name].update(words_of(t))
    for j, name in enumerate(names):
        words = list(by[name])
        if words:
            flat, size = grams(words)
            counts[:, j] += np.bincount(flat, np.repeat(np.array([by[name][w] for w in words], np.float64), size), BUCKETS)
    return Model(names, np.log(counts / counts.sum(axis=0)))


def train(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = 400) -> Model:
    """Fit on at most per_language documents of each language, those first in a hash order, outside the held-out
    fold; null languages teach nothing. The model's table takes half a megabyte per language.

    Rows whose hash lies beyond twice the sample's expected reach are left out before they are ranked, so a
    language with most of the rows sends about as few to its task as any other.
    """
    rows = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(fold("doc_id", folds) != held, F.lit(False)))
    rows = rows.distinct().withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    # One row per language: the planner broadcasts it while it is small.
    rows = rows.join(rows.groupBy("lang").count(), "lang")
    rows = rows.where(F.col("h") / 2.0**64 + 0.5 <= 2.0 * per_language / F.col("count"))
    in_order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = rows.withColumn("rn", F.row_number().over(in_order)).where(F.col("rn") <= per_language).select("doc_id", "lang").distinct()
    texts = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    got = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id", "lang").collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares (language:share of the chosen set) for every row of docs.

    A text that is null or has no letter, or any text if nothing was learned, is 'und' with score 0. A null
    doc_id counts as held out. Repeated rows are predicted alike. An empty table gives no rows; of docs only
    doc_id and text are read here.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            got = infer(own, b.column(2).to_pylist())
            shares = [",".join(f"{name}:{p:.4f}" for name, p in found) for _, _, found in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(shares, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "shares"])

    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(True))
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double, shares string")
