"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

Texts are sequences of lower-cased words. Test items are taken in blocks of bounded size, and a block's word
vocabulary and word pairs are broadcast. Every region of a text that holds enough of an item's pairs is aligned with
the item word by word (match +1, mismatch -1, gap -1), whole batches of regions at a time. The score is the best
local alignment over the item's length: 1 for an exact copy; copies with replaced, added or missing words fall off
by what was edited.

No alignment that reaches the threshold t is missed. Let it match M words in B + 1 runs: each break costs 1 or more,
so M - B >= t * m for an item of m words, and the runs hold M - B - 1 >= t * m - 1 neighbouring pairs. It adds at most
M - t * m words, so it spans (2 - t) * m words of the text at most. Regions without so many pairs in such a span are
left out, all others are aligned.

No training text is shuffled or counted: the search is one Arrow map.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
N = 3  # words an item has at least
PAIR = 2
THRESHOLD = 0.4
BLOCK_CHARS = 32_000_000
CELLS = 1 << 18  # words of regions, padding included, that are aligned at once


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pair_codes(ids: np.ndarray) -> np.ndarray:
    """Codes of the pairs of neighbouring word numbers; pairs with an unknown word (-1) are 0."""
    n = len(ids) - PAIR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(PAIR):
        part = ids[k : k + n]
        code = code * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)
        code ^= code >> np.uint64(29)
        known &= part >= 0
    return np.where(known, code | np.uint64(1), np.uint64(0))


@dataclass
class Items:
    """A block of test items as word numbers, with the pairs of each and the items that hold each pair."""

    item_ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    pairs: np.ndarray  # sorted codes of all pairs
    own: list[np.ndarray]  # of each item the places of its pairs in pairs
    holders: np.ndarray  # items by pair
    first: np.ndarray  # where the holders of each pair begin

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words = [], []
        for item_id, text in rows:
            w = words_of(text)
            if len(w) >= N:
                ids.append(item_id)
                words.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64))
        codes = [np.unique(pair_codes(w)) for w in words]
        pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
        own = [np.searchsorted(pairs, c) for c in codes]
        pair = np.concatenate(own) if own else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(own)), [len(o) for o in own])
        first = np.concatenate(([0], np.cumsum(np.bincount(pair, minlength=len(pairs))))).astype(np.int64)
        return Items(ids, words, vocabulary, pairs, own, item[np.argsort(pair, kind="stable")], first)

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def needs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each item the pairs that an alignment of the threshold holds at least, and the words it spans at most."""
        m = [len(w) for w in self.words]
        least = [max(1, math.ceil(threshold * x - 1e-9) - 1) for x in m]
        return np.array(least, np.int64), np.array([math.floor((2 - threshold) * x + 1e-9) for x in m], np.int64)

    def regions(self, ids: np.ndarray, least: np.ndarray, span: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, low, high) of the word ranges that hold every stretch of span words with least pairs of an item.

        Longer ranges come in overlapping parts of 4 spans, so that each such stretch is whole in one part.
        """
        codes = pair_codes(ids)
        at = places(self.pairs, codes)
        if not len(at):
            return
        pair = np.searchsorted(self.pairs, codes[at])
        order = np.argsort(pair, kind="stable")
        at, (pair, start, n) = at[order], np.unique(pair[order], return_index=True, return_counts=True)
        held = self.first[pair + 1] - self.first[pair]
        ends = np.cumsum(held)
        item = self.holders[np.repeat(self.first[pair] - ends + held, held) + np.arange(ends[-1])]
        count = np.bincount(item, weights=np.repeat(n, held), minlength=len(self.words))
        for i in np.flatnonzero(count >= least).tolist():
            _, mine, _ = np.intersect1d(pair, self.own[i], assume_unique=True, return_indices=True)
            p = np.sort(np.concatenate([at[a : a + k] for a, k in zip(start[mine].tolist(), n[mine].tolist())]))
            last = p[least[i] - 1 :]
            p = p[: len(last)]
            near = last - p <= span[i] - PAIR
            lows, highs = np.maximum(last[near] + PAIR - span[i], 0).tolist(), np.minimum(p[near] + span[i], len(ids)).tolist()
            while lows:
                k = next((k for k in range(1, len(lows)) if lows[k] > highs[k - 1]), len(lows))
                low, high, long = lows[0], highs[k - 1], int(span[i])
                while high - low > 4 * long:
                    yield i, low, low + 4 * long
                    low += 3 * long
                yield i, low, high
                lows, highs = lows[k:], highs[k:]


def places(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions of the codes that are in sorted_codes."""
    if not len(sorted_codes) or not len(codes):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.flatnonzero(sorted_codes[at] == codes)


def align(regions: list[np.ndarray], items: list[np.ndarray], part: int = 256, cells: int = CELLS) -> list[tuple[int, int, int]]:
    """(score, first, last) of the best local alignment of each item within its region; last word included.

    Rows of the dynamic programme are whole regions; the gap along a row is a running maximum. ``first`` is carried
    with the scores, packed below them, so no trace-back is needed. At most ``part`` regions, and no more than fit into
    ``cells`` words when padded to the widest, are aligned at once.
    """
    out: list[tuple[int, int, int]] = [(0, 0, -1)] * len(regions)
    order = sorted(range(len(regions)), key=lambda i: (len(regions[i]), len(items[i])))
    at = 0
    while at < len(order):
        some = order[at : at + part]
        while len(some) > 1 and len(some) * len(regions[some[-1]]) > cells:
            some = some[: len(some) // 2]
        at += len(some)
        wide, long = max(len(regions[i]) for i in some), max(len(items[i]) for i in some)
        r, q = np.full((len(some), wide), -2, np.int64), np.full((len(some), long), -3, np.int64)
        for k, i in enumerate(some):
            r[k, : len(regions[i])], q[k, : len(items[i])] = regions[i], items[i]
        # A cell is score * BIG - start: maxima prefer the higher score, then the earlier start.
        big = 1 << 32
        fresh = -np.broadcast_to(np.arange(wide, dtype=np.int64), r.shape)  # score 0, starting at the next word
        slope = big * np.arange(wide, dtype=np.int64)
        h = np.concatenate((fresh, np.full((len(some), 1), -wide, np.int64)), axis=1)  # h[:, j]: alignments ending before word j
        best, best_end = np.zeros(len(some), np.int64), np.full(len(some), -1)
        for row in range(long):
            hit = r == q[:, row : row + 1]
            down = h[:, :-1] + np.where(hit, big, -big)
            t = np.maximum(np.maximum(down, h[:, 1:] - big), fresh - 1)
            t = np.maximum.accumulate(t + slope, axis=1) - slope
            t = np.maximum(t, fresh - 1)
            h = np.concatenate((np.zeros((len(some), 1), np.int64), t), axis=1)
            j = t.argmax(axis=1)
            top = t[np.arange(len(some)), j]
            better = top > np.maximum(best, 0)
            best, best_end = np.where(better, top, best), np.where(better, j, best_end)
        for k, i in enumerate(some):
            score = int(-(-best[k] // big)) if best[k] > 0 else 0
            out[i] = (score, int(score * big - best[k]) if score else 0, int(best_end[k]))
    return out


def hits(items: Items, texts: list[str | None], threshold: float = THRESHOLD) -> list[list[tuple[int, float, int, int]]]:
    """Of each text the items found: (item, score, first word, last word), the best region of each."""
    regions, wanted, owner = [], [], []
    least, span = items.needs(threshold)
    for d, text in enumerate(texts):
        ids = items.numbers(words_of(text))
        for i, low, high in items.regions(ids, least, span):
            regions.append(ids[low:high])
            wanted.append(items.words[i])
            owner.append((d, i, low))
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
    for (d, i, low), (score, first, last) in zip(owner, align(regions, wanted)):
        share = score / len(items.words[i])
        if share >= threshold and share > best[d].get(i, (0.0,))[0]:
            best[d][i] = (share, low + first, low + last)
    return [[(i, *v) for i, v in sorted(b.items())] for b in best]


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about block_chars characters; repeated rows once, null texts as empty."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, passage) for every text and item that it holds a copy of.

    ``passage`` is the aligned words, lower-cased and space-joined. Items of fewer than N words are too short to
    tell and match nothing. Null and empty texts match nothing. Repeated rows are reported as often; repeated
    benchmark rows count once. Empty tables give no rows; other columns are not read.
    """
    out = None
    for rows in blocks_of(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(rows))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                texts = b.column(1).to_pylist()
                got = [(d, *x) for d, found in enumerate(hits(own, texts, threshold)) for x in found]
                passages = [" ".join(words_of(texts[g[0]])[g[3] : g[4] + 1]) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([g[0] for g in got], pa.int64())),
                        pa.array([own.item_ids[g[1]] for g in got], pa.int64()),
                        pa.array([g[2] for g in got], pa.float64()),
                        pa.array([g[3] for g in got], pa.int64()),
                        pa.array([g[4] for g in got], pa.int64()),
                        pa.array(passages, pa.string()),
                    ],
                    names=["doc_id", "item_id", "score", "first_word", "last_word", "passage"],
                )

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, item_id long, score double, first_word long, last_word long, passage string")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no copy of any item."""
    at = docs.columns.index("text")
    for rows in blocks_of(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(rows))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = [not found for found in hits(shared.value, b.column(at).to_pylist(), threshold)]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
