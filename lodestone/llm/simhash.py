"""SimHash near-dedup over vantage-point trees.

Fingerprints of whole texts are 64-bit majority votes over the XXH64 of word shingles. Exact copies share a
fingerprint, so only distinct fingerprints are compared. All pairs within ``max_bits`` bits are found exactly:

* The 64 bits are cut into ``max_bits // 2 + 1`` spans. Two fingerprints within max_bits bits differ in at most
  one bit of some span (pigeonhole), so a search of radius 1 in each span's own Hamming space sees every pair.
* In each span's space a vantage-point tree, its vantage points and radii fitted on a bounded sample, deals the
  fingerprints to shards. A node sends x inside its ball (distance <= mu) or outside; by the triangle bound a
  close pair that is split has its inner end at distance exactly mu, so just those inner points also go
  outside. Every close pair thus meets in one shard at least.
* Each shard goes on with the same splits in memory down to small leaves, compares all 64 bits there, and
  returns a spanning forest of the links, never the pairs: at most one row per fingerprint of the shard.
* Shards above ``shard_rows`` are split into pair-wise sub-shards (rows meet in some (i, j) cell), so a dense
  family never has to fit one task.

The forests' components are joined by alternating large-star and small-star rounds over DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bit_of, cut, has_bit, join_hot, key_bits

WIDTH = 64
SEED = 42


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """XXH64 of every run of ``words`` words of a text, of the whole text if it has fewer; none without words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, "<u8")
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")


def text_fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64-bit SimHash of one whole text (0 for a text without words)."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(h: np.ndarray) -> int:
    """The bits that over half of these hashes have set, as a signed 64-bit value; 0 without hashes."""
    n = len(h)
    if not n:
        return 0
    set_bits = np.zeros(WIDTH, np.int64)
    for at in range(0, n, 65_536):
        set_bits += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of docs; a null text counts as empty, hence fp 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [text_fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, fp long")


def spans_of(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the bit spans; a close pair differs in at most one bit of one of them."""
    m = max_bits // 2 + 1
    edges = [WIDTH * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def span_values(fp: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    shift, width = span
    mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    return (fp.view(np.uint64) >> np.uint64(shift)) & mask


def radius(d: np.ndarray) -> tuple[int, float]:
    """The mu that leaves the smaller larger side, and that side's share of the rows."""
    at_most = np.cumsum(np.bincount(d)) / len(d)
    from_on = 1 - np.concatenate(([0.0], at_most[:-1]))
    worst = np.maximum(at_most, from_on)
    mu = int(worst.argmin())
    return mu, float(worst[mu])


def split(values: np.ndarray, vantage: np.uint64, mu: int) -> tuple[np.ndarray, np.ndarray]:
    """Row masks of the two children: the ball, and its outside with the boundary that may reach into it."""
    d = np.bitwise_count(values ^ vantage)
    return d <= mu, d >= mu


def routing_tree(values: np.ndarray, depth: int, rng: np.random.Generator, least: int = 16) -> list[tuple[int, int]]:
    """(vantage, mu) of each node in level order, fitted on a sample of the span's values.

    A branch with fewer than ``least`` of the sample is not split further: mu -1 sends all to one child. Shards split
    on in memory.
    """
    nodes: list[tuple[int, int]] = []
    level = [values]
    for _ in range(depth):
        below = []
        for v in level:
            best = (2.0, 0, -1)
            for vantage in rng.choice(v, 4) if len(v) >= least else ():
                mu, worst = radius(np.bitwise_count(v ^ vantage))
                best = min(best, (worst, int(vantage), mu))
            nodes.append(best[1:])
            if best[2] < 0:
                below += [v[:0], v]
            else:
                inner, outer = split(v, np.uint64(best[1]), best[2])
                below += [v[inner], v[outer]]
        level = below
    return nodes


def route(values: np.ndarray, nodes: list[tuple[int, int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs: every leaf whose region, with its boundary, holds the row's value."""
    rows, at = np.arange(len(values)), np.zeros(len(values), np.int64)
    vantage = np.array([n[0] for n in nodes] or [0], np.uint64)
    mus = np.array([n[1] for n in nodes] or [0], np.int64)
    for _ in range(depth):
        d = np.bitwise_count(values[rows] ^ vantage[at])
        inner, outer = d.astype(np.int64) <= mus[at], d.astype(np.int64) >= mus[at]
        rows, at = np.concatenate((rows[inner], rows[outer])), np.concatenate((2 * at[inner] + 1, 2 * at[outer] + 2))
    return rows, at - (len(nodes) if depth else 0)


class Forest:
    """Union-find over row numbers; the smallest row is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, members: np.ndarray) -> None:
        roots = sorted({self.find(int(i)) for i in members})
        for r in roots[1:]:
            self.up[r] = roots[0]


def link_leaf(fp: np.ndarray, rows: np.ndarray, max_bits: int, forest: Forest, tile: int = 512) -> None:
    """Join all rows of one leaf that lie within max_bits bits, by breadth-first passes over tiles."""
    own = fp[rows]
    n = len(rows)
    near = np.zeros(n, bool)
    for at in range(0, n, tile):
        near[at : at + tile] = (np.bitwise_count(own[at : at + tile, None] ^ own[None, :]) <= max_bits).sum(axis=1) > 1
    left = np.flatnonzero(near)
    while len(left):
        frontier, left, members = left[:1], left[1:], [left[:1]]
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(frontier), tile):
                hit |= (np.bitwise_count(own[frontier[at : at + tile], None] ^ own[left][None, :]) <= max_bits).any(axis=0)
            frontier, left = left[hit], left[~hit]
            members.append(frontier)
        forest.join(rows[np.concatenate(members)])


def link_shard(fp: np.ndarray, span: tuple[int, int], max_bits: int, leaf: int = 256) -> np.ndarray:
    """The root row of each row of a shard, linked within max_bits bits through this span."""
    values, forest = span_values(fp, span), Forest(len(fp))
    rng = np.random.default_rng(len(fp))
    stack = [np.arange(len(fp))]
    while stack:
        rows = stack.pop()
        if len(rows) < 2:
            continue
        best = (2.0, 0, 0)
        if len(rows) > leaf:
            v = values[rows]
            for vantage in rng.choice(v, 4):
                mu, worst = radius(np.bitwise_count(v ^ vantage))
                best = min(best, (worst, int(vantage), mu))
        if best[0] < 0.9:
            inner, outer = split(values[rows], np.uint64(best[1]), best[2])
            stack += [rows[inner], rows[outer]]
        else:
            link_leaf(fp, rows, max_bits, forest)
    return np.array([forest.find(i) for i in range(len(fp))], np.int64)


def close_forest(fps: DataFrame, max_bits: int = 4, shard_rows: int = 40_000, sample_rows: tuple[int, int] = (20_000, 2_000_000), seed: int = 7) -> DataFrame:
    """(src, dst) links that join just those distinct fingerprints ``fp`` which chains of pairs within max_bits
    bits join. The routing trees are fitted on one fingerprint of 500, at least and at most sample_rows; all are indexed."""
    n = fps.count()
    sample_rows = min(max(sample_rows[0], n // 500), sample_rows[1])
    spans = spans_of(max_bits)
    depth = max(4, int(np.ceil(np.log2(max(1, n / shard_rows)) / 0.75)))
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64(F.lit(seed), "fp"), "fp").limit(sample_rows).collect()] or [0], np.int64)
    rng = np.random.default_rng(seed)
    trees = [routing_tree(span_values(sample, s), depth, rng) for s in spans]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for k, (span, tree) in enumerate(zip(spans, trees)):
                rows, leaf = route(span_values(fp, span), tree, depth)
                yield pd.DataFrame({"fp": fp[rows], "span": np.int32(k), "shard": leaf})

    dealt = fps.select("fp").mapInPandas(deal, "fp long, span int, shard long")
    # A shard beyond shard_rows is cut into s salts; its rows meet in the cells (i, j), i <= j.
    heavy = dealt.groupBy("span", "shard").count().where(F.col("count") > shard_rows)
    heavy = heavy.select("span", "shard", F.ceil(F.col("count") * 2 / shard_rows).cast("int").alias("salts")).collect()
    if heavy:
        salts = fps.sparkSession.createDataFrame(heavy, "span int, shard long, salts int")
        dealt = dealt.join(salts, ["span", "shard"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        own = F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col("salts")).cast("int")
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        dealt = dealt.select("fp", "span", "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        dealt = dealt.select("fp", "span", "shard", F.lit(0).alias("i"), F.lit(0).alias("j"))

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(rows["fp"].to_numpy(np.int64))
        root = link_shard(fp.view(np.uint64), spans[int(key[0])], max_bits)
        has = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"src": fp[has], "dst": fp[root[has]]})

    return dealt.groupBy("span", "shard", "i", "j").applyInPandas(link, "src long, dst long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (src, dst); root is the smallest node it reaches."""

    def star(e: DataFrame, edges: int, large: bool) -> DataFrame:
        if large:
            e = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        found = cut(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        low = found.select("u", F.least("u", "m").alias("m"))
        both = join_hot(e, low, "u", found, edges)
        if large:
            return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct(), "edges")
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = cut(star(cut(star(now, seen[0], True), "stars"), seen[0], False), "stars")
        before, seen = seen, state(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def named_classes(entries: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, component_id) of every entry (key, first_id), from the components (node, root) of those that have a link:
    the smallest first_id of the entry's component, its own where it has no link."""
    linked = cut(entries.select(key, "first_id").join(found.withColumnRenamed("node", key), key), "linked")
    labels = cut(linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "labels")
    named = join_hot(linked.select(key, "root"), labels.select("root", "component_id"), "root", labels, linked.count())
    out = entries.select(key, "first_id").join(named.select(key, "component_id"), key, "left")
    return out.select(key, F.coalesce("component_id", "first_id").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id in the document's class: documents are linked if their fingerprints
    differ in at most max_bits bits, and classes are the links' connected components. Null and wordless texts
    have fingerprint 0 and are linked like any other. A null doc_id gets its class's id but never names one; a
    class of null ids only has a null id. Repeated rows stay repeated. An empty table gives no rows.
    """
    own = cut(fingerprints(docs, words), "fingerprints")
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fingerprints")
    named = cut(named_classes(fps, components(close_forest(fps, max_bits)), "fp"), "named")
    return join_hot(own, named, "fp", fps, own.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id stays (rows without doc_id all
    stay; of rows that repeat a doc_id, one)."""
    return keep_first(docs, cut(near_duplicates(docs, words, max_bits), "classes"))


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its class's component_id, one per doc_id, and all rows without doc_id."""
    gone = cut(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    held = docs.sparkSession.sparkContext.broadcast(key_bits(gone, "doc_id"))
    marked, names = docs.withColumn("_at", bit_of(F.col("doc_id").cast("long"), held.value)), docs.columns

    def rows(may_go: bool) -> DataFrame:
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = has_bit(b.column(b.num_columns - 1).to_numpy(), held.value)
                yield b.filter(pa.array(at == may_go)).select(names)

        return marked.mapInArrow(some, docs.schema)

    # Texts are not shuffled but for those whose doc_id may be among the gone.
    kept = rows(False).unionByName(rows(True).join(gone, "doc_id", "left_anti"))
    named = classes.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept
