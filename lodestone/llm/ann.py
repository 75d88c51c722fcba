"""Approximate nearest neighbours by shifted space-filling curves.

For each of several curves every vector is rotated and projected to a few dimensions, each axis is evened out by the
sample's quantiles and shifted, and the vector is numbered along a Hilbert curve. Each curve's order is range-partitioned
at boundaries fitted on a bounded sample; a query looks into its own block and the two beside it. These windows
are merged over the curves and reranked by exact inner products in double precision.

Equal vectors are searched once: a distinct vector keeps its smallest ``k + 1`` ids, which is all that any query's
k nearest can use, so a vector that a third of the rows share is one entry and results stay whole.

The width of the windows, a share of the order, is the smallest of WINDOWS at which queries drawn from the sample find
``recall`` of their nearest in the sample. So clustered vectors get narrow windows and isotropic ones wide windows, by
measurement and not by size. In a larger table the k nearest lie nearer than in the sample, so recall rises from there.
The work of a query is curves x window x rows scored pairs; an entry is dealt once per curve and a query to three blocks
per curve, whatever the size. Only blocks of more than ``part_rows`` entries or ``part_queries`` queries are dealt in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points below 2 ** bits, as unsigned 64-bit numbers.

    Gray-code transform dimension by dimension, all points at once; needs dims * bits <= 64.
    """
    x = points.astype(np.uint64)
    n = x.shape[1]
    one = np.uint64(1)
    for q in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(q), (one << np.uint64(q)) - one
        for i in range(n):
            flip = (x[:, i] & bit) != 0
            swap = np.where(flip, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint64)
    for q in range(bits - 1, 0, -1):
        t ^= np.where((x[:, n - 1] >> np.uint64(q)) & one != 0, (one << np.uint64(q)) - one, np.uint64(0))
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for q in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[:, i] >> np.uint64(q)) & one)
    return key


# The window shares that fit tries, each three blocks of the order.
WINDOWS = (0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.06, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0)
LEVELS = 257


@dataclass
class Curves:
    """Projections, quantiles, shifts and block boundaries of all curves, and the share of the sample in each block."""

    axes: list[np.ndarray]
    quantiles: list[np.ndarray]
    shift: list[np.ndarray]
    bits: int
    edges: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)

    @property
    def blocks(self) -> int:
        return len(self.share[0])

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        p = x @ self.axes[c]
        levels = np.linspace(0, 1, LEVELS)
        even = np.stack([np.interp(p[:, j], self.quantiles[c][j], levels) for j in range(p.shape[1])], axis=1)
        side = 1 << self.bits
        return hilbert(np.clip((even + self.shift[c]) / 1.5 * side, 0, side - 1).astype(np.int64), self.bits)

    def block_of(self, x: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.edges[c], self.keys(x, c), side="right")

    def first(self, block: np.ndarray) -> np.ndarray:
        """The first of a query's three blocks; at the ends of the order the window reaches as far to the inner side."""
        return np.clip(block - 1, 0, max(0, self.blocks - 3))


def fit(sample: np.ndarray, k: int, curves: int, dims: int, recall: float, queries: int = 256, seed: int = 11) -> Curves:
    """Random rotations, each with its own shift; boundaries are the sample's quantiles at the smallest window of
    WINDOWS whose recall on the sample, measured for ``queries`` of its rows, is high enough (or the largest)."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    dims = min(dims, d)
    out = Curves([], [], [], min(8, 64 // dims))
    for _ in range(curves):
        axes = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :dims]
        out.axes.append(axes)
        out.quantiles.append(np.quantile(sample @ axes, np.linspace(0, 1, LEVELS), axis=0).T)
        out.shift.append(rng.uniform(0, 0.5, size=dims))
    keys = [out.keys(sample, c) for c in range(curves)]
    ordered = [np.sort(x) for x in keys]
    asked = rng.choice(n, min(queries, n), replace=False)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, n - 1)]
    for window in WINDOWS:
        blocks = round(3 / window)
        out.edges = [x[(n * np.arange(1, blocks)) // blocks] for x in ordered]
        at = [np.searchsorted(e, x, side="right") for e, x in zip(out.edges, keys)]
        out.share = [np.bincount(x, minlength=blocks) / n for x in at]
        hit = np.zeros(near.shape, bool)
        for x in at:
            first = out.first(x[asked])[:, None]
            hit |= (first <= x[near]) & (x[near] <= first + 2)
        if not near.size or hit.mean() >= recall:
            break
    return out


def vector_hash(v: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), v), F.xxhash64(F.lit(2), v)]


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v, is_query) of the rows with an id whose vector is finite, complete and not zero; arrays of float
    stay such, all others become double."""
    v = F.col("embedding")
    v = v if rows.schema["embedding"].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), "is_query").where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return good.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def bins_of(rows: np.ndarray, most: int) -> np.ndarray:
    """A bin number for each block: runs of blocks that begin within the same ``most`` expected rows."""
    before = np.cumsum(rows) - rows
    alone = rows > most
    change = np.diff(np.floor(before / max(1, most)), prepend=0) != 0
    return np.cumsum(change | alone | np.concatenate(([False], alone[:-1]))).astype(np.int32)


def search(
    rows: DataFrame, is_query: Column, k: int = 20, curves: int = 16, dims: int = 8, recall: float = 0.93, sample_rows: int = 20_000, part_rows: int = 32_768, part_queries: int = 8192
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, nearest first, ties to smaller ids.

    ``is_query`` is a condition on vec_id. Rows with a null id, and vectors null, empty, zero, holding null or
    non-finite components, or of another length than most, take no part. Repeated (id, vector) rows count once; an
    id with several vectors is several entries. A query whose own id is found is not its own neighbour. Fewer
    candidates than k give them all; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    is_query = F.coalesce(is_query, F.lit(False))
    named = usable(rows.select("vec_id", "embedding", is_query.alias("is_query")))
    common = named.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    h1, h2 = vector_hash(F.col("v"))
    named = named.where(F.size("v") == common[0]["d"]).withColumn("h1", h1).withColumn("h2", h2)
    by_vector = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = named.select("h1", "h2", "vec_id").distinct().withColumn("rn", F.row_number().over(by_vector)).where(F.col("rn") <= k + 1)
    ids = cut(ids.select("h1", "h2", "vec_id"), "ids")
    # One row per distinct vector; it is a query if any of its rows is.
    distinct = cut(named.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max("is_query").alias("is_query"), F.min("vec_id").alias("least")), "vectors")
    n, asked_rows = distinct.agg(F.count("*"), F.count_if("is_query")).first()
    sample = np.array([r["v"] for r in distinct.orderBy("h1", "h2").limit(sample_rows).select("v").collect()], np.float64)
    index = fit(sample, k, curves, dims, recall)
    parts = [np.maximum(1, np.ceil(s * n / part_rows)).astype(np.int64) for s in index.share]
    query_parts = [np.maximum(1, np.ceil(3 * s * asked_rows / part_queries)).astype(np.int64) for s in index.share]
    # Neighbouring small blocks go to one task; a block that is dealt in parts has tasks of its own.
    bins = [bins_of(s * n, part_rows // 4) for s in index.share]
    shared = spark.sparkContext.broadcast((index, parts, query_parts, bins))
    vector = named.schema["v"].dataType.simpleString()

    columns = ["curve", "bin", "salt", "part", "block", "h1", "h2", "least", "v"]

    def dealt(b: pd.DataFrame, c: int, block: np.ndarray, own: np.ndarray, other: np.ndarray, own_name: str, other_name: str) -> pd.DataFrame:
        """Rows b in their blocks: in one part of their own kind, and in every part of the other kind."""
        block = block.astype(np.int64)
        mine = (b["h2"].to_numpy().view(np.uint64) % own[block].astype(np.uint64)).astype(np.int32)
        at = np.repeat(np.arange(len(b)), other[block])
        every = np.concatenate([np.arange(x) for x in other[block]]).astype(np.int32)
        some = b[["h1", "h2", "least", "v"]].iloc[at].reset_index(drop=True)
        return some.assign(**{"curve": np.int32(c), "bin": shared.value[3][c][block[at]], "block": block[at].astype(np.int32), own_name: mine[at], other_name: every})[columns]

    def deal_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, parts, query_parts, _ = shared.value
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                for c in range(curves):
                    yield dealt(b, c, index.block_of(x, c), parts[c], query_parts[c], "salt", "part")

    def deal_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, parts, query_parts, _ = shared.value
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                for c in range(curves):
                    first = index.first(index.block_of(x, c))
                    for step in range(min(3, index.blocks)):
                        yield dealt(b, c, first + step, query_parts[c], parts[c], "part", "salt")

    cells = f"curve int, bin int, salt int, part int, block int, h1 long, h2 long, least long, v {vector}"
    entries = distinct.select("h1", "h2", "least", "v").mapInPandas(deal_entries, cells)
    queries = distinct.where("is_query").select("h1", "h2", "least", "v").mapInPandas(deal_queries, cells)

    def rerank(qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        out = {c: [np.zeros(0, np.float64 if c == "score" else np.int64)] for c in ("q1", "q2", "h1", "h2", "score")}
        es = es.sort_values("block", kind="stable")
        e_block, e1, e2, ids = es["block"].to_numpy(), es["h1"].to_numpy(), es["h2"].to_numpy(), es["least"].to_numpy()
        for block, own in qs.groupby("block", sort=False):
            low, high = np.searchsorted(e_block, [block, block + 1])
            if low == high:
                continue
            e = np.stack(es["v"].iloc[low:high].to_numpy()).astype(np.float64)
            take = min(k + 1, high - low)
            for at in range(0, len(own), 256):
                some = own.iloc[at : at + 256]
                q = np.stack(some["v"].to_numpy()).astype(np.float64)
                s = q @ e.T
                top = np.argpartition(-s, take - 1, axis=1)[:, :take]
                edge = np.take_along_axis(s, top, axis=1).min(axis=1)
                for r in range(len(q)):
                    # What ties with the take-th best score is cut by smallest ids: each entry stands for ids of which
                    # its least is one, so beyond the take-th of these none can be among the k nearest.
                    j = np.flatnonzero(s[r] >= edge[r] - 1e-9)
                    exact = (e[j] * q[r]).sum(axis=1)
                    if len(j) > take:
                        best = np.lexsort((ids[low + j], -exact))[:take]
                        j, exact = j[best], exact[best]
                    out["q1"].append(np.full(len(j), some["h1"].iloc[r]))
                    out["q2"].append(np.full(len(j), some["h2"].iloc[r]))
                    out["h1"].append(e1[low + j])
                    out["h2"].append(e2[low + j])
                    out["score"].append(exact)
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    key = ["curve", "bin", "salt", "part"]
    found = queries.groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(rerank, "q1 long, q2 long, h1 long, h2 long, score double")
    best = found.groupBy("q1", "q2", "h1", "h2").agg(F.max("score").alias("score"))
    # Each found vector stands for its smallest ids, one of which may be the query's own.
    best = best.join(ids, ["h1", "h2"]).select("q1", "q2", "vec_id", "score")
    in_order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    best = cut(best.withColumn("rn", F.row_number().over(in_order)).where(F.col("rn") <= k + 1), "nearest")
    asked = named.where("is_query").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("vec_id").alias("query_id")).distinct()
    near = best.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("near"))
    # One row per query; the query itself is taken out and the first k of the rest are numbered.
    mine = asked.join(near, ["q1", "q2"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    out = mine.select("query_id", F.posexplode("near").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
