"""Embedding whitening by a one-sided Jacobi singular value decomposition.

Vectors are numbers of a grid (``scale`` steps to one), so sums are exact. The fit list holds each distinct vector
once. Its rows, centred by the exact mean, are compressed block by block to upper triangles R (TSQR): a task folds its
rows into one R, sixteen R at a time are folded into one by a tree of shuffles, and the last few meet on the driver, whose
part is a square of the dimension at any number of rows. Plane rotations then make R's columns orthogonal; their
lengths over the root of n are the standard deviations, accurate for small ones too since no covariance is formed, and the
accumulated rotations are the components.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

LONG = (1 << 63) - 1
FAN = 16


def on_grid(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows whose embedding is neither null nor empty and holds finite entries only; x is the floor of
    ``scale`` times each entry."""
    v = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") > 0)
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return good.where(F.forall("v", finite)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fits(*factors: int) -> bool:
    """Whether a product of bounds stays within a long."""
    total = 1
    for f in factors:
        total *= max(1, int(f))
    return total <= LONG


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def exact_sum(x: np.ndarray) -> list[int]:
    x = x if fits(largest(x), len(x)) else x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


@dataclass
class Centre:
    """n rows and their sums by dimension, both exact."""

    n: int
    sums: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs, or as Python's integers where these would overflow."""
        safe = largest(x) * self.n + max(map(abs, self.sums)) <= LONG
        return x * self.n - np.array(self.sums) if safe else x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of squared numerators of each row; None where that exceeds a long."""
        y = self.numerators(x)
        if y.dtype != object and fits(largest(y), largest(y), y.shape[1]):
            return (y * y).sum(axis=1).tolist()
        found = [sum(int(c) ** 2 for c in row) for row in y]
        return [v if v <= LONG else None for v in found]


def centre(fit: DataFrame, d: int) -> Centre:
    """n and the sums over fit (x), added up exactly within tasks and then by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for b in batches:
            if b.num_rows:
                total = [t + s for t, s in zip(total, [*exact_sum(matrix(b.column(0), d)), b.num_rows])]
        with decimal.localcontext(prec=38):
            sums = pa.array([decimal.Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), sums], names=["i", "s"])

    rows = fit.select("x").mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return Centre(found.get(d, 0), [found.get(i, 0) for i in range(d)])


def triangle(*blocks: np.ndarray) -> np.ndarray:
    """R of the rows of all blocks."""
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def tsqr(fit: DataFrame, about: Centre, d: int, rows: int = 4096) -> np.ndarray:
    """R of all centred rows of fit: R'R is the sum of their outer products."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, d))
        for b in batches:
            for at in range(0, b.num_rows, rows):
                r = triangle(r, about.centred(matrix(b.column(0).slice(at, rows), d)))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        # In the order of parts, so reruns agree to the last bit.
        g = g.sort_values("part")
        return pd.DataFrame({"part": [int(g["up"].iloc[0])], "r": [triangle(*[np.asarray(v).reshape(-1, d) for v in g["r"]]).ravel()]})

    found = cut(fit.select("x").mapInArrow(compress, "part int, r array<double>"), "triangles")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > FAN:
        up = found.withColumn("up", F.floor(F.col("part") / FAN).cast("int"))
        found = cut(up.groupBy("up").applyInPandas(fold, "part int, r array<double>"), "triangles")
        parts = -(-parts // FAN)
    last = sorted(found.collect(), key=lambda r: r["part"])  # at most FAN triangles
    return triangle(np.zeros((0, d)), *[np.array(r["r"]).reshape(-1, d) for r in last]) if last else np.zeros((0, d))


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns in rounds of disjoint pairs, as in a round-robin tournament."""
    m = d + d % 2
    ring = list(range(m))
    for _ in range(m - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: m // 2], ring[: m // 2 - 1 : -1]) if max(a, b) < d]
        if pairs:
            yield np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, components): singular values of r, falling, and its right singular vectors as rows.

    Two columns are rotated in their plane until they are orthogonal to rounding; a sweep meets all pairs once, and
    sweeps end when one rotates nothing.
    """
    d = r.shape[1]
    columns, turned = np.ascontiguousarray(r.T), np.eye(d)
    least = np.finfo(float).eps
    for _ in range(sweeps):
        rotated = False
        for p, q in rounds(d):
            a, b = columns[p], columns[q]
            aa, bb, ab = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
            far = np.abs(ab) > least * np.sqrt(aa * bb)
            if not far.any():
                continue
            rotated = True
            p, q, a, b, aa, bb, ab = p[far], q[far], a[far], b[far], aa[far], bb[far], ab[far]
            half = (bb - aa) / (2 * ab)
            tangent = np.where(half >= 0, 1, -1) / (np.abs(half) + np.hypot(1, half))
            cosine = 1 / np.hypot(1, tangent)
            sine = (cosine * tangent)[:, None]
            cosine = cosine[:, None]
            columns[p], columns[q] = cosine * a - sine * b, sine * a + cosine * b
            turned[p], turned[q] = cosine * turned[p] - sine * turned[q], sine * turned[p] + cosine * turned[q]
        if not rotated:
            break
    length = np.sqrt((columns * columns).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    return length[order], turned[order]


@dataclass
class Whitener:
    about: Centre
    components: np.ndarray  # unit rows, by falling eigenvalue
    values: np.ndarray  # their eigenvalues
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.about.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T


def fit(distinct: DataFrame, d: int, components: int) -> Whitener:
    """The first components of the distinct vectors x, fewer where fewer directions vary at all."""
    about = centre(distinct, d)
    length, turned = jacobi(tsqr(distinct, about, d)) if about.n else (np.zeros(0), np.zeros((0, d)))
    rank = int((length > (length[0] if len(length) else 0) * d * np.finfo(float).eps).sum())
    values = length**2 / max(1, about.n)
    k = min(components, rank)
    return Whitener(about, turned[:k], values[:k], float(values.sum()))


def identity_error(distinct: DataFrame, model: Whitener, d: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            z = model.apply(matrix(b.column(0), d)) if b.num_rows else np.zeros((0, k))
            sums += z.sum(axis=0)
            products += z.T @ z
        both = np.concatenate((sums, products.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), pa.int32()), pa.array(both)], names=["i", "s"])

    found = {r["i"]: r["s"] for r in distinct.select("x").mapInArrow(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    both = np.array([found[i] for i in range(k + k * k)]) / model.about.n
    # Rows are centred before they are multiplied, so their mean is rounding error; it is taken out all the same.
    mean = both[:k]
    return float(np.abs(both[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows take no part if their embedding is null or empty, holds null or non-finite entries, or has another length than
    most (the shorter of two as common). Repeated rows stay and count once in the fit; a null vec_id stays null. A
    direction in which nothing varies has no unit variance, so components end at the rank: equal vectors only, or an
    empty table, give no rows. Entries beyond a long's range take its ends; a deviation beyond it is null. Other columns,
    whatever their names, are not read. A vector that a third of the rows share is counted before it is shuffled.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = on_grid(rows.select("vec_id", "embedding"), scale)
    common = named.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    d = common[0]["d"]
    named = named.where(F.size("x") == d)
    distinct = cut(named.select("x").distinct(), "grid-vectors")
    model = fit(distinct, d, components)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, model, d)
    explained = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), d)
            at = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(model.about.deviation(x), pa.int64())
            out = [
                b.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), model.about.n, np.int64)),
                deviation.take(pa.array(at)),
                pa.array(model.apply(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    return named.select("vec_id", "x").mapInArrow(project, schema)
