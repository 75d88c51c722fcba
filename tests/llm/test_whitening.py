import numpy as np
import pytest

from lodestone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n string, part string, i string, component string, d string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", "x", "x") for i, v in rows], SCHEMA.replace("float", kind))


def vectors(seed, n, d, spread=None):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * (np.linspace(1, 3, d) if spread is None else spread)).astype(np.float32)


def plain(x, k):
    """Eigenvalues and vectors of the covariance of the distinct rows, by numpy."""
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / len(fit))
    return len(fit), fit.sum(axis=0), value[::-1][:k], vector[:, ::-1][:, :k], value.sum()


@pytest.mark.parametrize("d", [2, 5, 8])
def test_against_eigenvectors(spark, d):
    v = vectors(d, 300, d)
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(1000 + i, v[7].tolist()) for i in range(40)] + [(5, v[5].tolist()), (None, v[9].tolist())]
    bad = [(2000, None), (2001, []), (2002, [None] * d), (2003, [float("nan")] * d), (2004, [float("inf")] * d), (2005, [1.0] * (d + 1))]
    found = whitening.whiten(table(spark, rows + bad).repartition(5)).collect()
    x = np.floor(np.array([r for _, r in rows], np.float64) * 256)
    n, s, value, vector, trace = plain(x, min(4, d))
    assert len(found) == len(rows) * min(4, d)
    exact = {}
    for (i, _), y in zip(rows, x):
        exact[i] = (int(sum((int(n * a) - int(b)) ** 2 for a, b in zip(y, s))), (y - s / n) @ (vector / np.sqrt(value)))
    sign = {}
    for r in found:
        k = r["component"] - 1
        deviation, z = exact[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == deviation
        assert abs(r["explained"] - value[k] / trace) < 1e-9 and r["identity_error"] < 1e-9
        if abs(z[k]) > 1e-6:
            sign.setdefault(k, np.sign(z[k] * r["whitened"]))
        assert abs(r["whitened"] - sign.get(k, 1) * z[k]) < 1e-8


def test_jacobi_keeps_small_values():
    """Singular values far apart come out to relative precision, where a covariance would lose them."""
    rng = np.random.default_rng(1)
    u, v = np.linalg.qr(rng.normal(size=(40, 9)))[0], np.linalg.qr(rng.normal(size=(9, 9)))[0]
    want = 10.0 ** -np.arange(0, 9)
    # Graded columns: the matrix holds its small values to full precision.
    a = (u * want) @ np.eye(9)
    length, turned = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(length, want, rtol=1e-10)
    length, turned = whitening.jacobi(np.linalg.qr((u * want) @ v.T, mode="r"))
    assert np.allclose(length[:4], want[:4], rtol=1e-10) and np.allclose(turned @ turned.T, np.eye(9), atol=1e-13)


def test_rounds_meet_every_pair_once():
    for d in (1, 2, 3, 8, 9):
        met = [(int(a), int(b)) for p, q in whitening.rounds(d) for a, b in zip(p, q)]
        assert sorted(met) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_the_tree_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    v = np.floor(vectors(3, 200, 4).astype(np.float64) * 256).astype(int)
    fit = spark.createDataFrame([(r.tolist(),) for r in np.unique(v, axis=0)], "x array<long>").repartition(9)
    about = whitening.centre(fit, 4)
    assert about.n == len(np.unique(v, axis=0)) and about.sums == np.unique(v, axis=0).sum(axis=0).tolist()
    r = whitening.tsqr(fit, about, 4, rows=16)
    centred = np.unique(v, axis=0) - np.unique(v, axis=0).mean(axis=0)
    assert r.shape == (4, 4) and np.allclose(r.T @ r, centred.T @ centred, rtol=1e-10)


def test_ranks_and_empty_tables(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]
    found = whitening.whiten(table(spark, flat)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 6 and abs(found[0]["explained"] - 1) < 1e-12
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (None, [None])])).collect() == []


def test_numbers_beyond_longs(spark):
    huge = [(0, [1e12, 0.0]), (1, [-3e12, 5.0]), (2, [2.0, 1e11])]
    found = whitening.whiten(table(spark, huge, "double"), components=1).collect()
    x = [[int(np.floor(c * 256)) for c in v] for _, v in huge]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * a - b) ** 2 for a, b in zip(y, s)) for i, y in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in found} == {i: v if v < 2**63 else None for i, v in want.items()}
