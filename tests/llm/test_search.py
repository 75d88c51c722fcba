import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.llm import ann, decontam


def test_hilbert_is_a_walk_through_every_cell():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        grid = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
        key = ann.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(side**dims))
        walk = grid[np.argsort(key)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(s[i], 12), ids[i]))
        out[q] = [ids[i] for i in order[:k]]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[100]  # a vector that a third of the rows share
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(600))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score string")
    out = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    want = brute(ids, x, range(0, 600, 20), 20)
    got = {q: g.sort_values("rank").vec_id.tolist() for q, g in out.groupby("query_id")}
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert got[120] == [i for i in range(100, 121) if i != 120][:20] == want[120]
    for r in out.itertuples():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12


def scored_share(index):
    """Pairs scored per query over the number of rows, for queries spread like the rows."""
    total = 0.0
    for s in index.share:
        for b, p in enumerate(s):
            first = int(index.first(np.array([b]))[0])
            total += p * s[first : first + 3].sum()
    return total


def clustered(n, d, clusters, rng):
    x = rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def measured(spark, x, **settings):
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    out = ann.search(df, F.col("vec_id") % 500 == 0, **settings).toPandas()
    queries = np.arange(0, len(x), 500)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    want = np.argsort(-s, axis=1, kind="stable")[:, :20]
    got = {q: set(g.vec_id) for q, g in out.groupby("query_id")}
    return np.mean([len(got[q] & set(w)) / 20 for q, w in zip(queries, want)])


def test_recall_at_50000_rows_without_searching_all(spark):
    x = clustered(50_000, 32, 400, np.random.default_rng(5)).astype(np.float32).astype(np.float64)
    share = scored_share(ann.fit(x[:20_000], 20, 24, 8, 0.93))
    assert share < 0.3
    assert measured(spark, x) >= 0.9


def test_parts_change_nothing(spark):
    x = clustered(3000, 16, 20, np.random.default_rng(6))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    whole = ann.search(df, F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    parts = ann.search(df, F.col("vec_id") % 20 == 0, part_rows=100, part_queries=10).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, parts)


def test_a_dense_cluster_is_dealt_in_parts():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16))
    x[:2000] = x[0] + 1e-3 * rng.normal(size=(2000, 16))
    index = ann.fit(x, 20, 4, 8, 0.5)
    # The axes are evened out, so near-equal vectors spread over blocks like any others.
    assert max(s.max() for s in index.share) < 0.1


def test_odd_vectors(spark):
    rows = [(0, None), (20, []), (1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 0.0]), (5, [1.0, 2.0, 3.0]), (40, [1.0, 0.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(40, 1, 6, 0.5), (40, 2, 7, -1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def smith_waterman(r, q):
    h = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
    best = 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if q[i - 1] == r[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    rng = random.Random(1)
    regions = [np.array([rng.randrange(4) for _ in range(rng.randrange(1, 25))]) for _ in range(200)]
    items = [np.array([rng.randrange(4) for _ in range(rng.randrange(1, 15))]) for _ in range(200)]
    for (score, first, last), r, q in zip(decontam.align(regions, items), regions, items):
        assert score == smith_waterman(r.tolist(), q.tolist())
        assert score == 0 or smith_waterman(r[first : last + 1].tolist(), q.tolist()) == score


def brute_contaminated(docs, items, threshold):
    words = {i: decontam.words_of(t) for i, t in items}
    return {(d, i) for d, t in docs for i, w in words.items() if len(w) >= 3 and smith_waterman(decontam.words_of(t), w) / len(w) >= threshold}


def test_contamination_against_brute_force(spark, docs_of):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(12, 30)))) for i in range(15)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(60):
        w = say(rng.randrange(0, 120))
        if d % 3 == 0:
            copy = decontam.words_of(items[d % 15][1])
            for _ in range(d % 4):  # replaced, added and missing words
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = say(rng.randrange(2))
            w[rng.randrange(len(w) + 1) : 0] = [x.upper() for x in copy]
        docs.append((d, ", ".join(w), "en", "s"))
    got = decontam.contaminated(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    want = brute_contaminated([(d, t) for d, t, _, _ in docs], items, decontam.THRESHOLD)
    assert found == want and len(want) >= 20
    kept = decontam.decontaminate(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in want}


def test_heavily_edited_copies_against_brute_force(spark, docs_of):
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(15, 40)))) for i in range(30)]
    docs = []
    for i, text in items:
        w = text.split()
        for share in (0.2, 0.25, 0.3):
            copy = list(w)
            for at in rng.sample(range(len(w)), round(share * len(w))):
                copy[at] = f"x{rng.randrange(50)}"
            docs.append((len(docs), " ".join(["before"] * 5 + copy + ["after"] * 5), "en", "s"))
        added = [x for k, y in enumerate(w) for x in ([y, f"y{k}"] if k % 2 else [y])]  # no three words in a row are left
        docs.append((len(docs), " ".join(added), "en", "s"))
        docs.append((len(docs), " ".join(added * 9), "en", "s"))
    got = decontam.contaminated(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contaminated([(d, t) for d, t, _, _ in docs], items, decontam.THRESHOLD)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) >= 110
    best = {(d, i): smith_waterman(decontam.words_of(docs[d][1]), decontam.words_of(items[i][1])) / len(items[i][1].split()) for d, i in want}
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == best


def test_blocks_find_what_one_block_finds(spark, docs_of):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(20)], "item_id long, text string")
    docs = docs_of([(i, f"before alpha{i} beta{i} gamma{i} delta{i} epsilon{i} after", "en", "s") for i in range(0, 30, 3)])
    found = lambda **kw: sorted(tuple(r) for r in decontam.contaminated(docs, items, **kw).collect())
    assert found(block_chars=150) == found() and len(found()) == 7
    kept = decontam.decontaminate(docs, items, block_chars=150)
    assert sorted(r["doc_id"] for r in kept.collect()) == [21, 24, 27]


def test_alignment_is_bounded_in_memory():
    rng = random.Random(5)
    regions = [np.array([rng.randrange(6) for _ in range(n)]) for n in (5, 5000, 80, 3, 3000, 40)]
    items = [np.array([rng.randrange(6) for _ in range(12)]) for _ in regions]
    assert decontam.align(regions, items, cells=100) == decontam.align(regions, items)


def test_blocks_of_items_agree(spark, docs_of):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(20)], "item_id long, text string")
    whole = [sorted(x) for x in decontam.blocks_of(items)]
    parts = [sorted(x) for x in decontam.blocks_of(items, 150)]
    assert len(whole) == 1 and len(parts) > 1 and sorted(sum(parts, [])) == whole[0]


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "go on and on the words"), (1, "go on and on the words"), (None, None)], "item_id long, text string")
    out = decontam.contaminated(odd, items).collect()
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in out] == [(3, 1, 1.0)] * 2
    assert decontam.contaminated(odd, items.limit(0)).count() == 0
    assert decontam.decontaminate(odd.limit(0), items).count() == 0


def test_ties_are_cut_by_id(spark, monkeypatch):
    """Binary vectors, of which most tie: with the whole order in each window the result is that of brute force, and no task
    reports more than k + 1 entries for a query, curve and block."""
    rng = np.random.default_rng(8)
    x = (rng.random((900, 10)) < 0.3).astype(float)
    x = x[x.any(axis=1)]
    ids = list(range(len(x)))
    monkeypatch.setattr(ann, "WINDOWS", (1.0,))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    out = ann.search(df, F.col("vec_id") % 20 == 0, k=7, curves=2).toPandas()
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 7)
    assert {q: g.sort_values("rank").vec_id.tolist() for q, g in out.groupby("query_id")} == want
    narrow = ann.search(df, F.col("vec_id") % 20 == 0, k=7, curves=2, part_rows=50).toPandas()
    assert narrow.sort_values(["query_id", "rank"]).vec_id.tolist() == out.sort_values(["query_id", "rank"]).vec_id.tolist()
