import random

import numpy as np
import xxhash

from lodestone.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_bits():
    for t in (None, "", "one", "Ä b C d", "a b c d e\x0bf g  h", "x y z w " * 50):
        assert simhash.text_fingerprint(t) % 2**64 == brute_fingerprint(t)


def families(rng, n_single=300, families=12):
    """Random fingerprints, dense families and chains around some of them."""
    out = {rng.getrandbits(64) for _ in range(n_single)}
    for _ in range(families):
        c = rng.getrandbits(64)
        for _ in range(rng.randrange(2, 40)):
            out.add(c)
            step = c
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                step ^= 1 << b
            out.add(step)
            c = step if rng.random() < 0.3 else c
    return sorted(out)


def brute_components(fps, bits):
    u = np.array(fps, np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= bits
    label = np.arange(len(u))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            return label
        label = new


def test_links_are_exact_for_several_radii(spark):
    rng = random.Random(5)
    for bits in (1, 2, 4, 5):
        fps = families(rng)
        signed = [int(np.array([x], np.uint64).view(np.int64)[0]) for x in fps]
        df = spark.createDataFrame([(x,) for x in signed], "fp long")
        # A small shard limit makes salted cells meet too.
        edges = simhash.close_forest(df, bits, shard_rows=60 if bits == 4 else 40_000)
        root = dict(map(tuple, simhash.components(edges).collect()))
        want = brute_components(fps, bits)
        got = [root.get(x, x) for x in signed]
        groups = lambda labels: sorted(sorted(signed[i] for i in range(len(labels)) if labels[i] == k) for k in set(labels))
        assert groups(got) == groups(want.tolist())


def test_components_of_long_chains(spark):
    e = [(i, i + 1) for i in range(60)] + [(100, 101)]
    df = spark.createDataFrame(e, "src long, dst long")
    got = dict(map(tuple, simhash.components(df).collect()))
    assert set(got.values()) == {0, 100} and len(got) == 63


def test_odd_rows_and_empty_tables(spark, odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == 9
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in out}
    assert by[(1, "0" * 16)] == by[(2, "0" * 16)] == by[(4, "0" * 16)] == 1
    assert {r["component_id"] for r in out if r["doc_id"] in (6, 7)} == {6}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 5, 6]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_component_ids_against_brute_force(docs_of):
    """Also with one text that a third of the rows share, so that its key is joined by broadcast."""
    rng = random.Random(31)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(10_000)}" for _ in range(300)]
        rows.append((3 * i + 1, " ".join(w)))
        for k in range(i % 4):
            v = list(w)
            v[rng.randrange(300)] = f"x{k}"
            rows.append((3000 + 10 * i - k, " ".join(v)))
    rows += [(5000 - i, rows[0][1]) for i in range(60)] + [(None, rows[0][1]), (None, None), (9000, None), (9000, None)]
    got = simhash.near_duplicates(docs_of([(d, t, "en", "s") for d, t in rows])).collect()
    fps = sorted({brute_fingerprint(t) for _, t in rows})
    label = dict(zip(fps, brute_components(fps, 4).tolist()))
    first = {}
    for d, t in rows:
        if d is not None:
            c = label[brute_fingerprint(t)]
            first[c] = min(first.get(c, d), d)
    want = sorted((d or 0, f"{brute_fingerprint(t):016x}", first[label[brute_fingerprint(t)]]) for d, t in rows)
    assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got) == want


def test_a_branch_without_sample_is_not_split():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 21, 100).astype(np.uint64)
    nodes = simhash.routing_tree(sample, 8, rng)
    values = rng.integers(0, 1 << 21, 500).astype(np.uint64)
    rows, leaf = simhash.route(values, nodes, 8)
    assert set(rows.tolist()) == set(range(500)) and sum(mu < 0 for _, mu in nodes) > 100
    for i in range(0, 500, 7):  # neighbours at distance 1 share a leaf
        for b in range(21):
            near = np.array([values[i], values[i] ^ np.uint64(1 << b)], np.uint64)
            r, at = simhash.route(near, nodes, 8)
            assert set(at[r == 0].tolist()) & set(at[r == 1].tolist())
