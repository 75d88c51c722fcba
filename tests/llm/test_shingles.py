import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lodestone.llm import shingles, simhash


def brute_classes(texts):
    sets = {}
    for d, t in texts.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return label


def test_stage_drops_all_copies_of_similarity(spark, docs_of):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    line, texts = say(30), ["", " ", "Three short words", "three short WORDS"]
    for _ in range(25):
        base = say(rng.randrange(20, 150))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randrange(1, 5)):
                copy[at] = f"x{rng.randrange(50)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(say(rng.randrange(2, 40)) + line))  # a passage in many texts
    texts += [" ".join(line + [f"end{i}"]) for i in range(20)]  # a family
    rows = dict(enumerate(texts))
    docs = docs_of([(d, t, "en", "s") for d, t in rows.items()])
    want = brute_classes(rows)
    for group_rows in (5, 400):
        got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs, group_rows=group_rows).collect()}
        assert got == want
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {d for d in rows if want[d] == d} and len(kept) < len(rows) - 30


def test_odd_rows_and_empty_tables(spark, odd):
    kept = shingles.one_of_each(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 3, 5, 6]
    assert shingles.one_of_each(odd.limit(0)).count() == 0


def test_first_pass_keeps_every_set_that_has_a_partner():
    """Against all pairs, in any mix of sizes, with some shingles common."""
    rng = random.Random(17)
    for _ in range(300):
        n = rng.randrange(1, 60)
        x = rng.sample(range(10_000), n)
        y = [v for v in x if rng.random() > rng.choice([0.02, 0.1, 0.2])] + rng.sample(range(10_000, 20_000), rng.randrange(0, 1 + n // 6))
        a, b = np.array(sorted(x), np.int64), np.array(sorted(set(y)), np.int64)
        both = len(set(x) & set(y))
        if not len(b) or both < 0.8 * (len(a) + len(b) - both) - 1e-9:
            continue
        common = np.array(sorted(rng.sample(range(10_000), 3000)), np.int64)
        counts = np.arange(len(common))
        (ha, na), (hb, nb) = shingles.head(a, common, counts, 0.8), shingles.head(b, common, counts, 0.8)
        shared = len(set(ha.tolist()) & set(hb.tolist()))
        assert shared >= na and shared >= nb


def test_similar_sets_share_a_signature():
    """Against all pairs, in any mix of sizes, with none, some or most shingles common."""
    rng = random.Random(23)
    bounds, met = shingles.size_bounds(0.8), 0
    for case in range(900):
        n = rng.choice([rng.randrange(1, 12), rng.randrange(1, 90), rng.randrange(100, 400)])
        x = rng.sample(range(10_000), n)
        y = [v for v in x if rng.random() > rng.choice([0.02, 0.1, 0.2])] + rng.sample(range(10_000, 20_000), rng.randrange(0, 1 + n // 6))
        both = len(set(x) & set(y))
        if not y or both < 0.8 * (len(x) + len(y) - both) - 1e-9:
            continue
        spread = np.random.default_rng(5).integers(-(2**63), 2**63, 20_000)
        a, b = np.sort(spread[x]), np.sort(spread[y])
        common = np.sort(spread[rng.sample(range(10_000), (0, 3000, 9000)[case % 3])])
        counts = np.arange(len(common))
        sa, sb = (set(shingles.signatures(s, common, counts, 0.8, bounds).tolist()) for s in (a, b))
        assert sa & sb
        met += 1
    assert met > 300


def test_sketches_lose_no_similar_pair():
    """Against all pairs of different roots, in sizes on both sides of a doubling; most other sets are left out."""
    rng, wide = random.Random(29), np.random.default_rng(3)
    sets = []
    for n in (3, 30, 31, 33, 60, 64, 70, 250, 256, 270):
        base = wide.integers(-(2**63), 2**63, n)
        sets.append(np.unique(base))
        for lost in (0.02, 0.1, 0.19, 0.4, 0.7):
            kept = [v for v in base if rng.random() > lost]
            sets.append(np.unique(np.concatenate((np.array(kept, np.int64), wide.integers(-(2**63), 2**63, rng.randrange(0, 2 + n // 12))))))
    root = np.arange(len(sets)) // 2
    want = np.zeros(len(sets), bool)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if root[i] != root[j] and both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                want[i] = True
    got = shingles.hopeful([shingles.sketch(s) for s in sets], np.array([len(s) for s in sets]), root, 0.8)
    assert (got | ~want).all() and want.sum() > 15 and not got.all()


def test_a_pair_meets_where_its_smallest_part_is():
    """Sketches of equal sets in three groups: a pair is kept in the group of the smallest part that it shares."""
    own = [shingles.sketch(np.arange(40, dtype=np.int64))] * 4
    size, root = np.full(4, 40), np.arange(4)
    parts = [np.array([3, 7]), np.array([3, 7, 9]), np.array([7, 9]), np.array([9])]
    held = {p: [k for k in range(4) if p in parts[k]] for p in (3, 7, 9)}
    met = set()
    for p, ks in held.items():
        below = shingles.smaller_parts([parts[k] for k in ks], p)
        for i, a in enumerate(ks):
            for j, b in enumerate(ks):
                if i < j and shingles.hopeful([own[a], own[b]], size[:2], root[[a, b]], 0.8, below[[i, j]]).all():
                    met.add((p, a, b))
    assert met == {(3, 0, 1), (7, 0, 2), (7, 1, 2), (9, 1, 3), (9, 2, 3)}


def test_key_bits_never_miss(spark):
    from lodestone.llm.common import bit_of, has_bit, key_bits

    keys = spark.range(5000).selectExpr("xxhash64(id) as k")
    for most in (1 << 28, 256):
        words = key_bits(keys, "k", most)
        at = lambda df: np.array([r[0] for r in df.select(bit_of("k", words)).collect()])
        assert has_bit(at(keys), words).all() and 64 * len(words) <= most
        others = has_bit(at(spark.range(5000, 10_000).selectExpr("xxhash64(id) as k")), words).mean()
        assert others < 0.12 or most == 256
    assert not has_bit(np.arange(64), key_bits(keys.limit(0), "k")).any()


def test_stage_goes_by_trees_of_fingerprints_and_loses_nothing_beside_them(spark, docs_of, monkeypatch):
    """The forest of close fingerprints is asked, its sets are compared, and an empty forest gives the same classes."""
    rng = random.Random(31)
    rows = {}
    for i in range(30):
        words = [f"w{rng.randrange(900)}" for _ in range(120)]
        rows[2 * i] = " ".join(words)
        words[rng.randrange(120)] = "other"
        rows[2 * i + 1] = " ".join(words)
    docs, asked, forest = docs_of([(d, t, "en", "s") for d, t in rows.items()]), [], shingles.close_forest

    def seen(fps, max_bits):
        links = forest(fps, max_bits)
        asked.append((fps.count(), links.count()))
        return links

    monkeypatch.setattr(shingles, "close_forest", seen)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs).collect()}
    assert got == {d: d - d % 2 for d in rows}
    (fps, links), = asked
    assert fps == 60 and links > 25
    monkeypatch.setattr(shingles, "close_forest", lambda fps, max_bits: spark.createDataFrame([], "src long, dst long"))
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs).collect()} == got


def test_kept_texts_are_not_shuffled(spark, docs_of):
    docs = docs_of([(d, "t" * 20_000, "en", "s") for d in range(400)] + [(None, "x", "en", "s")])
    classes = spark.createDataFrame([(d, d - d % 100) for d in range(400) if d % 100 < 2], "doc_id long, component_id long")
    plan = simhash.keep_first(docs, classes)
    assert sorted(r["doc_id"] or 0 for r in plan.collect()) == sorted([0] + [d for d in range(400) if d % 100 != 1])
    parts = plan._jdf.queryExecution().optimizedPlan().toString()
    assert parts.index("Union") < parts.index("Join LeftAnti") and parts.count("MapInArrow") == 2


def test_pipeline_stages_bound_the_batches_of_texts(spark, docs_of):
    """Texts go to Python in batches of a few MB, not by 10,000 rows; a session that states a limit keeps it."""
    from lodestone.llm.common import BATCH_BYTES

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    docs = docs_of([(d, "t" * 20_000, "en", "s") for d in range(400)]).coalesce(1)
    largest = lambda: max(r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect())
    before = spark.conf.getAll.get(BATCH_BYTES)
    try:
        spark.conf.unset(BATCH_BYTES)
        corpus_pipeline.drop_near_copies(spark, docs, "")
        assert largest() < 3_000_000
        spark.conf.set(BATCH_BYTES, "500k")
        corpus_pipeline.drop_near_copies(spark, docs, "")
        assert largest() < 600_000
    finally:
        spark.conf.set(BATCH_BYTES, before) if before else spark.conf.unset(BATCH_BYTES)
