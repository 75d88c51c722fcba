import random
import statistics

import pytest

from lodestone.operators import explore as X
from lodestone.operators import forget as G
from lodestone.operators import ingest
from lodestone.operators.quantiles import exact_quantiles

SOURCES = "user_id string, sequence long, role string, text string"


def states(spark, rows, **more):
    return {(r["user_id"], r["sequence"]): (r["state"], r["forgotten_by"]) for r in G.forget_topics(spark.createDataFrame(rows, SOURCES), **more).collect()}


def test_a_candidate_needs_the_same_subject(spark):
    rows = [("a", 1, "user", "A student left school."), ("a", 2, "user", "Please forget my friend dying.")]
    rows += [("b", 1, "user", "Secret code maple."), ("b", 2, "user", "The code of the door is red."), ("b", 3, "user", "Forget my secret code."), ("b", 4, "user", "My secret code is new now.")]
    rows += [("c", 1, "user", "I will never forget my family."), ("c", 2, "assistant", "Forget my family? No."), (None, 1, "user", "Nobody's secret code.")]
    got = states(spark, rows)
    assert got["a", 1] == ("active", None) and got["a", 2][0] == "instruction"
    assert got["b", 1] == ("blocked", 3) and got["b", 2] == ("active", None) and got["b", 4] == ("active", None)
    assert {v for k, v in got.items() if k[0] == "c"} == {("active", None)} and got[None, 1] == ("active", None)


def test_verification_is_independent_of_the_search(spark):
    class Never:
        asked = 0

        def matches(self, topic, command, message):
            return message.contains("nothing")

    rows = [("b", 1, "user", "Secret code maple."), ("b", 2, "user", "Forget my secret code.")]
    assert states(spark, rows, verifier=Never())["b", 1] == ("active", None)
    assert states(spark, [])== {}


def test_blocked_sources_cascade(spark):
    rows = [("b", 1, "user", "Secret code maple."), ("b", 2, "user", "Tea at four."), ("b", 3, "user", "Forget the secret code.")]
    gone = G.forget_topics(spark.createDataFrame(rows, SOURCES)).where("state = 'blocked'").selectExpr("cast(sequence as string) as source")
    items = spark.createDataFrame([("note1", ["1", "2"]), ("note2", ["2"])], "item_id string, sources array<string>")
    assert {r["item_id"]: r["blocked"] for r in ingest.cascade_block(items, gone).collect()} == {"note1": True, "note2": False}


def test_rare_words_find_all_that_counting_finds(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    rows, n = [], {}
    for user in ("u", "v"):
        for s in range(60):
            ask = rng.random() < 0.2
            some = [min(rng.choice(words), rng.choice(words)) for _ in range(rng.randrange(1, 6))]
            rows.append((user, s, "user", ("Forget " if ask else "") + " ".join(some) + "."))
            n[user, s] = (ask, set(some))
    want = {}
    for (u, s), (ask, own) in n.items():
        by = [c for (v, c), (asks, topic) in n.items() if v == u and asks and c > s and not ask and len(own & topic) >= -(-len(topic) * 3 // 4)]
        want[u, s] = ("instruction", None) if ask else ("blocked", min(by)) if by else ("active", None)
    assert states(spark, rows) == want


def queue(edges, seed, hops, nodes, fan_out):
    """Best-first with a frontier, a node at a time, over (node, hop) states so that no walk is cut short too early."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((-w, b, "inspect"))
        near.setdefault(b, []).append((-w, a, "backlinks"))
    frontier, settled = [(-1.0, 0, (seed,))], {}
    while frontier:
        frontier.sort()
        score, hop, path = frontier.pop(0)
        if path[-1] in settled and settled[path[-1]][1] <= hop:
            continue
        settled.setdefault(path[-1], (-score, hop, path))
        if hop < hops:
            frontier += [(score * -w, hop + 1, (*path, b)) for w, b, _ in sorted(x for x in near.get(path[-1], []) if x[1] != path[-1])[:fan_out]]
    order = sorted(settled.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))
    return [(n, h, p) for n, (_, h, p) in order[:nodes]], len(order)


@pytest.mark.parametrize("seed", [1, 2])
def test_exploration_is_best_first(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25), rng.choice([0.5, 0.625, 0.75, 0.875, 1.0])) for _ in range(60)]
    edges = list({(a, b): (a, b, w) for a, b, w in edges if a != b}.values())
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    seeds = spark.createDataFrame([(i,) for i in range(0, 25, 4)], "node long")
    rows = X.explore(df, seeds, hops=3, nodes=7, fan_out=3).collect()
    for s in range(0, 25, 4):
        want, found = queue(edges, s, 3, 7, 3)
        got = sorted((r for r in rows if r["seed"] == s), key=lambda r: r["rank"])
        assert [(r["node"], r["hop"], tuple(r["path"])) for r in got] == want
        assert {r["found"] for r in got} == {found}
        assert all(len(r["log"]) == r["hop"] for r in got)


def test_a_hot_node_is_cut_before_it_meets(spark):
    star = spark.range(20_000).selectExpr("-1L as src", "id as dst", "1.0 / (2 + id) as weight")
    rows = X.explore(star, spark.createDataFrame([(5,), (-1,)], "node long"), hops=2, nodes=6, fan_out=4).collect()
    assert sorted(r["node"] for r in rows if r["seed"] == -1) == [-1, 0, 1, 2, 3]
    assert sorted(r["node"] for r in rows if r["seed"] == 5) == [-1, 0, 1, 2, 3, 5]


def test_exact_quantiles_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(50)) if i % 3 else 7.0) for i in range(3000)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("two", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    got = {(r["k"], r["share"]): r["value"] for r in exact_quantiles(df, ["k"], "v", shares).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).extend([v] if v is not None else [])
    assert {k for k, _ in got} == {"hot", "one", None}
    for k, vs in by.items():
        vs.sort()
        for p in shares if vs else []:
            at = (len(vs) - 1) * p
            low = vs[int(at)]
            high = vs[min(int(at) + 1, len(vs) - 1)]
            assert got[k, p] == pytest.approx(low + (high - low) * (at - int(at)))
    assert statistics.median(by["hot"]) == got["hot", 0.5]
    assert exact_quantiles(df.limit(0), ["k"], "v", shares).collect() == []
