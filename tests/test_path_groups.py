"""Path-group packing against a plain walk and budget of one query at a time."""

import random

import pytest

from lodestone.operators import path_groups as P

PATHS = "query_id long, at long, src string, dst string, relation string, sources array<string>, chosen boolean"
NODES = "ref string, kind string, status string, sources array<string>, terms array<string>"
FRAGMENTS = "origin string, raw boolean, start long, end long, length long, text string"


def shown(f):
    return f"<{f[0]} {f[2]}:{f[3]}/{f[4]}> {f[5]}"


def plain(roots, paths, nodes, fragments, branches, seen, hops, top_k, card_chars, total_chars):
    """What each root of one query becomes: (root, reason, members, shown places, closed, text length)."""
    rank = {ref: rn for rn, ref in roots}
    groups, held = [], set()
    for _, root in sorted(roots):
        way = {root: []}
        for _ in range(hops):
            found = {}
            for at, src, dst, relation, sources, chosen in sorted(paths):
                if src in way and dst not in way:
                    key = [*(p[0] for p in way[src]), at]
                    if dst not in found or key < found[dst][0]:
                        found[dst] = (key, [*way[src], (at, src, dst, relation, tuple(sources), chosen)])
            # Only ways of exactly this length: a node found in an earlier round is not found again.
            new = {k: v[1] for k, v in found.items() if len(v[1]) == 1 + max(map(len, way.values()))}
            way |= new
        hits = lambda ref: {b for b, terms in branches if set(terms) & set(nodes.get(ref, (0, 0, [], []))[3])}
        gain = {ref: len(hits(ref) - hits(root)) for ref in way}
        change = {ref: any(p[3] in ("supersedes", "contradicts") for p in w) for ref, w in way.items()}
        keep = [ref for ref, w in way.items() if ref == root or ref in seen or any(p[5] for p in w) or change[ref] or gain[ref]]
        keep.sort(key=lambda ref: (ref != root, not change[ref], ref not in seen, -gain[ref], len(way[ref]), rank.get(ref, 1 << 30), ref))
        edges, members = [], [root]
        for ref in keep:
            for p in way[ref]:
                if p[1:5] not in edges:
                    edges.append(p[1:5])
        for e in edges:
            members += [x for x in e[:2] if x not in members]
        if root in held:
            continue
        held.update(members)
        sources = []
        for s in [s for m in members for s in (nodes[m][2] if m in nodes else [])] + [s for e in edges for s in e[3]]:
            if s not in sources:
                sources.append(s)
        own = [f for m in members for f in sorted(x for x in fragments if x[0] == m and not x[1])]
        own += [f for s in sources for f in sorted(x for x in fragments if x[0] == s and x[1])]
        head = [f"({nodes[m][0]}, {nodes[m][1]}) {m}" if m in nodes else f"(unknown, active) {m}" for m in members]
        head += [f"{a} -{r}-> {b} by {', '.join(s)}" for a, b, r, s in edges]
        groups.append({"root": root, "members": members, "edges": edges, "own": own, "head": head, "n_cards": len(members), "taken": [], "reason": "top_k", "kinds": [nodes[m][0] if m in nodes else "unknown" for m in members]})
    size = lambda g, taken: len("\n".join([*g["head"], *map(shown, taken)]))
    covers = lambda a, b: a[0] == b[0] and a[2] <= b[2] and b[3] <= a[3]
    done, left = [], total_chars
    for i, g in enumerate(groups):
        if not g["edges"] and g["own"] and set(g["kinds"]) == {"episode"} and all(f[1] and any(covers(t, f) for c in done for t in c["taken"]) for f in g["own"]):
            g["reason"] = "shown_before"
        elif len(done) < top_k:
            share = min(card_chars, left // max(1, min(top_k - len(done), len(groups) - i)))
            taken = []
            for origin in dict.fromkeys(f[0] for f in g["own"]):
                f = next(f for f in g["own"] if f[0] == origin)
                if size(g, [*taken, f]) <= share:
                    taken.append(f)
            g["reason"] = "packed" if taken else "no_room"
            if taken:
                g["taken"] = taken
                done.append(g)
                left -= size(g, taken)
    for g in done:
        for f in g["own"]:
            if not any(covers(t, f) for t in g["taken"]):
                more = size(g, [*g["taken"], f]) - size(g, g["taken"])
                if size(g, [*g["taken"], f]) <= card_chars and more <= left:
                    g["taken"] = [*g["taken"], f]
                    left -= more
    out = {}
    for g in groups:
        bodies, cited = {f[0] for f in g["taken"] if not f[1]}, {f[0] for f in g["taken"] if f[1]}
        closed = g["reason"] == "packed" and all(a in bodies and b in bodies and set(s) <= cited for a, b, _, s in g["edges"])
        out[g["root"]] = (g["reason"], g["members"], [f"{f[0]} {f[2]}:{f[3]}" for f in g["taken"]], closed, g["edges"] if closed else [])
    return out


def case(seed):
    rng = random.Random(seed)
    refs = [f"n{i}" for i in range(9)]
    words = ["red", "blue", "green", "old"]
    nodes = {r: (rng.choice(["episode", "fact", "entity"]), rng.choice(["active", "superseded"]), [f"raw:{rng.randrange(6)}" for _ in range(rng.randrange(1, 3))], rng.sample(words, 2)) for r in refs}
    fragments = []
    for origin, raw in [(r, False) for r in refs if rng.random() < 0.9] + [(f"raw:{i}", True) for i in range(6) if rng.random() < 0.9]:
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 90)))
        fragments += [(origin, raw, a, min(a + 30, len(text)), len(text), text[a : a + 30]) for a in range(0, len(text), 30)]
    per_query = {}
    for q in range(12):
        roots = [(i + 1, r) for i, r in enumerate(rng.sample(refs, rng.randrange(1, 5)))]
        pairs = [(a, b) for a in refs for b in refs if a != b and rng.random() < 0.15]
        paths = [(at, a, b, rng.choice(["about", "supersedes", "same_event_as", "contradicts"] if rng.random() < 0.4 else ["about"]), [f"raw:{rng.randrange(6)}"], rng.random() < 0.2) for at, (a, b) in enumerate(pairs)]
        branches = [(b, [b]) for b in rng.sample(words, 2)]
        per_query[q] = (roots, paths, branches, set(rng.sample(refs, 2)))
    return nodes, fragments, per_query


def run(spark, nodes, fragments, per_query, **limits):
    roots = spark.createDataFrame([(q, rn, r) for q, (rs, *_) in per_query.items() for rn, r in rs], "query_id long, rn int, ref string")
    paths = spark.createDataFrame([(q, *p) for q, (_, ps, *_) in per_query.items() for p in ps], PATHS)
    branches = spark.createDataFrame([(q, *b) for q, (_, _, bs, _) in per_query.items() for b in bs], "query_id long, branch string, terms array<string>")
    seen = spark.createDataFrame([(q, r) for q, (*_, s) in per_query.items() for r in s], "query_id long, ref string")
    n = spark.createDataFrame([(r, *v) for r, v in nodes.items()], NODES)
    groups = P.useful(P.routes(roots, paths, 2), n, branches, seen, roots)
    return P.pack_groups(P.with_material(groups, n, spark.createDataFrame(fragments, FRAGMENTS)), **limits)


@pytest.mark.parametrize("seed,limits", [(1, (3, 400, 900)), (2, (2, 250, 400)), (3, (9, 5000, 20_000))])
def test_against_a_plain_walk(spark, seed, limits):
    nodes, fragments, per_query = case(seed)
    top_k, card_chars, total_chars = limits
    rows = run(spark, nodes, fragments, per_query, top_k=top_k, card_chars=card_chars, total_chars=total_chars).collect()
    for q, (roots, paths, branches, seen) in per_query.items():
        want = plain(roots, paths, nodes, fragments, branches, seen, 2, top_k, card_chars, total_chars)
        got = {r["root"]: r for r in rows if r["query_id"] == q}
        assert {k: (r["reason"], list(r["members"]), list(r["shown"]), r["path_closed"]) for k, r in got.items()} == {k: v[:4] for k, v in want.items()}
        assert sum(r["chars"] for r in got.values()) <= total_chars and all(r["chars"] <= card_chars for r in got.values())
        assert sorted(r["rn"] for r in got.values() if r["rn"]) == list(range(1, sum(r["reason"] == "packed" for r in got.values()) + 1))
        for k, r in got.items():
            # An edge in a card is closed: its ends and sources are in the card.
            for line in r["content"].split("\n"):
                if "-> " in line and " by " in line and not line.startswith("<"):
                    src, rest = line.split(" -", 1)
                    dst = rest.split("-> ")[1].split(" by ")[0]
                    assert f"<{src} " in r["content"] and f"<{dst} " in r["content"]
            assert r["n_edges"] == len(want[k][4])


def test_a_change_keeps_both_sides(spark):
    nodes = {"old": ("fact", "superseded", ["raw:1"], ["quota"]), "new": ("fact", "active", ["raw:2"], ["quota"])}
    fragments = [("old", False, 0, 11, 11, "Quota 1000."), ("new", False, 0, 11, 11, "Quota 1200."), ("raw:1", True, 0, 21, 21, "Quota was 1000 daily."), ("raw:2", True, 0, 28, 28, "Quota changed to 1200 daily.")]
    per_query = {0: ([(1, "new"), (2, "old")], [(0, "new", "old", "supersedes", ["raw:2"], False)], [("quota", ["quota"])], set("x"))}
    rows = run(spark, nodes, fragments, per_query, top_k=1).collect()
    assert [r["root"] for r in rows] == ["new"] and rows[0]["path_closed"] and rows[0]["complete"]
    assert all(x in rows[0]["content"] for x in ("1000", "1200", "superseded", "-supersedes->"))


def test_what_does_not_fit_is_partial_and_open(spark):
    text = "alpha " * 200
    nodes = {"a": ("fact", "active", ["raw:1"], []), "b": ("fact", "active", ["raw:2"], [])}
    pages = [("raw:1", True, i, min(i + 100, 1200), 1200, text[i : i + 100]) for i in range(0, 1200, 100)]
    fragments = [("a", False, 0, 1, 1, "a"), ("b", False, 0, 400, 400, "b" * 400), *pages]
    per_query = {0: ([(1, "a")], [(0, "a", "b", "contradicts", ["raw:2"], False)], [("x", ["x"])], set("x"))}
    row = run(spark, nodes, fragments, per_query, top_k=1, card_chars=500, total_chars=500).collect()[0]
    assert row["chars"] <= 500 and not row["complete"] and not row["path_closed"] and "-contradicts->" not in row["content"]


def test_a_query_is_one_row_and_cuts_whole_texts_itself(spark):
    nodes, fragments, per_query = case(1)
    whole = {}
    for origin, raw, _, _, _, text in sorted(fragments):
        whole[origin, raw] = whole.get((origin, raw), "") + text
    texts = spark.createDataFrame([(*k, v) for k, v in whole.items()], "origin string, raw boolean, text string")
    n = spark.createDataFrame([(r, *v) for r, v in nodes.items()], NODES)
    edge = [("n0", "n1", "about", ["raw:2"])]
    groups = spark.createDataFrame([(q, f"n{i}", i, [f"n{i}", "n1", "n9"], edge) for q in range(3) for i in range(2)], f"query_id long, root string, root_rn int, members array<string>, edges array<{P.EDGE}>")
    material = P.with_material(groups, n, texts, page=30)
    assert [(r["query_id"], len(r["groups"])) for r in material.sort("query_id").collect()] == [(0, 2), (1, 2), (2, 2)]
    want = P.pack_groups(P.with_material(groups, n, spark.createDataFrame(fragments, FRAGMENTS)), 2, 400, 700).collect()
    assert want and sorted(map(str, P.pack_groups(material, 2, 400, 700).collect())) == sorted(map(str, want))
