import json
import random

from pyspark.sql import functions as F

from lodestone.operators import assemble as A
from lodestone.operators import graph as G
from lodestone.operators import overview as O
from lodestone.operators import proposals as U


def test_context_closure_across_episodes(spark):
    units = [("p", 0, "What did I watch?"), ("q", 0, "Yes, I watched it."), ("q", 1, "It was long."), ("r", 0, "Alpha."), ("r", 1, "Beta."), ("s", 0, "He liked that."), ("t", 0, "This is it."), ("g", 0, "They left.")]
    passages = [("p", "s1", 1, 0, 17), ("q", "s1", 2, 0, 30), ("r", "s2", 3, 0, 12), ("s", "s2", 4, 0, 14), ("t", "s3", 5, 0, 11), ("g", "s2", 4, 20, 30)]
    disclosed = [(1, r) for r in "pqrs"] + [(2, r) for r in "qs"] + [(3, r) for r in "pqg"]
    selected = [(1, 1, "q", 1), (1, 2, "q", 0), (1, 3, "s", 0), (1, 4, "t", 0), (2, 1, "q", 0), (2, 2, "s", 0), (3, 1, "q", 0), (3, 2, "q", 1), (3, 3, "p", 0), (3, 4, "g", 0)]
    out = A.closure_across(
        spark.createDataFrame(selected, "query_id long, rn int, ref string, unit int"),
        spark.createDataFrame(disclosed, "query_id long, ref string"),
        spark.createDataFrame(passages, "ref string, session_id string, sequence long, start int, end int"),
        spark.createDataFrame(units, "ref string, unit int, text string"),
    )
    got = sorted(tuple(r) for r in out.collect())
    # Query 1: "it was long" has its first unit selected; that one takes the disclosed passage before, and so does s.
    # Query 2: what stands before was not disclosed. Query 3: p is selected, and g begins behind a gap.
    assert got == [(1, "q", 0, "p", 0, "adjacent_episode"), (1, "s", 0, "r", 1, "adjacent_episode")]


def test_maintenance_context_orders_channels(spark):
    rng = random.Random(5)
    nodes = [(u, u * 100 + i, rng.randrange(1000)) for u in (1, 2) for i in range(30)]
    links = list({(u, a, b): (u, a, b, rng.choice(["about", "contains"]), rng.randrange(99)) for u in (1, 2) for a, b in ((u * 100 + rng.randrange(34), u * 100 + rng.randrange(34)) for _ in range(40))}.values())
    preferred = [(1, 103, 2), (1, 117, 1), (2, 999, 0)]
    hits = [(u, u * 100 + i, rng.random()) for u in (1, 2) for i in rng.sample(range(30), 4)]
    ctx, touched = G.maintenance_context(
        spark.createDataFrame(nodes, "user_id int, node int, updated int"), spark.createDataFrame(preferred, "user_id int, node int, place int"), spark.createDataFrame(hits, "user_id int, node int, place double"),
        spark.createDataFrame(links, "user_id int, src int, dst int, relation string, created int"), limit=12, recent=3, seeds=4, most_links=5,
    )
    got = {}
    for r in sorted(ctx.collect(), key=lambda r: r["rn"]):
        got.setdefault(r["user_id"], []).append((r["node"], r["channel"]))
    for u in (1, 2):
        own = {n: t for v, n, t in nodes if v == u}
        order = [(n, "preferred") for _, n in sorted((p, n) for v, n, p in preferred if v == u and n in own)]
        order += [(n, "hit") for _, n in sorted((p, n) for v, n, p in hits if v == u)]
        order += [(n, "recent") for n in sorted(own, key=lambda n: (-own[n], n))[:3]]
        held = list({n: c for n, c in reversed(order)}.items())
        held = [(n, c) for n, c in dict.fromkeys((n, dict(reversed(order))[n]) for n, _ in order)][:12]
        heads = {n for n, _ in held[:4]}
        newest = sorted((x for x in links if x[0] == u and (x[1] in heads or x[2] in heads)), key=lambda x: (-x[4], x[1], x[2], x[3]))[:5]
        for x in newest:
            held += [(n, "neighbour") for n in x[1:3] if n in own and n not in {m for m, _ in held}]
        assert got[u] == held[:12]
        assert sorted((r["src"], r["dst"], r["relation"]) for r in touched.where(F.col("user_id") == u).collect()) == sorted(x[1:4] for x in newest)


def test_an_overview_fits(spark):
    rng = random.Random(7)
    rows, ordinal = [], 0
    for user in ("a", "b", None):
        for request in range(12):
            for _ in range(rng.randrange(1, 4)):
                ordinal += 1
                rows.append((user, ordinal, f"s{request // 4}", f"r{request % 5}", rng.choice(["user", "assistant"]), "x\"é" * rng.randrange(0, 60)))
    df = spark.createDataFrame([(*r, 20) for r in rows], "user_id string, ordinal long, session_id string, request_id string, role string, text string, watermark long")
    for limit in (700, 10_000, 5):
        got = {r["user_id"]: r for r in O.overview(df.repartition(5), limit).collect()}
        assert len(got) == 3
        for user in ("a", "b", None):
            own = [r for r in rows if r[0] == user]
            groups = []
            for r in own:
                if not groups or groups[-1][-1][2:4] != r[2:4]:
                    groups.append([])
                groups[-1].append(r)
            kept, used = [], len('{"groups": []}')
            for g in groups:
                sample = [{"ordinal": r[1], "planning_only": r[1] > 20, "text": r[5][:80]} for r in ([g[0], g[-1]] if len(g) > 1 else g)]
                told = {"count": len(g), "ordinals": [g[0][1], g[-1][1]], "request": g[0][3], "roles": list(dict.fromkeys(r[4] for r in g)), "samples": sample, "session": g[0][2]}
                text = json.dumps(told, separators=(",", ":"), ensure_ascii=False)
                if used + len(text) + 1 <= limit:
                    kept.append(told)
                    used += len(text) + 1
            r = got[user]
            assert [json.loads(x) for x in r["groups"]] == kept and r["omitted_groups"] == len(groups) - len(kept)
            assert (r["message_count"], r["through"], r["group_count"]) == (len(own), own[-1][1], len(groups))
            assert sum(len(x) + 1 for x in r["groups"]) <= limit


def test_generated_plans_are_rejected_with_reasons(spark):
    fine = (" T ", "c", None, None, [1, 1, 0], ["e", " e", "f"], None, None, None, None, None, None)
    rows = [fine, ("", None, " ", "t" * 121, [], [" "], ["c" * 121], None, None, None, 1.5, ["i" * 129]), ("t", "c", " a   b ", None, [-1], ["x"] * 21, [None], "e" * 81, None, None, float("nan"), []), ("t", "c", None, None, None, None, None, None, None, None, 0.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "no int, " + U.FACT)
    got = {r["no"]: r for r in U.facts(df).collect()}
    assert got[0]["rejected"] == [] and got[0]["title"] == "T" and got[0]["source_ordinals"] == [1, 0] and got[0]["entities"] == ["e", "f"] and got[0]["concepts"] == [] and got[0]["confidence"] == 0.8
    assert got[1]["rejected"] == ["title_missing", "content_missing", "time_expression_too_long", "canonical_key_blank", "no_source", "entities_invalid", "concepts_invalid", "supersedes_memory_ids_invalid", "confidence_out_of_range"]
    assert got[2]["rejected"] == ["event_time_too_long", "source_ordinal_negative", "entities_too_many", "concepts_invalid", "confidence_out_of_range"] and got[2]["canonical_key"] == "a b"
    assert got[3]["rejected"] == ["no_source"]
    plans = spark.createDataFrame([(0, ["a ", "a"], None, None, None, None, None), (1, ["q"] * 9, ["k" * 121], [""], [None], None, "later")], "no int, " + U.SEARCH)
    found = {r["no"]: r for r in U.searches(plans).collect()}
    assert found[0]["rejected"] == [] and found[0]["retrieval_queries"] == ["a"] and found[0]["intent"] == "general" and found[0]["keywords"] == []
    assert found[1]["rejected"] == ["intent_unknown", "retrieval_queries_too_many", "keywords_invalid", "entity_names_invalid", "time_hints_invalid"]
    cited = spark.createDataFrame([(1, 0, [0, 3, 4]), (1, 1, [0])], "plan_id int, fact_no int, source_ordinals array<int>")
    batch = spark.createDataFrame([(1, 0), (1, 1), (2, 3)], "plan_id int, ordinal int")
    assert [tuple(r) for r in U.known_sources(cited, batch).collect()] == [(1, 0, [3, 4])]
