import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.engine import MemoryEngine
from lodestone.operators import assemble, evaluate, graph, ingest, normalize, retrieve
from lodestone.providers import ContractError, positions, tool_arguments
from lodestone.sources import readers
from lodestone.streaming import ingest as stream


def request(rid, user, session, *texts):
    return {"request_id": rid, "user_id": user, "session_id": session, "messages": [{"role": "user" if i % 2 == 0 else "assistant", "content": t, "timestamp": 1000 * i} for i, t in enumerate(texts)]}


@pytest.fixture()
def engine(spark, tmp_path):
    return MemoryEngine(spark, str(tmp_path / "store"))


def frame(spark, *rows):
    return spark.createDataFrame(spark.sparkContext.parallelize([json.dumps(r) for r in rows]).map(lambda x: (x,)), "j string").select(F.from_json("j", schemas.ADD_REQUEST).alias("r")).select("r.*")


def test_add_search_isolation_and_idempotency(spark, engine):
    first = request("r1", "ann", "s1", "My cat is called Miso and likes tuna", "Good to know")
    assert [r["status"] for r in engine.add(frame(spark, first)).collect()] == ["accepted"]
    assert [r["status"] for r in engine.add(frame(spark, first)).collect()] == ["replayed"]
    assert [r["status"] for r in engine.add(frame(spark, request("r1", "ann", "s1", "changed"))).collect()] == ["conflict"]
    engine.add(frame(spark, request("r2", "bob", "s9", "The weather in Paris is mild")))
    q = spark.createDataFrame([(1, "ann", "What is my cat called", 5), (2, "bob", "cat", 5), (3, "eve", "cat", 5)], "query_id long, user_id string, query string, top_k int")
    out = engine.search(q).toPandas()
    assert "Miso" in out[(out.query_id == 1) & (out.rn == 1)].content.iloc[0]
    assert not out[out.query_id == 2].content.str.contains("Miso").any()
    assert len(out[out.query_id == 3]) == 0


def test_forget_all_is_a_barrier(spark, engine):
    engine.add(frame(spark, request("r1", "ann", "s1", "I live in Oslo", "ok", "Forget everything", "done", "I live in Rome now")))
    q = spark.createDataFrame([(1, "ann", "where do I live", 10)], "query_id long, user_id string, query string, top_k int")
    texts = " ".join(r["content"] for r in engine.search(q).collect())
    assert "Rome" in texts and "Oslo" not in texts


def test_stream_equals_batch(spark, tmp_path):
    rows = [request(f"r{i}", f"u{i % 3}", "s", f"message number {i} about topic{i}") for i in range(9)]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps(r) for r in rows[3 * i : 3 * i + 3]))
    streamed = MemoryEngine(spark, str(tmp_path / "a"))
    stream.run_adds(stream.read_requests(spark, str(tmp_path / "in")), streamed, str(tmp_path / "cp")).awaitTermination()
    batch = MemoryEngine(spark, str(tmp_path / "b"))
    batch.add(frame(spark, *rows))
    read = lambda e: sorted(map(tuple, e.tables.read("passages", schemas.PASSAGE).select("user_id", "text").collect()))
    assert read(streamed) == read(batch)


def test_streaming_state(spark, tmp_path):
    rows = [("a", 1, "user", True), ("a", 2, "assistant", False), ("a", 3, "user", False), ("a", 4, "assistant", False), ("b", 5, "assistant", False)]
    df = spark.createDataFrame(rows, "user_id string, sequence long, role string, command boolean")
    df.write.parquet(str(tmp_path / "s"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = stream.confirmation_windows(src).writeStream.format("memory").queryName("conf").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = ingest.confirmation_window(df, F.col("command"), "user_id").select("user_id", "sequence", "instruction")
    assert sorted(map(tuple, spark.sql("select * from conf").collect())) == sorted(map(tuple, batch.collect())) == [("a", 2, 1)]


def test_bm25_formula(spark):
    docs = spark.createDataFrame([("c", 1, ["a", "b", "a"]), ("c", 2, ["b", "d"]), ("c", 3, ["e"])], "u string, ref int, terms array<string>")
    q = spark.createDataFrame([("c", 7, ["a", "b", "a"])], "u string, q int, terms array<string>")
    got = {r["ref"]: r["score"] for r in retrieve.bm25(docs, q, "u", "ref", "q").collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda df, tf, n: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2))
    assert got.keys() == {1, 2}
    assert got[1] == pytest.approx(part(1, 2, 3) + part(2, 1, 3)) and got[2] == pytest.approx(part(2, 1, 2))


def test_disclosure_goes_on_past_seen_heads(spark):
    rows = [(1, 1, "n1", ["a", "b", "c"]), (1, 2, "n2", ["a", "d"]), (1, 3, "b", ["b"])]
    out = assemble.disclose(spark.createDataFrame(rows, "query_id long, rn long, entry string, targets array<string>")).orderBy("rn").collect()
    assert [(r["ref"], r["entry"]) for r in out] == [("a", "n1"), ("d", "n2"), ("b", "b"), ("c", "n1")]


def test_pack_skips_what_does_not_fit(spark):
    rows = [(1, 1, "a", 0, 500), (1, 2, "b", 0, 900), (1, 3, "a", 5, 100), (1, 4, "c", 0, 100)]
    out = assemble.pack(spark.createDataFrame(rows, "query_id long, rn long, ref string, start long, cost long"), top_k=2, budget=1000).orderBy("rn").collect()
    assert [(r["ref"], r["n_units"], r["cost"]) for r in out] == [("a", 2, 664), ("c", 1, 164)]


def test_components_and_walks(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (5, 4, "x"), (3, 1, "x")], "src long, dst long, relation string")
    assert dict(map(tuple, graph.components(e).collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    seeds = spark.createDataFrame([(2,)], "node long")
    assert {(r["node"], r["hop"]) for r in graph.bfs(e, seeds, 2).collect()} == {(2, 0), (1, 1), (3, 1)}


def test_metrics_count_misses(spark):
    ranks = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, None, "a"), (2, 0, 6, "b")], "s long, target_index int, match_rank int, c string")
    got = {(r["cutoff"], r["group"]): r for r in evaluate.retrieval_metrics(ranks, "s", F.lit(10), by="c").collect()}
    assert got[(5, "all")]["hit_rate"] == 0.5 and got[(10, "all")]["evidence_recall"] == pytest.approx(0.666667)
    assert got[(1, "all")]["mrr"] == pytest.approx((1 + 1 / 6) / 2, abs=1e-6)


def test_adapters(spark):
    conv = {"speaker_a": "Ann", "speaker_b": "Bo", "session_2": [{"dia_id": "D2:1", "speaker": "Bo", "text": "hi"}], "session_2_date_time": "1:56 pm on 8 May, 2023", "session_10": [{"dia_id": "D10:1", "speaker": "Ann", "text": "look", "blip_caption": "a cat"}]}
    qa = [{"question": "q", "answer": "a", "category": 1, "evidence": ["D2:01"]}, {"question": "q2", "answer": "a", "category": 2, "evidence": ["D3:1"]}]
    turns, tasks = normalize.numbered_sessions(spark.createDataFrame([("x", json.dumps(conv), json.dumps(qa))], "sample_id string, conversation string, qa string"))
    got = turns.orderBy("session_no").collect()
    assert [(r["id"], r["role"], r["content"]) for r in got] == [("D2:1", "assistant", "hi"), ("D10:1", "user", "look\n[Image: a cat]")]
    assert got[0]["timestamp"] == 1683554160000 and got[1]["timestamp"] is None
    assert [r["excluded"] for r in tasks.orderBy("task_no").collect()] == [False, True]
    nested = [[{"role": "user", "content": "a"}], {"k": [{"role": "assistant", "content": "c"}, {"role": "system", "content": "no"}, {"role": "user", "content": ["no"], "in": {"role": "user", "content": "d"}}]}]
    assert normalize.flatten_chat(nested) == [("user", "a"), ("assistant", "c"), ("user", "d")]
    deep = "x"
    for _ in range(5000):
        deep = [deep]
    assert normalize.flatten_chat(deep) == []


def test_readable_rows():
    value = {"a": '{"b": [1, 2]}', "c": "[1, {'d': None}]", "e": "{plain", "f": [], "g": {"h": {"i": {"j": {"k": 1}}}}}
    assert normalize.readable(value) == [("a.b", "1. 1\n2. 2"), ("c.1", "1"), ("c.2.d", "null"), ("e", "{plain"), ("f", "[]"), ("g.h.i.j", '{"k": 1}')]
    assert normalize.readable("x" * 800) == [("", "x" * 700 + "…")]
    assert len(normalize.readable({str(i): i for i in range(99)})) == 24
    # A value of many branches without leaves ends after so many looks.
    assert normalize.readable([[[[]] * 0 for _ in range(24)] + [{}] for _ in range(24)], rows=1000, visits=50) != []
    wide = {str(i): {str(k): {} for k in range(40)} for i in range(40)}
    assert normalize.readable(wide) == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "a int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl"), "a int", strict=False).count() == 2
    (tmp_path / "c.csv").write_text('﻿a,b\n1,"x\ny"\n', encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "c.csv"), "a int, b string").collect()] == [(1, "x\ny")]
    assert readers.soft_value("{'a': 1}") == {"a": 1} and readers.soft_value("plain") == "plain"


def test_tool_contract():
    call = lambda a: {"choices": [{"finish_reason": "tool_calls", "message": {"tool_calls": [{"function": {"name": "select", "arguments": a}}]}}]}
    assert tool_arguments(call('{"positions": [2, 1]}'), "select") == {"positions": [2, 1]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[1]", "{"):
        with pytest.raises(ContractError):
            tool_arguments(call(bad), "select")
    assert positions([2, 1], 2) == [2, 1]
    for bad in ([0], [1, 1], [True], [3], "x"):
        with pytest.raises(ContractError):
            positions(bad, 2)


def test_tool_schema():
    call = lambda a, **kw: {"choices": [{"finish_reason": "stop", "message": {"tool_calls": [{"function": {"name": "f", "arguments": a}} | kw]}}]}
    schema = {"type": "object", "required": ["positions"], "additionalProperties": False, "properties": {"positions": {"type": "array", "maxItems": 2, "uniqueItems": True, "items": {"type": "integer", "minimum": 1}}}}
    assert tool_arguments(call('{"positions": [2, 1]}', id="c1", type="function"), "f", schema) == {"positions": [2, 1]}
    for bad in ("{}", '{"positions": [0]}', '{"positions": [1, 1]}', '{"positions": [1, 2, 3]}', '{"positions": [true]}', '{"positions": [1], "x": 2}', '{"positions": "1"}'):
        with pytest.raises(ContractError):
            tool_arguments(call(bad), "f", schema)
    for bad in ({"type": "other"}, {"id": ""}, {"id": 3}):
        with pytest.raises(ContractError):
            tool_arguments(call('{"positions": [1]}', **bad), "f", schema)
