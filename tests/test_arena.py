import pytest
from pyspark.sql import functions as F

from lodestone.operators import arena, menu, select

SPAN = (
    "run_id string, trace_id string, span_id string, parent_span_id string, record_id string, request_id string, task_id string, name string, "
    "dataset_pack_sha256 string, operation string, status string, attempt int, replay string, duration_ms double, started_at timestamp, ended_at timestamp, "
    "inputs array<struct<id:string,kind:string,artifact:string,sha256:string,locator:string>>, outputs array<struct<id:string,kind:string,artifact:string,sha256:string,locator:string>>, "
    "links array<struct<from_id:string,to_id:string,relation:string>>, candidates array<struct<ref_id:string,rank:int,score:double,selected:boolean>>, "
    "model struct<provider:string,name:string,input_tokens:long,output_tokens:long,cached_tokens:long,cost_usd:double,usage_source:string>, error struct<code:string,retryable:boolean>"
)


def test_span_rules(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    ref = ("a", "source", "x/y.json", "0" * 64, "l")
    good = dict(zip([c.split()[0] for c in ("run_id s,trace_id s,span_id s,parent_span_id s,record_id s,request_id s,task_id s,name s,dataset_pack_sha256 s,operation s,status s,attempt i,replay s,duration_ms d,started_at t,ended_at t,inputs a,outputs a,links a,candidates a,model m,error e").split(",")], ["r", "t", "s0", None, "rec", "q", None, "n", "a" * 64, "search", "ok", 1, "none", 1.0, t, t, [ref], [], [("a", "a", "supports")], [("a", 1, None, True)], None, None]))
    bad = {
        "s1": {"name": " "},
        "s2": {"operation": "dance"},
        "s3": {"inputs": [("a", "source", "../up", "0" * 64, "l")]},
        "s4": {"candidates": [("a", 1, None, True), ("a", 1, 0.5, False)]},
        "s5": {"status": "error"},
        "s6": {"links": [("a", "zz", "supports")]},
    }
    rows = [good] + [good | {"span_id": k} | v for k, v in bad.items()]
    got = {(r["span_id"], r["reason"]) for r in arena.check_spans(spark.createDataFrame([tuple(r.values()) for r in rows], SPAN)).collect()}
    assert got == {("s1", "blank_field"), ("s2", "operation"), ("s3", "reference"), ("s4", "repeated_rank"), ("s5", "error"), ("s6", "link")}


def test_search_rules(spark):
    schema = "case_id string, search_id string, query string, user_id string, top_k int, expect_empty boolean, grading string, expected array<struct<ids:array<string>,contains_any:array<string>>>"
    rows = [("c", "1", "q", "u", 5, False, None, [(["a"], [])]), ("c", "2", "q", "u", 0, False, "ungraded", []), ("c", "3", "q", "u", 5, True, "evidence", [(["a"], [])]), ("c", "4", "q", "u", 5, False, None, [([], [])]), ("c", "5", "q", "u", 5, True, None, [])]
    got = {(r["search_id"], r["reason"]) for r in arena.check_searches(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("2", "top_k"), ("3", "grading"), ("4", "target")}


def test_cycles_and_notes(spark):
    s = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("o", "gone")], "span_id string, parent_span_id string")
    assert {r["span_id"] for r in arena.span_cycles(s).collect()} == {"x", "y", "z"}
    n = spark.createDataFrame([(1, None), (2, 1), (3, None)], "note_id int, supersedes int")
    assert {r["note_id"] for r in arena.current_notes(n).collect()} == {2, 3}


def pack(spark):
    turns = spark.createDataFrame([("r", "s", i, f"t{i}", 100 * i if i != 3 else None, 50) for i in range(6)], "record_id string, session_id string, position int, turn_id string, timestamp long, session_timestamp long")
    tasks = spark.createDataFrame([("r", "k1", ["t1"]), ("r", "k2", ["t5"])], "record_id string, task_id string, evidence array<string>")
    return turns, tasks


def test_select_pack(spark):
    turns, tasks = pack(spark)
    out = select.select_pack(turns, tasks, anchors=["t1"], radius=1, allow_partial=True)
    assert [r["turn_id"] for r in out["turns"].orderBy("position").collect()] == ["t0", "t1", "t2"]
    assert {r["task_id"]: r["graded"] for r in out["tasks"].collect()} == {"k1": True, "k2": False}
    assert {(r["what"], r["base"], r["kept"]) for r in out["counts"].collect()} == {("turns", 6, 3), ("tasks", 2, 2)}
    cut = select.select_pack(turns, tasks, before_ms=300, allow_partial=True)
    assert [r["turn_id"] for r in cut["turns"].orderBy("position").collect()] == ["t0", "t1", "t2", "t3"]
    with pytest.raises(Exception, match="leaves out evidence"):
        select.select_pack(turns, tasks, anchors=["t1"])["tasks"].collect()


def test_menus(spark):
    u = spark.createDataFrame([(1, 0, 1, "a", 0, 60), (1, 1, 1, "b", 0, 60), (1, 1, 2, "c", 0, 30), (1, 1, 3, "a", 0, 60)], "query_id long, source int, rn int, ref string, start long, cost long")
    got = {r["ref"]: (r["position"], r["omitted"]) for r in menu.menu(u, 100).collect()}
    assert got == {"a": (1, False), "b": (None, True), "c": (2, False)}
    c = spark.createDataFrame([(1, i, f"r{i}", 40) for i in range(5)], "query_id long, rn long, ref string, cost long")
    assert [r["page"] for r in menu.pages(c, 100).orderBy("rn").collect()] == [0, 0, 1, 1, 2]
    assert menu.reading_cost(24_000, 100) == 2000
    v = spark.createDataFrame([([1, 2], ["q"], [], 2), ([3], [], [], 2), ([1, 1], [], [], 2), ([], ["q"] * 3, [], 2)], "positions array<int>, queries array<string>, read_more array<int>, n int")
    assert sorted(r["reason"] for r in menu.violations(v).collect()) == ["position_out_of_range", "repeated_position", "too_many_queries"]
    e = spark.createDataFrame([(1, i, f"r{i}", "x" * 30) for i in range(5)], "query_id long, rn long, ref string, preview string")
    assert menu.unread_directory(e, most=9, chars=100).count() == 3
