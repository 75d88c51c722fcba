"""Audits, gates, attachments and projections on hand-made rows."""

import hashlib
import json

from pyspark.sql import functions as F

from lodestone.operators import records as X


def test_supplemental_drops_the_question_and_repeats(spark):
    df = spark.createDataFrame([([" Who? ", "b", "WHO?", "b", "a"], "who?")], "l array<string>, q string")
    assert df.select(X.supplemental(F.col("l"), F.col("q"))).first()[0] == ["b", "a"]


def test_fragments_keep_identity_and_shrink(spark):
    df = spark.createDataFrame([('a"1', "0123456789", -3, 50)], "ref string, text string, start int, end int")
    whole, cut = X.fragments(df).first(), X.fragments(df, limit=4).first()
    digest = lambda end: hashlib.sha256(json.dumps(['a"1', hashlib.sha256(b"0123456789").hexdigest(), 0, end], separators=(",", ":")).encode()).hexdigest()
    assert (whole.piece, whole.complete, whole.fragment_id) == ("0123456789", True, digest(10))
    assert (cut.piece, cut.complete, cut.fragment_id) == ("0123", False, digest(4))


def test_episode_label(spark):
    rows = [(1, 2, None, "Speaker: Bob\nHi kayak"), (1, 1, "2024-05-06", "Speaker: Ann\nHey rivers rivers"), (1, 3, None, "Speaker: Cyd\nkayak paddles boats lakes"), (2, 1, None, "")]
    df = spark.createDataFrame(rows, "k int, o int, day string, text string").withColumn("day", F.col("day").cast("date"))
    got = {r.k: r.label for r in X.episode_labels(df, "k", "o").collect()}
    assert got == {1: "2024-05-06-Ann-Bob-rivers-kayak-paddles-boats", 2: ""}


def test_embedding_audit_and_replace(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "ref int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (4, [0.0, 1.0])], "ref int, vector array<double>")
    assert {tuple(r) for r in X.embedding_audit(items, v, 2).collect()} == {(2, "dimensions"), (3, "missing"), (4, "orphan")}
    fresh = spark.createDataFrame([(2, [0.0, 1.0]), (2, [1.0, 1.0])], v.schema)
    assert sorted(r.ref for r in X.replace_embeddings(v, fresh).collect()) == [1, 2, 2, 4]


def test_attach_verdicts(spark):
    q = spark.createDataFrame([(1, "p", 2)], "task int, pack string, n_results int")
    o = spark.createDataFrame([(1, 1, "p", [2]), (2, 1, "p", [1]), (3, 9, "p", [1])], "at int, task int, pack_sha string, ranks array<int>")
    assert [r.verdict for r in X.attach(o, q, ["task"], "at").orderBy("at").collect()] == ["attached", "duplicate", "unknown"]
    one = spark.createDataFrame([(1, 1, "p", [3]), (2, 1, "x", [1])], o.schema)
    assert X.attach(one.where("at = 1"), q, ["task"], "at").first().verdict == "invalid ranks"
    assert X.attach(one.where("at = 2"), q, ["task"], "at").first().verdict == "pack mismatch"


def test_request_states_and_admission(spark):
    log = [("u", "a", 1, "raw"), ("u", "a", 2, "planned"), ("u", "a", 3, "planned"), ("u", "a", 4, "done"), ("v", "b", 1, "raw"), ("v", "c", 1, "raw"), ("v", "c", 2, "done")]
    s = X.request_states(spark.createDataFrame(log, "user_id string, request_id string, at int, stage string"))
    assert {(r.request_id, r.stage, r.legal) for r in s.collect()} == {("a", "done", True), ("b", "raw", True), ("c", "done", False)}
    assert {tuple(r) for r in X.admission(s).collect()} == {("u", 0, True), ("v", 1, False)}


def test_missing_material_needs_the_present_version_whole(spark):
    bodies = spark.createDataFrame([("a", "1", 10), ("b", "1", 10), ("c", "2", 10)], "ref string, version string, length int")
    ranges = [("a", "1", 0, 6), ("a", "1", 5, 10), ("b", "1", 0, 9), ("c", "1", 0, 10)]
    seen = spark.createDataFrame(ranges, "ref string, version string, start int, end int")
    targets = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ref string")
    assert sorted(r.ref for r in X.missing_material(targets, bodies, seen, seen).collect()) == ["b", "c", "d"]


def test_fact_hint_order(spark):
    hint = "struct<expression:string,start:date,end:date,precision:string>"
    h, g = ("Yesterday", None, None, "day"), ("tomorrow", None, None, "day")
    rows = [(1, [g, h], "yesterday", None), (2, [g], "soon", None), (3, [g, g], None, None), (4, [g, h], None, "2024-02-29"), (5, [], None, None)]
    df = spark.createDataFrame(rows, f"id int, hints array<{hint}>, requested string, event_day string").withColumn("event_day", F.col("event_day").cast("date"))
    got = {r.id: r.hint and (r.hint.expression, r.hint.precision) for r in X.fact_hints(df).collect()}
    assert got == {1: ("Yesterday", "day"), 2: ("soon", "expression"), 3: ("tomorrow", "day"), 4: ("2024-02-29", "day"), 5: None}
