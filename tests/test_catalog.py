import hashlib
import json

import pytest

from lodestone.operators import normalize
from lodestone.sources import catalog as C


def test_catalog_lookup(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"datasets": [{"id": "a", "path": "x/a.json", "format": "json"}, {"id": "twice", "path": "t"}], "assets": [{"id": "b", "path": "../out"}, {"id": "twice", "path": "u"}, {"id": "abs", "path": "/etc/x"}]}, indent=1))
    cat = C.entries(spark, str(tmp_path / "c.json"))
    assert C.find(cat, "a", "/data/raw/")["path"] == "/data/raw/x/a.json" and C.find(cat, "a", "/data")["section"] == "datasets"
    for bad in ("b", "twice", "abs", "none"):
        with pytest.raises(C.CatalogError):
            C.find(cat, bad, "/data/raw")
    assert [tuple(r) for r in C.repeated(cat).collect()] == [("twice", ["assets", "datasets"])]
    (tmp_path / "d.json").write_text('{"assets": []}')
    assert C.entries(spark, str(tmp_path / "d.json")).collect() == []


def test_snapshots_tell_what_changed(spark, tmp_path):
    for name, text in (("a.py", "1"), ("sub/b.py", "2"), ("sub/c.txt", "3")):
        (tmp_path / "one" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "one" / name).write_text(text)
        (tmp_path / "two" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "two" / name).write_text(text)
    snap = lambda n: C.snapshot(spark, str(tmp_path / n))
    want = "\n".join(f"{n}:{hashlib.sha256(t.encode()).hexdigest()}" for n, t in (("a.py", "1"), ("sub/b.py", "2")))
    assert C.digest(snap("one")) == C.digest(snap("two")) == hashlib.sha256(want.encode()).hexdigest()
    before = {r["path"]: r for r in snap("one").collect()}
    assert before.keys() == {"a.py", "sub/b.py"} and before["a.py"]["size"] == 1
    (tmp_path / "two" / "a.py").write_text("changed")
    (tmp_path / "two" / "sub/b.py").unlink()
    (tmp_path / "two" / "n.py").write_text("new")
    assert sorted(map(tuple, C.drift(snap("one"), snap("two")).collect())) == [("a.py", "changed"), ("n.py", "added"), ("sub/b.py", "removed")]
    assert C.drift(snap("one"), snap("one")).collect() == []


def test_gold_selects_and_is_not_seen(spark):
    turns = spark.createDataFrame([(1, "s", i, f"t{i}", 86_400_000 * i, "x") for i in range(6)] + [(1, "z", 0, "other", None, "x"), (2, "s", 0, "no", 0, "x")], "record_id int, session_id string, position int, content string, time long, note string")
    gold = spark.createDataFrame([(1, "s", 3, "secret"), (1, "s", 3, "secret"), (1, "z", 0, "secret")], "record_id int, session_id string, position int, answer string")
    got = lambda **k: sorted((r["session_id"], r["position"], r["content"]) for r in normalize.diagnostic_excerpts(turns, gold, **k).collect())
    assert got() == [("s", 3, "t3"), ("z", 0, "other")]
    assert got(radius=1) == [("s", 2, "t2"), ("s", 3, "t3"), ("s", 4, "t4"), ("z", 0, "other")]
    assert got(dated="time") == [("s", 3, "[Conversation date: 1970-01-04]\nt3"), ("z", 0, "other")]
    assert normalize.diagnostic_excerpts(turns, gold).columns == turns.columns
    with pytest.raises(Exception, match="no such turn"):
        normalize.diagnostic_excerpts(turns, gold.selectExpr("record_id", "session_id", "position + 10 as position")).collect()
