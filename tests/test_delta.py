"""The engine's log: bytes of a commit, crashes, conflicts, compaction."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.engine import MemoryEngine
from lodestone.sources.delta import ConflictError, DeltaTables, Overlay, Transaction


def request(rid, user, *texts):
    return {"request_id": rid, "user_id": user, "session_id": "s", "messages": [{"role": "user" if i % 2 == 0 else "assistant", "content": t, "timestamp": 1000 * i} for i, t in enumerate(texts)]}


def frame(spark, *rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schemas.ADD_REQUEST).alias("r")).select("r.*")


def size(root, version):
    """Bytes of the data files of one version."""
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files if f"/{version:010d}-" in d and f.endswith(".parquet"))


def texts(engine, **at):
    return {(r["user_id"], r["text"]): r["status"] for r in engine.tables.read("passages", schemas.PASSAGE, **at).collect()}


def test_an_add_writes_what_it_brings(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path))
    engine.add(frame(spark, *[request(f"a{i}", "ann", *[f"A long story number {i} of part {k} with many words in it. " * 20 for k in range(6)]) for i in range(8)]))
    sizes = []
    for i in range(3):
        engine.add(frame(spark, request(f"b{i}", "ann", f"Short note number {i}.", "Fine.")))
        sizes.append(size(tmp_path, i + 2))
    assert size(tmp_path, 1) > 2 * sizes[0]
    assert max(sizes) < 1.05 * min(sizes)
    assert len(texts(engine)) > 40 and texts(engine, version=1).keys() < texts(engine, version=2).keys()


@pytest.mark.parametrize("table", ["passages", "receipts", None])
def test_a_crash_between_files_leaves_the_old_version(spark, tmp_path, monkeypatch, table):
    engine = MemoryEngine(spark, str(tmp_path))
    engine.add(frame(spark, request("r1", "ann", "The first message.")))
    before = texts(engine)
    with monkeypatch.context() as m:
        whole = Transaction.append
        m.setattr(Transaction, "append", lambda self, name, rows: (_ for _ in ()).throw(OSError("lost")) if name == table else whole(self, name, rows))
        if table is None:
            m.setattr(Transaction, "commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            engine.add(frame(spark, request("r2", "ann", "The second message.")))
    assert texts(engine) == before and engine.tables.latest() == 1
    # The request was never accepted, so it is not a replay, and what the crash left is not read.
    assert [r["status"] for r in engine.add(frame(spark, request("r2", "ann", "The second message."))).collect()] == ["accepted"]
    assert len(texts(engine)) == 2
    assert engine.tables.vacuum() >= 1 and len(texts(engine)) == 2


def test_two_writers_of_one_version(spark, tmp_path):
    tables = DeltaTables(spark, str(tmp_path))
    first, second = tables.begin(), tables.begin()
    rows = spark.createDataFrame([("ann", 1)], "user_id string, n int")
    first.append("t", rows)
    second.append("t", rows)
    first.commit()
    with pytest.raises(ConflictError):
        second.commit()
    assert tables.read("t", "user_id string, n int").count() == 1 and not [f for f in os.listdir(tmp_path / "_log") if f.endswith(".tmp")]


def test_commands_change_status_and_compaction_keeps_it(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path))
    engine.add(frame(spark, request("r1", "ann", "Secret code maple.", "ok"), request("r1", "bob", "Secret code oak.")))
    engine.add(frame(spark, request("r2", "ann", "My cat is Miso.", "ok")))
    engine.add(frame(spark, request("r3", "ann", "Forget my secret code.")))
    got = texts(engine)
    assert got["ann", "Secret code maple."] == "blocked" and got["ann", "My cat is Miso."] == "active" and got["bob", "Secret code oak."] == "active"
    assert texts(engine, version=2)["ann", "Secret code maple."] == "active"
    vectors = {r["text"]: r["vector"] for r in engine.tables.read("passages", schemas.PASSAGE).where("user_id = 'ann'").collect()}
    assert vectors["Secret code maple."] is None and vectors["My cat is Miso."] is not None
    engine.compact()
    assert texts(engine) == got and len(engine.tables.folders()["passages"]) == 1
    engine.add(frame(spark, request("r4", "ann", "Forget everything.", "done", "Now I have a dog.")))
    after = texts(engine)
    assert after["ann", "My cat is Miso."] == "blocked" and after["ann", "Now I have a dog."] == "active" and after["bob", "Secret code oak."] == "active"
    assert engine.tables.vacuum() >= 4 and texts(engine) == after
    assert [r["status"] for r in engine.add(frame(spark, request("r2", "ann", "My cat is Miso.", "ok"))).collect()] == ["replayed"]


def test_the_newest_change_holds(spark, tmp_path):
    tables = DeltaTables(spark, str(tmp_path), {"t": Overlay("c", ("user_id",), "state")})
    for n, state in enumerate(["new", "old", "gone"]):
        tx = tables.begin()
        if not n:
            tx.append("t", spark.createDataFrame([("ann", "first"), (None, "first")], "user_id string, state string"))
        tx.append("c", spark.createDataFrame([("ann", state)], "user_id string, state string"))
        tx.commit()
    assert [{r["user_id"]: r["state"] for r in tables.read("t", "user_id string, state string", v).collect()} for v in (1, 2, 3)] == [{"ann": s, None: "first"} for s in ("new", "old", "gone")]
