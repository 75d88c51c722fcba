import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dictionary as D
from lodestone.operators import evaluate
from lodestone.operators import replay as R
from lodestone.operators import usage as U


def log_rows():
    rng = random.Random(1)
    words = ["Miso", "tuna", "Oslo", "violin", "garden", "Tuesday", "maple", "quota"]
    rows, expected, search = [], [], 0
    for case in range(3):
        at = 0
        for part in range(2):
            for k in range(2):
                name = f"{rng.choice(words)} {case} {part} {k}"
                message = {"role": "user", "content": f"My note {part} {k} is about {name}.", "timestamp": at}
                rows.append((f"c{case}", at, "add", f"u{case}", "s", f"r{part}{k}", [message], None, None, None))
                at += 1
            rows.append((f"c{case}", at, "search", f"u{case}", None, None, None, search, f"what is the note about {name}", 5))
            expected.append((search, 0, [], [name]))
            search, at = search + 1, at + 1
    return rows, expected


def frame(spark, rows):
    keys = [c.split()[0] for c in R.LOG.split("messages")[0].split(", ")[:-1]] + ["messages", "search_id", "query", "top_k"]
    return spark.createDataFrame([(json.dumps(dict(zip(keys, r))),) for r in rows], "j string").select(F.from_json("j", R.LOG).alias("r")).select("r.*")


def grades(spark, replay, expected):
    answers = replay.answers().select("search_id", "rank", "id", "content")
    wanted = spark.createDataFrame(expected, "search_id long, target_index int, ids array<string>, contains_any array<string>")
    return sorted(map(tuple, evaluate.evidence_ranks(answers, wanted, "search_id").collect()))


def test_rounds_follow_each_case(spark):
    rows, _ = log_rows()
    got = {(r["case_id"], r["position"]): r["round"] for r in R.in_rounds(frame(spark, rows)).collect()}
    assert [got["c0", p] for p in range(6)] == [0, 0, 1, 2, 2, 3]
    only = [r for r in rows if r[2] == "search"]
    assert {r["round"] for r in R.in_rounds(frame(spark, only)).collect()} == {1}


@pytest.mark.parametrize("when", ["add", "search"])
def test_a_restart_in_the_middle_grades_the_same(spark, tmp_path, monkeypatch, when):
    rows, expected = log_rows()
    log = frame(spark, rows)
    straight = R.Replay(spark, str(tmp_path / "a"), "one")
    straight.play(log)
    want = grades(spark, straight, expected)
    assert [g[2] for g in want] and all(g[2] for g in want)
    broken = R.Replay(spark, str(tmp_path / "b"), "one")
    calls = {"add": 0, "search": 0}
    with monkeypatch.context() as m:
        for kind in calls:
            whole = getattr(broken.engine, kind)

            def lost(df, kind=kind, whole=whole):
                calls[kind] += 1
                out = whole(df)
                if kind == when and calls[kind] == 2:
                    raise OSError("lost after the work, before the answer")
                return out

            m.setattr(broken.engine, kind, lost)
        with pytest.raises(OSError):
            broken.play(log)
    again = R.Replay(spark, str(tmp_path / "b"), "one")
    again.play(log)
    assert grades(spark, again, expected) == want
    assert {r["status"] for r in again.outcomes().collect()} <= {"accepted", "replayed"} and again.outcomes().count() == 12
    passages = lambda r: sorted((x["user_id"], x["text"]) for x in r.engine.tables.read("passages", "user_id string, text string, sequence bigint, status string, vector array<float>").collect())
    assert passages(again) == passages(straight)


def test_a_stream_carries_state_between_batches(spark, tmp_path):
    rows, expected = log_rows()
    whole = frame(spark, rows)
    straight = R.Replay(spark, str(tmp_path / "a"), "one")
    straight.play(whole)
    (tmp_path / "in").mkdir()
    for part in range(2):
        whole.where(F.col("position").between(3 * part, 3 * part + 2)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    streamed = R.Replay(spark, str(tmp_path / "b"), "one")
    for part in range(2):
        stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in" / f"p[0-{part}]"))
        streamed.play_stream(stream, str(tmp_path / "cp")).awaitTermination()
    assert grades(spark, streamed, expected) == grades(spark, straight, expected)
    assert streamed.outcomes().where("user_id not like 'arena:one:%'").count() == 0


def test_dictionary_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["click", "view", None, "é"]), rng.choice([None, [], ["a"], ["b", "a", None, "b"]]), rng.choice([1, 22, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, kind string, refs array<string>, n int").repartition(5)
    known, coded = D.encode(df, ["kind", "refs", "n"], "id")
    assert sorted((r["name"], r["code"], r["value"]) for r in known.collect()) == [(c, i, v) for c, vs in (("kind", ["click", "view", "é"]), ("n", ["1", "22", "3"]), ("refs", ["a", "b"])) for i, v in enumerate(vs)]
    assert coded.columns == df.columns and {f.dataType.simpleString() for f in coded.schema} == {"bigint", "array<bigint>"}
    back = D.decode(known, coded, {"kind": "string", "refs": "string", "n": "int"}, "id")
    key = lambda r: r["id"]
    assert [tuple(r) for r in sorted(back.collect(), key=key)] == rows
    assert back.schema.simpleString() == df.schema.simpleString()


def test_spans_stand_once(spark, tmp_path):
    ref = lambda i: (f"ref{i}", "source", "x" * 200)
    spans = [(q, p, f"s{(q + p) % 20}", f"op{(q + p) % 20 % 3}", [ref(k) for k in range((q + p) % 20 % 4)], [ref((q + p) % 20)]) for q in range(40) for p in range(6)]
    df = spark.createDataFrame(spans, "query_id long, place int, span_id string, operation string, inputs array<struct<id:string,kind:string,body:string>>, outputs array<struct<id:string,kind:string,body:string>>")
    queries, events, held = D.compact_spans(df, ["inputs", "outputs"])
    assert (queries.count(), events.count(), held.count()) == (40, 20, 20)
    back = D.expand_spans(queries, events, held, ["inputs", "outputs"]).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    size = lambda d, n: (d.coalesce(1).write.option("compression", "none").json(str(tmp_path / n)), sum(f.stat().st_size for f in (tmp_path / n).glob("part-*")))[1]
    assert size(queries, "q") + size(events, "e") + size(held, "h") < size(df, "whole") / 5


def test_usage_is_observed_in_the_same_pass(spark):
    rng = random.Random(3)
    calls = [(rng.randrange(4), i, rng.randrange(1, 1200), rng.choice([None, None, "provider_timeout", "embedding_input_budget", "odd_code"]), rng.choice([None, 3, 5]), 2, None) for i in range(300)]
    df = spark.createDataFrame(calls, "run int, at int, chars long, error string, input_tokens long, output_tokens long, cached_tokens long")
    marked = U.within_budget(df, U.Budget(calls=50, chars=20_000, chars_of_a_call=1000), "run", order="at")
    want, used = {}, {}
    for run, at, chars, *_ in calls:
        n, c = used.get(run, (0, 0))
        if chars > 1000:
            want[at] = "model_input_budget"
            continue
        used[run] = (n + 1, c + chars)
        want[at] = "provider_run_budget" if n + 1 > 50 or c + chars > 20_000 else None
    assert {r["at"]: r["refused"] for r in marked.collect()} == want
    rows, seen = U.observed(marked)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("watched", "one pass")
    got = rows.collect()
    jobs = len(tracker.getJobIdsForGroup("watched"))
    numbers = seen.get
    assert len(tracker.getJobIdsForGroup("watched")) == jobs
    spark.sparkContext.setJobGroup("plain", "no metrics")
    U.within_budget(df, U.Budget(calls=50, chars=20_000, chars_of_a_call=1000), "run", order="at").collect()
    assert len(tracker.getJobIdsForGroup("plain")) == jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    made = [r for r in got if r["refused"] is None]
    failures = [U.ERRORS.get(r["refused"] or r["error"], 503) for r in got if r["refused"] or r["error"]]
    assert numbers == {
        "calls": len(made),
        "input_chars": sum(r["chars"] for r in made),
        "responses": sum(r["error"] is None for r in made),
        "input_tokens": sum(r["input_tokens"] or 0 for r in made),
        "output_tokens": 2 * len(made),
        "cached_tokens": None,
        "unknown_usage": sum(r["input_tokens"] is None for r in made),
        "retryable_failures": sum(s in U.RETRYABLE for s in failures),
        "final_failures": sum(s not in U.RETRYABLE for s in failures),
    }
    table = {r["code"]: r["retryable"] for r in U.error_table(spark).collect()}
    assert table["provider_timeout"] and not table["embedding_input_budget"]
