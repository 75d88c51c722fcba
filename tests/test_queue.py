"""The work queue as a stream: a lost worker, a late result, backoff, the end of attempts."""

import datetime as dt
import itertools
import random

import pytest

from lodestone.streaming import queue as Q

POLICY = Q.Policy(lease=60_000, backoff=30_000, attempts=3)
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


EVENTS = [
    # a: worker w1 is lost; w2 takes over; w1's result comes late.
    [("a", 0, "submit", None, None), ("a", 0, "submit", None, None), ("a", 5, "claim", "w1", None), ("b", 3, "submit", None, None), ("b", 6, "claim", "w1", None)],
    [("b", 20, "heartbeat", "w1", 1), ("b", 70, "done", "w1", 1), ("a", 80, "claim", "w2", None)],
    [("a", 100, "claim", "w2", None), ("a", 110, "done", "w1", 1), ("a", 120, "done", "w2", 2), ("c", 90, "submit", None, None), ("c", 95, "claim", "w3", None), ("c", 97, "fail", "w3", 1)],
    [("c", 130, "claim", "w3", None), ("d", 131, "done", "w9", 1)],
    [("z", 2000, "submit", None, None)],
    [("z", 4000, "claim", "w1", None)],
]
# c fails at 97, waits 30 s, is claimed at 130, lost at 190, waits 60 s, and is ready at 250.
WANT = {
    "a": [(0, "queued"), (5, "claimed"), (65, "lost"), (80, "refused"), (95, "ready"), (100, "claimed"), (110, "stale"), (120, "done")],
    "b": [(3, "queued"), (6, "claimed"), (70, "done")],
    "c": [(90, "queued"), (95, "claimed"), (97, "failed"), (127, "ready"), (130, "claimed"), (190, "lost"), (250, "ready")],
    "d": [(131, "unknown")],
}


def run(spark, tmp_path, batches):
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame([(j, at(s), k, w, n) for j, s, k, w, n in rows], Q.EVENTS).coalesce(1).write.parquet(str(source / f"b{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", Q.STATE_STORE)
    log, done = str(tmp_path / "log"), str(tmp_path / "cp")
    try:
        # A query for each batch: what was running is found again in the state that the checkpoint names.
        for i in range(len(batches)):
            stream = spark.readStream.schema(Q.EVENTS).parquet(str(source / f"b[0-{i}]"))
            q = Q.run_queue(stream, POLICY, "0 seconds").writeStream.format("parquet").option("path", log).option("checkpointLocation", done).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(Q.LOG).parquet(log)


def test_lost_workers_and_late_results(spark, tmp_path):
    log = run(spark, tmp_path, EVENTS)
    begin = int(START.timestamp() * 1000)
    got = {}
    for r in sorted(log.collect(), key=lambda r: (r["at"], r["attempt"])):
        got.setdefault(r["job_id"], []).append(((r["at"] - begin) // 1000, r["event"]))
    assert {k: v for k, v in got.items() if k != "z"} == WANT
    last = {r["job_id"]: r["event"] for r in Q.open_jobs(log).collect()}
    assert last["a"] == "done" and last["c"] == "ready"


def plain(events, policy):
    """One job's log by looking at every second."""
    log, phase, attempt, until, worker = [], None, 0, None, None
    by_time = {}
    for s, kind, w, n in events:
        by_time.setdefault(s, []).append((kind, w, n))
    for now in range(0, 4000):
        while phase in ("running", "waiting") and until == now:
            if phase == "waiting":
                log.append((now, "ready"))
                phase = "pending"
            else:
                log.append((now, "lost"))
                if attempt == policy.attempts:
                    log.append((now, "dead"))
                    phase = "dead"
                else:
                    phase, until = "waiting", now + policy.backoff // 1000 * 2 ** (attempt - 1)
        for kind, w, n in by_time.get(now, []):
            mine = phase == "running" and n == attempt and w == worker
            if phase is None:
                log.append((now, "queued" if kind == "submit" else "unknown"))
                phase = "pending" if kind == "submit" else None
            elif kind == "claim" and phase == "pending":
                phase, attempt, until, worker = "running", attempt + 1, now + policy.lease // 1000, w
                log.append((now, "claimed"))
            elif kind == "claim":
                log.append((now, "refused"))
            elif kind == "submit":
                pass
            elif not mine:
                log.append((now, "stale"))
            elif kind == "heartbeat":
                until = now + policy.lease // 1000
            elif kind == "done":
                log.append((now, "done"))
                phase = "done"
            else:
                log.append((now, "failed"))
                if attempt == policy.attempts:
                    log.append((now, "dead"))
                    phase = "dead"
                else:
                    phase, until = "waiting", now + policy.backoff // 1000 * 2 ** (attempt - 1)
    return log


@pytest.mark.parametrize("seed", range(40))
def test_states_against_a_clock(seed):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(1, 600), 25))
    events = [(0, "submit", None, None)] + [(s, rng.choice(["claim", "claim", "heartbeat", "done", "fail", "fail", "submit"]), rng.choice(["w1", "w2"]), rng.randrange(1, 4)) for s in times]
    events = events if rng.random() < 0.9 else events[1:]
    job, log = None, []
    for s, kind, w, n in events:
        job, more = Q.step(job, s * 1000, kind, w, n, POLICY)
        log += more
    log += job.due(4_000_000, POLICY) if job else []
    assert [(a // 1000, e) for a, e, *_ in log] == plain(events, POLICY)


def test_waits_double_up_to_the_longest():
    waits = [Q.Policy(backoff=10, longest=100).wait(k) for k in range(1, 8)]
    assert waits == [10, 20, 40, 80, 100, 100, 100] and all(a <= b for a, b in itertools.pairwise(waits))
