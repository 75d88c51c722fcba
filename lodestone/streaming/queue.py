"""A work queue with leases, backoff and expiry, as state and timers of one streaming query.

A job's state is one small value by its key. What time brings (a lease that runs out, a wait that ends) is applied before
each event up to that event's time, and by an event-time timer where no further event comes; both go through ``due``, so
the log does not depend on how events fall into micro-batches. A worker that is lost sends nothing: its lease runs out and
the job is tried again. What it sends late carries an old attempt and is told apart from the current one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "job_id string, ts timestamp, kind string, worker string, attempt int"
LOG = "job_id string, at long, event string, worker string, attempt int"
STATE = "phase string, attempt int, until long, worker string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Entry = tuple[int, str, str | None, int]  # at, event, worker, attempt


@dataclass(frozen=True)
class Policy:
    """Milliseconds of a lease and of the first wait, which doubles with every further attempt up to ``longest``."""

    lease: int = 60_000
    backoff: int = 30_000
    longest: int = 3_600_000
    attempts: int = 5

    def wait(self, attempt: int) -> int:
        return min(self.longest, self.backoff << min(attempt - 1, 40))


@dataclass
class Job:
    """phase: pending (may be claimed), running, waiting (after a failure), done, dead. ``until`` ends a lease or wait."""

    phase: str
    attempt: int = 0
    until: int = 0
    worker: str | None = None

    def failed(self, at: int, event: str, policy: Policy) -> list[Entry]:
        out: list[Entry] = [(at, event, self.worker, self.attempt)]
        if self.attempt >= policy.attempts:
            self.phase, self.until = "dead", 0
            return [*out, (at, "dead", None, self.attempt)]
        self.phase, self.until, self.worker = "waiting", at + policy.wait(self.attempt), None
        return out

    def due(self, now: int, policy: Policy) -> list[Entry]:
        """What has come to pass up to ``now`` without any event."""
        out: list[Entry] = []
        while self.phase in ("running", "waiting") and self.until <= now:
            if self.phase == "running":
                out += self.failed(self.until, "lost", policy)
            else:
                out.append((self.until, "ready", None, self.attempt))
                self.phase, self.until = "pending", 0
        return out

    def take(self, at: int, kind: str, worker: str | None, attempt: int | None, policy: Policy) -> list[Entry]:
        """What an event does to the job."""
        current = self.phase == "running" and attempt == self.attempt and worker == self.worker
        if kind == "claim":
            if self.phase != "pending":
                return [(at, "refused", worker, self.attempt)]
            self.phase, self.attempt, self.until, self.worker = "running", self.attempt + 1, at + policy.lease, worker
            return [(at, "claimed", worker, self.attempt)]
        if kind in ("heartbeat", "done", "fail") and not current:
            return [(at, "stale", worker, attempt or 0)]
        if kind == "heartbeat":
            self.until = max(self.until, at + policy.lease)
            return []
        if kind == "done":
            self.phase, self.until = "done", 0
            return [(at, "done", worker, self.attempt)]
        if kind == "fail":
            return self.failed(at, "failed", policy)
        return []


def step(job: Job | None, at: int, kind: str, worker: str | None, attempt: int | None, policy: Policy) -> tuple[Job | None, list[Entry]]:
    """A job's next state. A job is put in once; events of a job that was never put in are unknown."""
    if job is None:
        return (Job("pending"), [(at, "queued", None, 0)]) if kind == "submit" else (None, [(at, "unknown", worker, attempt or 0)])
    passed = job.due(at, policy)
    return job, passed + job.take(at, kind, worker, attempt, policy)


class QueueProcessor(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _load(self) -> Job | None:
        if not self.state.exists():
            return None
        phase, attempt, until, worker = self.state.get()
        return Job(phase, int(attempt), int(until), worker)

    def _save(self, job: Job, before: int) -> None:
        self.state.update((job.phase, job.attempt, job.until, job.worker))
        if before and before != job.until:
            self.handle.deleteTimer(before)
        if job.until and before != job.until:
            self.handle.registerTimer(job.until)

    def _rows(self, key: Any, log: list[Entry]) -> Iterator[Row]:
        for at, event, worker, attempt in log:
            yield Row(job_id=key[0], at=at, event=event, worker=worker, attempt=attempt)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        job = self._load()
        before = job.until if job else 0
        out: list[Entry] = []
        # A job's events of one micro-batch, in the order of time; at equal times a job is put in before it is claimed.
        order = {"submit": 0, "claim": 1}
        for r in sorted(rows, key=lambda r: (r["ms"], order.get(r["kind"], 2), r["worker"] or "")):
            job, log = step(job, r["ms"], r["kind"], r["worker"], r["attempt"], self.policy)
            out += log
        if job:
            self._save(job, before)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        job = self._load()
        if job is None:
            return
        # The timer that has fired is gone; a later one is registered anew.
        log = job.due(expiredTimerInfo.getExpiryTimeInMs(), self.policy)
        self.state.update((job.phase, job.attempt, job.until, job.worker))
        if log and job.until:
            self.handle.registerTimer(job.until)
        yield from self._rows(key, log)

    def close(self) -> None:
        pass


def run_queue(events: DataFrame, policy: Policy | None = None, late: str = "10 seconds") -> DataFrame:
    """The log (LOG) of a stream of events (EVENTS): submit, claim, heartbeat, done, fail. Events more than ``late``
    behind are left out. Needs the state store that timers need (STATE_STORE), set on the session."""
    timed = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("job_id").transformWithState(statefulProcessor=QueueProcessor(policy or Policy()), outputStructType=LOG, outputMode="Append", timeMode="EventTime")


def open_jobs(log: DataFrame) -> DataFrame:
    """(job_id, event, at, attempt): the last entry of each job in a log."""
    return log.groupBy("job_id").agg(F.max_by(F.struct("event", "at", "attempt"), F.struct("at", "attempt")).alias("x")).select("job_id", "x.*")
