"""Structured Streaming forms of ingest: Add requests as micro-batches, per-user state, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone import schemas
from lodestone.engine import MemoryEngine
from lodestone.functions import fixed


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.ADD_REQUEST).json(path)


def run_adds(requests: DataFrame, engine: MemoryEngine, checkpoint: str):
    """Each micro-batch is one Add: the batch function is the commit point, the checkpoint the receipt of progress.
    A batch that is retried after a failure only meets replays."""
    return requests.writeStream.foreachBatch(lambda df, _: engine.add(df).count()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def confirmation_windows(sources: DataFrame) -> DataFrame:
    """Assistant messages between a direct command and the user's next ordinary message, with the command's sequence.

    sources: user_id, sequence, role, command (boolean). State per user: the pending command's sequence or -1.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("sequence")
        out = []
        for sequence, role, command in rows[["sequence", "role", "command"]].itertuples(index=False):
            if command:
                pending = sequence
            elif role == "user":
                pending = -1
            elif pending >= 0:
                out.append((key[0], sequence, pending))
        state.update((int(pending),))
        yield pd.DataFrame(out, columns=["user_id", "sequence", "instruction"])

    return sources.groupBy("user_id").applyInPandasWithState(step, "user_id string, sequence long, instruction long", "pending long", "append", GroupStateTimeout.NoTimeout)


def reflection_triggers(sources: DataFrame, items: int = fixed.BATCH_ITEMS, chars: int = fixed.BATCH_CHARS, requests: int = fixed.MIN_REQUESTS) -> DataFrame:
    """(user_id, through, n_items, n_chars) whenever a user's pending rows reach the trigger; the count starts anew.

    sources: user_id, sequence, request_id, n_chars. State: counts and the distinct requests seen, of which no more
    than ``requests`` need be held."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, size, seen = state.get if state.exists else (0, 0, "")
        known = [x for x in seen.split("\x1f") if x]
        out = []
        for sequence, request, length in pd.concat(list(batches)).sort_values("sequence")[["sequence", "request_id", "n_chars"]].itertuples(index=False):
            n, size = n + 1, size + int(length)
            if request not in known and len(known) < requests:
                known.append(request)
            if (n >= items or size >= chars) and len(known) >= requests:
                out.append((key[0], sequence, n, size))
                n, size, known = 0, 0, []
        state.update((n, size, "\x1f".join(known)))
        yield pd.DataFrame(out, columns=["user_id", "through", "n_items", "n_chars"])

    return sources.groupBy("user_id").applyInPandasWithState(step, "user_id string, through long, n_items long, n_chars long", "n long, size long, seen string", "append", GroupStateTimeout.NoTimeout)


def idempotent(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests once per (user, request) within the watermark; needs an event time column ts."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "request_id"])


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values per type and tumbling window; late rows beyond the watermark are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
