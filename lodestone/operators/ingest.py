"""Ingest and state: idempotent requests, sequences, triggers, barriers, cascades, merges, watermarks.

State tables are versioned DataFrames: a step reads one version and returns the next. Greedy batch closing carries
state along a user's queue and runs in applyInPandas per user; everything else is windows, joins and aggregates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T


def accept(requests: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fresh, replayed, conflicts) of requests (user_id, request_id, digest, ...) against known receipts: same key and
    digest is a replay, another digest a conflict. Within a batch the first digest of a key wins."""
    w = Window.partitionBy("user_id", "request_id").orderBy("arrival", "digest")
    first = requests.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("digest").over(w))
    old = known.select("user_id", "request_id", F.col("digest").alias("_known"))
    both = first.join(old, ["user_id", "request_id"], "left").withColumn("_held", F.coalesce("_known", "_first"))
    fresh = both.where("_known is null and _n = 1").select(*requests.columns)
    replayed = both.where("digest = _held and (_known is not null or _n > 1)").select(*requests.columns)
    return fresh, replayed, both.where("digest <> _held").select(*requests.columns)


def triggers(pending: DataFrame, *keys: str, items: int = fixed.BATCH_ITEMS, chars: int = fixed.BATCH_CHARS, requests: int = fixed.MIN_REQUESTS) -> DataFrame:
    """(keys, n_items, n_chars, n_requests, triggered): a foreign session is pending, or enough items or characters of
    enough distinct requests. pending: keys, text, request_id, foreign."""
    agg = pending.groupBy(*keys).agg(F.count("*").alias("n_items"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.countDistinct("request_id").alias("n_requests"), F.bool_or("foreign").alias("_foreign"))
    enough = ((F.col("n_items") >= items) | (F.col("n_chars") >= chars)) & (F.col("n_requests") >= requests)
    return agg.withColumn("triggered", F.col("_foreign") | enough).drop("_foreign")


def close_batches(pending: DataFrame, items: int = fixed.BATCH_ITEMS, chars: int = fixed.BATCH_CHARS, most: int = 2) -> DataFrame:
    """(user_id, sequence, batch): a user's queue in order, cut greedily at either limit; the first ``most`` batches."""

    def close(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        batch, n, size, out = 0, 0, 0, []
        for sequence, length in rows.sort_values("sequence")[["sequence", "length"]].itertuples(index=False):
            if n and (n >= items or size + length > chars):
                batch, n, size = batch + 1, 0, 0
            if batch >= most:
                break
            out.append((key[0], sequence, batch))
            n, size = n + 1, size + length
        return pd.DataFrame(out, columns=["user_id", "sequence", "batch"])

    q = pending.select("user_id", "sequence", F.length("text").alias("length"))
    return q.groupBy("user_id").applyInPandas(close, "user_id string, sequence long, batch int")


def recover(batches: DataFrame) -> DataFrame:
    """Running batches of an earlier process are interrupted."""
    return batches.withColumn("state", F.when(F.col("state") == "running", "interrupted").otherwise(F.col("state")))


def forget_barrier(sources: DataFrame, command: Column, *keys: str, order: str = "sequence") -> DataFrame:
    """sources with ``state``: rows before the key's last command are blocked, commands are instructions."""
    last = F.max(F.when(command, F.col(order))).over(Window.partitionBy(*keys))
    state = F.when(command, "instruction").when(F.col(order) < last, "blocked").otherwise("active")
    return sources.withColumn("state", state)


def confirmation_window(sources: DataFrame, command: Column, *keys: str, order: str = "sequence") -> DataFrame:
    """Assistant rows after an instruction and before the next ordinary user row, with the instruction's order value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(command, F.col(order)).when(F.col("role") == "user", F.lit(-1))
    held = F.last(mark, ignorenulls=True).over(w)
    return sources.withColumn("instruction", held).where((F.col("instruction") >= 0) & (F.col("role") == "assistant"))


def cascade_block(items: DataFrame, blocked: DataFrame) -> DataFrame:
    """items (item_id, sources) with ``blocked``: whether any source is blocked."""
    hit = items.select("item_id", F.explode("sources").alias("source")).join(blocked.select("source"), "source", "left_semi").select("item_id").distinct()
    return items.join(hit.withColumn("_hit", F.lit(True)), "item_id", "left").withColumn("blocked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def working_view(events: DataFrame, *keys: str, order: list[Column], rows: int = fixed.VIEW_ROWS, chars: int = fixed.VIEW_CHARS) -> DataFrame:
    """The newest events per key while rows and characters last; the newest is always kept. order: newest first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    v = events.withColumn("_rn", F.row_number().over(w)).withColumn("running_chars", running.cast("long"))
    return v.where((F.col("_rn") <= rows) & ((F.col("running_chars") <= chars) | (F.col("_rn") == 1))).drop("_rn")


def node_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge (id, event_time, confidence, activity, version, sources): new values over old, the larger confidence,
    activity and version one up, sources united in order."""
    n = new.toDF(*[f"n_{c}" for c in new.columns])
    both = old.join(n, old["id"] == n["n_id"], "full_outer")
    fresh, empty = F.col("n_id").isNotNull(), F.array().cast("array<string>")
    update = fresh & F.col("id").isNotNull()
    return both.select(
        F.coalesce("id", "n_id").alias("id"),
        F.coalesce("n_event_time", "event_time").alias("event_time"),
        F.greatest("confidence", "n_confidence").alias("confidence"),
        (F.coalesce("activity", F.lit(0)) + F.when(fresh, 1).otherwise(0)).cast("long").alias("activity"),
        (F.coalesce("version", F.lit(1)) + F.when(update, 1).otherwise(0)).cast("long").alias("version"),
        F.array_distinct(F.concat(F.coalesce("sources", empty), F.coalesce("n_sources", empty))).alias("sources"),
    )


def supersede(versions: DataFrame, *keys: str, order: list[str], at: str) -> DataFrame:
    """versions with status and valid_to: each is superseded by its key's next, at that one's time."""
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(*order))
    return versions.withColumn("valid_to", following).withColumn("status", F.when(following.isNull(), "active").otherwise("superseded"))


def purge_before(events: DataFrame, derived: DataFrame, cutoff: Column) -> DataFrame:
    """(kind, id) of events ingested before the cutoff and of derived rows that cite one of them."""
    old = events.where(F.col("ingested") < cutoff).select(F.col("id"))
    cited = derived.select("id", F.explode("sources").alias("source")).join(old.withColumnRenamed("id", "source"), "source", "left_semi").select("id").distinct()
    return old.select(F.lit("event").alias("kind"), "id").unionByName(cited.select(F.lit("derived").alias("kind"), "id"))


def advance_watermark(plans: DataFrame, *keys: str, order: str, done: Column) -> DataFrame:
    """(keys, settled_through): the last plan before the first incomplete one, 0 if that is the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = plans.withColumn("_ok", F.min(done.cast("int")).over(w))
    return held.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_ok") == 1, F.col(order))), F.lit(0)).alias("settled_through"))


def pending_after(rows: DataFrame, cursors: DataFrame, *keys: str, order: str = "sequence") -> DataFrame:
    """Rows beyond their key's cursor (0 where it has none)."""
    return rows.join(cursors, [*keys], "left").where(F.col(order) > F.coalesce("processed_through", F.lit(0))).drop("processed_through")


def plan_prefix(pending: DataFrame, *keys: str, items: int, chars: int, requests: int) -> DataFrame:
    """(keys, target, reasons): how far a user's queue is planned: to the last session change, or to its end when
    enough has gathered, capacity is reached or a user states a change.

    pending: keys, sequence, session_id, request_id, role, text."""
    w = Window.partitionBy(*keys).orderBy("sequence")
    p = pending.withColumn("_next", F.lead("session_id").over(w))
    size = F.sum(F.length("text"))
    agg = p.groupBy(*keys).agg(
        F.max(F.when(F.col("_next") != F.col("session_id"), F.col("sequence"))).alias("_session"),
        F.max("sequence").alias("_end"),
        ((F.countDistinct("request_id") >= requests) & ((F.count("*") >= items) | (size >= chars))).alias("_acc"),
        ((F.count("*") >= 2 * items) | (size >= 2 * chars)).alias("_cap"),
        F.bool_or((F.col("role") == "user") & T.matches(F.col("text"), fixed.EXPLICIT_CHANGE)).alias("_said"),
    )
    whole = F.col("_acc") | F.col("_cap") | F.col("_said")
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in ((F.col("_session").isNotNull(), "session_prefix"), (F.col("_acc"), "accumulation"), (F.col("_cap"), "capacity"), (F.col("_said"), "explicit_change"))]))
    return agg.select(*keys, F.when(whole, F.col("_end")).otherwise(F.coalesce("_session", F.lit(0))).alias("target"), F.array_join(reasons, ",").alias("reasons"))


def retained(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """(id, kept, rebuilt) of rows (id, sources): rows that cite a blocked source are rebuilt from the rest in order;
    rows without any source left vanish."""
    flat = rows.select("id", F.posexplode("sources").alias("p", "source"))
    left = flat.join(blocked.select("source").withColumn("_b", F.lit(True)), "source", "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("_b").isNull(), F.struct("p", "source")))), lambda x: x["source"])
    return left.groupBy("id").agg(kept.alias("kept"), F.max(F.coalesce("_b", F.lit(False))).alias("rebuilt")).where(F.size("kept") > 0)


def patch(rows: DataFrame, removed: DataFrame, upserts: DataFrame, key: str) -> DataFrame:
    """rows without the removed keys, with upserts in place of their keys' rows or behind them."""
    kept = rows.join(removed.select(key), key, "left_anti").join(upserts.select(key), key, "left_anti")
    return kept.unionByName(upserts)


def last_write(rows: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """The newest row of each key (order: newest first)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")
