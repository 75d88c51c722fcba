"""Selection, sampling and splitting of packs, tasks and turns; all orders are hashes or keys, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), value.cast("string")), 256)


def window_turns(turns: DataFrame, anchor: Column, *keys: str, order: str, radius: int) -> DataFrame:
    """Turns within radius positions of an anchor in the same session."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    return turns.withColumn("_near", F.max(anchor.cast("int")).over(w)).where("_near = 1").drop("_near")


def before(turns: DataFrame, cutoff: Column, time: Column) -> DataFrame:
    """Turns strictly before the cutoff; one without any time is an error."""
    known = F.coalesce(time, F.raise_error(F.lit("an undated turn cannot be cut off")).cast("long"))
    return turns.where(known < cutoff)


def holdout(rows: DataFrame, group: Column, fraction: float, seed: str) -> DataFrame:
    """rows with ``held_out``: whole groups, in hash order; between 1 and n - 1 of n groups."""
    groups = rows.select(group.alias("_g")).distinct().withColumn("_h", hash_order(seed, F.col("_g")))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    rn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_h"))
    take = F.greatest(F.lit(1), F.least(n - 1, F.round(n * fraction).cast("int")))
    picked = groups.select("_g", (rn <= take).alias("held_out"))
    return rows.withColumn("_g", group).join(picked, "_g").drop("_g")


def round_robin(rows: DataFrame, category: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows dealt from the categories in turn, hash-ordered within each, categories by name."""
    rn = F.row_number().over(Window.partitionBy(category).orderBy(hash_order(seed, F.col(key)), key))
    dealt = rows.withColumn("_rn", rn).where(F.col("_rn") <= n)
    return dealt.orderBy("_rn", category).limit(n).drop("_rn")


def first_n(rows: DataFrame, category: str, n: int, *order: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def as_of_counts(queries: DataFrame, events: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """queries with visible and excluded: the key's events strictly before the query's time, and the rest.

    One union sorted by time instead of an inequality join: an event counts for every later query of its key.
    """
    both = events.select(key, time, F.lit(None).cast("long").alias(order), F.lit(1).alias("e")).unionByName(queries.select(key, time, order, F.lit(0).alias("e")))
    so_far = Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(key, time)
    every = Window.partitionBy(key)
    out = both.withColumn("visible", F.sum("e").over(so_far) - F.sum("e").over(same)).withColumn("excluded", F.sum("e").over(every) - F.col("visible"))
    return out.where("e = 0").select(order, "visible", "excluded")


def select_pack(turns: DataFrame, tasks: DataFrame, *, records: list[str] | None = None, task_ids: list[str] | None = None, anchors: list[str] | None = None, radius: int | None = None, before_ms: int | None = None, allow_partial: bool = False) -> dict[str, DataFrame]:
    """A cut of a pack: its turns and tasks, what evidence it lost, and counts before and after.

    turns: record_id, session_id, position, turn_id, timestamp, session_timestamp; tasks: record_id, task_id, evidence.
    Without anchors all history of the chosen records stays; with anchors those turns, or all within ``radius``
    positions of one in its session. A cutoff is exclusive and fails on undated turns. Tasks that lost evidence are
    no longer graded; unless partial cuts are allowed, one is an error.
    """
    base_turns, base_tasks = turns, tasks
    if records is not None:
        turns, tasks = turns.where(F.col("record_id").isin(records)), tasks.where(F.col("record_id").isin(records))
    if task_ids is not None:
        tasks = tasks.where(F.col("task_id").isin(task_ids))
    if anchors is not None:
        turns = window_turns(turns, F.col("turn_id").isin(anchors), "record_id", "session_id", order="position", radius=radius or 0)
    if before_ms is not None:
        turns = before(turns, F.lit(before_ms), F.coalesce("timestamp", "session_timestamp"))
    held = turns.select("record_id", F.col("turn_id").alias("e")).distinct().withColumn("_kept", F.lit(True))
    flat = tasks.select("record_id", "task_id", F.explode("evidence").alias("e")).join(held, ["record_id", "e"], "left")
    missing = flat.where("_kept is null").groupBy("record_id", "task_id").agg(F.array_sort(F.collect_set("e")).alias("missing"))
    if not allow_partial:
        missing = missing.withColumn("missing", F.when(F.size("missing") > 0, F.raise_error(F.concat(F.lit("the cut leaves out evidence of "), F.col("task_id"))).cast("array<string>")))
    graded = tasks.join(missing, ["record_id", "task_id"], "left").withColumn("graded", F.col("missing").isNull())
    counts = None
    for name, before_df, after_df in (("turns", base_turns, turns), ("tasks", base_tasks, tasks)):
        row = before_df.agg(F.count("*").alias("base")).crossJoin(after_df.agg(F.count("*").alias("kept"))).select(F.lit(name).alias("what"), "base", "kept")
        counts = row if counts is None else counts.unionByName(row)
    return {"turns": turns, "tasks": graded, "missing": missing, "counts": counts}
