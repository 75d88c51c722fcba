"""A bounded overview of each user's pending messages: runs of one request, each told in a line, as many as fit."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 80
RESULT = "user_id string, message_count long, through long, group_count long, omitted_groups long, groups array<string>"


def runs(rows: DataFrame, watermark: str = "watermark") -> DataFrame:
    """(user_id, first, last, count, told): consecutive rows of one session and request; ``told`` is the run as canonical JSON:
    session, request, count, the first and last ordinal, roles as they first appear, and a sample of the first and last
    message, which is for planning only beyond the user's watermark.

    rows: user_id, ordinal, session_id, request_id, role, text, watermark.
    """
    w = Window.partitionBy("user_id").orderBy("ordinal")
    key = F.struct("session_id", "request_id")
    new = F.when(F.lag(key).over(w).eqNullSafe(key), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sample = F.struct(F.col("ordinal").alias("ordinal"), (F.col("ordinal") > F.col(watermark)).alias("planning_only"), F.left("text", F.lit(SAMPLE)).alias("text"))
    own = Window.partitionBy("user_id", "_run", "role").orderBy("ordinal")
    marked = marked.withColumn("_first_of_role", F.row_number().over(own) == 1)
    told = marked.groupBy("user_id", "_run").agg(
        F.min("ordinal").alias("first"),
        F.max("ordinal").alias("last"),
        F.count("*").alias("count"),
        F.first("session_id").alias("session"),
        F.first("request_id").alias("request"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_first_of_role"), F.struct("ordinal", "role")))), lambda x: x["role"]).alias("roles"),
        F.min_by(sample, "ordinal").alias("_a"),
        F.max_by(sample, "ordinal").alias("_b"),
    )
    samples = F.when(F.col("count") > 1, F.array("_a", "_b")).otherwise(F.array("_a"))
    body = F.to_json(F.struct("count", F.array("first", "last").alias("ordinals"), "request", "roles", samples.alias("samples"), "session"))
    return told.select("user_id", "first", "last", "count", body.alias("told"))


def overview(rows: DataFrame, limit: int) -> DataFrame:
    """One row a user: how many messages and runs are pending, and the runs (as JSON) that fit into ``limit`` characters, the
    overview's own frame included, in order; one that does not fit is left out and counted, and later ones may still fit.

    Runs stream through a task in the order of each user; what is held of a user is what fits.
    """
    ordered = runs(rows).repartition("user_id").sortWithinPartitions("user_id", "first").select("user_id", "last", "count", "told")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            values = [[user], [messages], [through], [groups], [groups - len(kept)], [kept]]
            types = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[c.split()[0] for c in RESULT.split(", ")])

        started, user, messages, through, groups, kept, used = False, None, 0, 0, 0, [], 0
        for b in batches:
            for own, last, count, told in zip(*[c.to_pylist() for c in b.columns]):
                if not started or own != user:
                    if started:
                        yield done()
                    started, user, messages, through, groups, kept, used = True, own, 0, 0, 0, [], len(json.dumps({"groups": []}))
                messages, through, groups = messages + count, last, groups + 1
                if used + len(told) + 1 <= limit:
                    kept.append(told)
                    used += len(told) + 1
        if started:
            yield done()

    return ordered.mapInArrow(fit, RESULT)
