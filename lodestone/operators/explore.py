"""Deterministic exploration: best-first expansion from seeds under budgets of hops, neighbours and nodes, with a log.

A walk's score is the product of its edges' weights, each at most 1, so best-first order settles nodes by the score of their
best walk, and the first ``nodes`` of that order are what a queue would take from the frontier one by one. That makes
the exploration a few joins for all seeds at once: a level a hop, the best walk of each seed and node, one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def actions(edges: DataFrame, fan_out: int) -> DataFrame:
    """(src, dst, action, weight): links to follow from each node, forward ones (inspect) and reverse ones (backlinks), the
    ``fan_out`` of largest weight. The cut is taken before nodes meet, so a node of very many links costs no more than
    any other."""
    forward = edges.select("src", "dst", F.lit("inspect").alias("action"), "weight")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("backlinks").alias("action"), "weight")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "action"))
    return forward.unionByName(back).where("src <> dst").withColumn("_r", rank).where(F.col("_r") <= fan_out).drop("_r")


def explore(edges: DataFrame, seeds: DataFrame, hops: int = 3, nodes: int = 24, fan_out: int = 8) -> DataFrame:
    """(seed, rank, node, hop, score, path, log, found): the nodes that best-first expansion visits from each seed.

    edges: src, dst, weight in (0, 1]; seeds: node. A node is reached by its best walk of at most ``hops`` edges, of equal
    ones the shortest, then the smallest. ``log`` lists the actions of that walk, ``found`` counts the nodes within
    reach, so found > nodes says that the budget cut the walk off.
    """
    near = actions(edges, fan_out)
    front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"), F.lit(1.0).alias("score"), F.array("node").alias("path"), F.array().cast("array<string>").alias("log"))
    seen = front
    best = F.row_number().over(Window.partitionBy("seed", "node").orderBy(F.desc("score"), "hop", "path", "log"))
    for hop in range(1, hops + 1):
        step = front.join(near, front["node"] == near["src"]).select(
            "seed", F.col("dst").alias("node"), F.lit(hop).alias("hop"), (F.col("score") * F.col("weight")).alias("score"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("log", F.concat_ws(" ", F.col("src").cast("string"), "action", F.col("dst").cast("string"))).alias("log")
        )
        step = step.withColumn("_b", best).where("_b = 1").drop("_b")
        # A walk that is longer than another to the same node and scores no better leads nowhere that the other does not.
        known = seen.select("seed", "node", F.col("score").alias("_known"))
        front = step.join(known, ["seed", "node"], "left").where("_known is null or score > _known").drop("_known")
        seen = seen.unionByName(front).withColumn("_b", best).where("_b = 1").drop("_b")
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "hop", "node")
    found = seen.groupBy("seed").agg(F.count("*").alias("found"))
    taken = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nodes)
    return taken.join(found, "seed").select("seed", "rank", "node", "hop", "score", "path", "log", "found")
