"""Graph operators: neighbours, bounded walks, components, edge rules. Walks are loops of joins, a level each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written

RANKED_RELATIONS = ("supersedes", "contradicts", "same_event_as")
SYMMETRIC = ("contradicts", "same_event_as")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, relation) and their reverses."""
    return edges.select("src", "dst", "relation").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))


def one_hop(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, fan_out: int) -> DataFrame:
    """(seed, node, relation, rn): active neighbours of either direction, the newest fan_out * 4, then the most
    relevant fan_out. nodes: node, status, updated, relevance."""
    near = both_ways(edges).join(seeds.select(F.col("node").alias("src")), "src", "left_semi")
    near = near.join(nodes.where("status = 'active'"), near["dst"] == nodes["node"]).select(F.col("src").alias("seed"), "node", "relation", "updated", "relevance")
    newest = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("updated"), "node", "relation"))
    near = near.withColumn("_n", newest).where(F.col("_n") <= 4 * fan_out)
    best = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("relevance"), F.desc("updated"), "node", "relation"))
    return near.withColumn("rn", best).where(F.col("rn") <= fan_out).select("seed", "node", "relation", F.col("rn").cast("long").alias("rn"))


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(seed, node, hop, path, relations): every node's first visit within max_hops of each seed; of several shortest
    paths the one with the smallest node sequence."""
    near = both_ways(edges).distinct()
    front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"), F.array("node").alias("path"), F.array().cast("array<string>").alias("relations"))
    seen = front
    for hop in range(1, max_hops + 1):
        step = front.join(near, front["node"] == near["src"]).select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hop"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("relations", F.col("relation")).alias("relations"))
        step = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        first = F.row_number().over(Window.partitionBy("seed", "node").orderBy("path", "relations"))
        front = step.withColumn("_i", first).where("_i = 1").drop("_i")
        seen = seen.unionByName(front)
    return seen


def bfs_scored(edges: DataFrame, seeds: DataFrame, max_hops: int, fan_out: int = 8) -> DataFrame:
    """(seed, node, hop, score): scores decay by 0.8 a hop or come from the node's own relation score / 60; at most
    fan_out neighbours of a node are followed. edges: src, dst, relation, weight."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "weight")
    near = edges.select("src", "dst", "relation", "weight").unionByName(flipped)
    kept = near.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "relation"))).where(F.col("_r") <= fan_out)
    front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"), F.lit(1.0).alias("score"))
    seen = front
    for hop in range(1, max_hops + 1):
        step = front.join(kept, front["node"] == kept["src"]).select("seed", F.col("dst").alias("node"), F.greatest(F.col("score") * 0.8, F.col("weight") / 60).alias("score"))
        step = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = step.groupBy("seed", "node").agg(F.max("score").alias("score")).select("seed", "node", F.lit(hop).alias("hop"), "score")
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): connected components by minimum labels with pointer jumping; component is the smallest
    node. Lineage is cut each round by a checkpoint where a checkpoint folder is set, as on a cluster."""
    checkpoint = edges.sparkSession.sparkContext.getCheckpointDir() is not None
    near = both_ways(edges.withColumn("relation", F.lit("")) if "relation" not in edges.columns else edges).select("src", "dst").distinct()
    label = near.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component"))
    for _ in range(max_rounds):
        low = near.join(label, near["dst"] == label["node"]).groupBy("src").agg(F.min("component").alias("m"))
        hooked = label.join(low, label["node"] == low["src"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = hooked.select(F.col("node").alias("p"), F.col("component").alias("pc"))
        new = hooked.join(up, hooked["component"] == up["p"], "left").select("node", F.least("component", F.coalesce("pc", "component")).alias("component"))
        new = new.checkpoint() if checkpoint else new.cache()
        changed = new.join(label.withColumnRenamed("component", "was"), "node").where("component < was").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def canonical(edges: DataFrame) -> DataFrame:
    """Edges without self-links, symmetric relations in sorted order, one row per (src, dst, relation)."""
    symmetric = F.col("relation").isin(*SYMMETRIC)
    e = edges.where("src <> dst")
    return e.select(F.when(symmetric, F.least("src", "dst")).otherwise(F.col("src")).alias("src"), F.when(symmetric, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("dst"), "relation").distinct()


def kinds_allowed(left: str, right: str, relation: str):
    """Whether a relation may join nodes of these kinds, as a column."""
    lk, rk, r = F.col(left), F.col(right), F.col(relation)
    stated = lk.isin("fact", "event")
    about = (r == "about") & stated & rk.isin("person", "entity", "concept", "event")
    contains = (r == "contains") & (lk == "episode") & rk.isin("fact", "event")
    states = r.isin("supersedes", "contradicts") & stated & (lk == rk)
    same = (r == "same_event_as") & (lk == "event") & (rk == "event")
    return about | contains | states | same


def visible_edges(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges (src, dst, relation, sources), symmetric ones from either end, none of whose ends or sources is hidden."""
    flipped = edges.where(F.col("relation").isin(*SYMMETRIC)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "sources")
    every = edges.select("src", "dst", "relation", "sources").unionByName(flipped)
    touched = every.select("src", "dst", "relation", F.explode(F.concat(F.array("src", "dst"), "sources")).alias("node"))
    bad = touched.join(hidden.select("node"), "node", "left_semi").select("src", "dst", "relation").distinct()
    return every.join(bad, ["src", "dst", "relation"], "left_anti")


def maintenance_context(nodes: DataFrame, preferred: DataFrame, hits: DataFrame, links: DataFrame, limit: int = 40, recent: int = 40, seeds: int = 20, most_links: int = 200) -> tuple[DataFrame, DataFrame]:
    """(context, links) of each user: at most ``limit`` nodes (user_id, rn, node, channel) and the newest ``most_links`` links
    (user_id, src, dst, relation) at the first ``seeds`` of them.

    Nodes come in the order of channels, each node by its first: preferred ones, search hits, the ``recent`` newest, and
    while there is room the other ends of those links. nodes: user_id, node, updated (those that may be shown);
    preferred, hits: user_id, node, place; links: user_id, src, dst, relation, created.
    """
    own = nodes.select("user_id", "node")
    first = lambda df, order, most: df.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("place") <= most)
    channels = [
        first(preferred.join(own, ["user_id", "node"], "left_semi"), ["place", "node"], limit),
        first(hits.join(own, ["user_id", "node"], "left_semi"), ["place", "node"], 2 * limit),
        first(nodes, [F.desc("updated"), "node"], recent),
    ]
    tagged = [c.select("user_id", "node", F.lit(k).alias("channel"), "place") for k, c in enumerate(channels)]
    union = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    once = union.groupBy("user_id", "node").agg(F.min(F.struct("channel", "place")).alias("p")).select("user_id", "node", "p.*")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("channel", "place", "node"))
    # A table: it is read for two limits, and the plan of both in one union gives wrong rows on this Spark.
    held = written(once.withColumn("rn", place).where(F.col("rn") <= limit), "context")
    heads = held.where(F.col("rn") <= seeds).select("user_id", "node")
    # Each link by its ends, so that one join finds those at a head.
    by_end = links.select("user_id", "src", "dst", "relation", "created", F.explode(F.array("src", "dst")).alias("node"))
    touched = by_end.join(heads, ["user_id", "node"], "left_semi").drop("node").distinct()
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created"), "src", "dst", "relation"))
    touched = touched.withColumn("_n", newest).where(F.col("_n") <= most_links)
    ends = touched.select("user_id", F.posexplode(F.array("src", "dst")).alias("_e", "node"), "_n").groupBy("user_id", "node").agg(F.min(F.col("_n") * 2 + F.col("_e")).alias("place"))
    more = ends.join(own, ["user_id", "node"], "left_semi").join(held, ["user_id", "node"], "left_anti").select("user_id", "node", F.lit(3).alias("channel"), "place")
    every = held.drop("rn").unionByName(more).withColumn("rn", place).where(F.col("rn") <= limit)
    names = F.element_at(F.array(*[F.lit(n) for n in ("preferred", "hit", "recent", "neighbour")]), F.col("channel") + 1)
    return every.select("user_id", F.col("rn").cast("long").alias("rn"), "node", names.alias("channel")), touched.select("user_id", "src", "dst", "relation")
