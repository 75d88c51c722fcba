"""Graph queries over the events' users and days: event e is a node; edges join an event to its user's next one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans.registry import query, table

# Events are nodes, edges go to the same user's next event; relation and kind follow from the id.
_EDGES = """ev AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day FROM events),
nx AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM ev),
ed AS (SELECT src, dst, CASE src % 5 WHEN 0 THEN 'about' WHEN 1 THEN 'contains' WHEN 2 THEN 'supersedes' WHEN 3 THEN 'contradicts' ELSE 'same_event_as' END AS relation FROM nx WHERE dst IS NOT NULL),
bi AS (SELECT src, dst, relation FROM ed UNION ALL SELECT dst, src, relation FROM ed)"""
RELATIONS = ["about", "contains", "supersedes", "contradicts", "same_event_as"]


def nodes(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("node"), "user_id", "event_type", "value", F.to_date("ts").alias("day"))


def edges(spark, d):
    n = nodes(spark, d)
    e = n.select(F.col("node").alias("src"), F.lead("node").over(Window.partitionBy("user_id").orderBy("node")).alias("dst")).where("dst is not null")
    return e.withColumn("relation", F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), (F.col("src") % 5).cast("int") + 1))


@query("graph_one_hop", f"""WITH {_EDGES}, c AS (SELECT bi.src AS seed, e.event_id AS node, relation, e.event_id AS updated, e.value AS relevance FROM bi JOIN ev e ON e.event_id = bi.dst WHERE e.event_type <> 'error'),
n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY seed ORDER BY updated DESC, node, relation) <= 8)
SELECT seed, node, relation, CAST(row_number() OVER (PARTITION BY seed ORDER BY relevance DESC, updated DESC, node, relation) AS BIGINT) AS rn FROM n QUALIFY row_number() OVER (PARTITION BY seed ORDER BY relevance DESC, updated DESC, node, relation) <= 2""")
def graph_one_hop(spark, d):
    n = nodes(spark, d)
    info = n.select("node", F.when(F.col("event_type") == "error", "tombstoned").otherwise("active").alias("status"), F.col("node").alias("updated"), F.col("value").alias("relevance"))
    return G.one_hop(edges(spark, d), info, n, 2)


_BFS = """w AS (SELECT event_id AS seed, event_id AS node, 0 AS hop FROM ev WHERE event_id % 50 = 0 UNION ALL SELECT w.seed, bi.dst, w.hop + 1 FROM w JOIN bi ON bi.src = w.node WHERE w.hop < 3),
v AS (SELECT seed, node, min(hop) AS hop FROM w GROUP BY ALL)"""


@query("graph_bfs", f"WITH RECURSIVE {_EDGES}, {_BFS} SELECT seed, node, CAST(hop AS BIGINT) AS hop FROM v")
def graph_bfs(spark, d):
    out = G.bfs(edges(spark, d), nodes(spark, d).where("node % 50 = 0"), 3)
    return out.select("seed", "node", F.col("hop").cast("long").alias("hop"))


@query("graph_bfs_scored", f"""WITH RECURSIVE {_EDGES}, we AS (SELECT src, dst, relation, CAST(src % 40 AS DOUBLE) AS weight FROM ed),
nb AS (SELECT src, dst, relation, weight FROM we UNION ALL SELECT dst, src, relation, weight FROM we),
k AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, relation) <= 8),
h1 AS (SELECT e.event_id AS seed, k.dst AS node, max(greatest(0.8, weight / 60)) AS score FROM ev e JOIN k ON k.src = e.event_id WHERE e.event_id % 50 = 0 AND k.dst <> e.event_id GROUP BY ALL),
h2 AS (SELECT h1.seed, k.dst AS node, max(greatest(h1.score * 0.8, weight / 60)) AS score FROM h1 JOIN k ON k.src = h1.node
  WHERE k.dst <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 o WHERE o.seed = h1.seed AND o.node = k.dst) GROUP BY ALL)
SELECT event_id AS seed, event_id AS node, 0 AS hop, 1.0 AS score FROM ev WHERE event_id % 50 = 0 UNION ALL SELECT seed, node, 1, round(score, 6) FROM h1 UNION ALL SELECT seed, node, 2, round(score, 6) FROM h2""")
def graph_bfs_scored(spark, d):
    e = edges(spark, d).withColumn("weight", (F.col("src") % 40).cast("double"))
    out = G.bfs_scored(e, nodes(spark, d).where("node % 50 = 0"), 2)
    return out.withColumn("score", F.round("score", 6))


@query("relation_score", f"""WITH {_EDGES} SELECT src, dst, relation, round((src % 7) / 7.0 + CASE WHEN relation IN ('supersedes', 'contradicts', 'same_event_as') THEN 1 ELSE 0 END, 6) AS score FROM ed""")
def relation_score(spark, d):
    bonus = F.when(F.col("relation").isin(*G.RANKED_RELATIONS), 1).otherwise(0)
    return edges(spark, d).withColumn("score", F.round(F.col("src") % 7 / 7.0 + bonus, 6))


@query("conflict_components", f"""WITH RECURSIVE {_EDGES}, ce AS (SELECT src, dst FROM ed WHERE relation IN ('contradicts', 'same_event_as', 'supersedes')),
cb AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce), r AS (SELECT src AS node, src AS reach FROM cb UNION SELECT r.node, cb.dst FROM r JOIN cb ON cb.src = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def conflict_components(spark, d):
    return G.components(edges(spark, d).where(F.col("relation").isin(*G.RANKED_RELATIONS)))


@query("visible_edges", f"""WITH {_EDGES}, ee AS (SELECT src, dst, relation, src + 3 AS s FROM ed UNION ALL SELECT dst, src, relation, src + 3 FROM ed WHERE relation IN ('contradicts', 'same_event_as')),
hid AS (SELECT event_id FROM ev WHERE event_type = 'error')
SELECT src, dst, relation FROM ee WHERE src NOT IN (SELECT event_id FROM hid) AND dst NOT IN (SELECT event_id FROM hid) AND s NOT IN (SELECT event_id FROM hid)""")
def visible_edges(spark, d):
    e = edges(spark, d).withColumn("sources", F.array(F.col("src") + 3))
    return G.visible_edges(e, nodes(spark, d).where("event_type = 'error'")).select("src", "dst", "relation")


@query("graph_backlinks", f"WITH {_EDGES} SELECT event_id AS node, dst AS other, relation, 'forward' AS direction FROM ev JOIN ed ON src = event_id UNION ALL SELECT event_id, src, relation, 'backward' FROM ev JOIN ed ON dst = event_id")
def graph_backlinks(spark, d):
    e, n = edges(spark, d), nodes(spark, d).select("node")
    forward = n.join(e, n["node"] == e["src"]).select("node", F.col("dst").alias("other"), "relation", F.lit("forward").alias("direction"))
    backward = n.join(e, n["node"] == e["dst"]).select("node", F.col("src").alias("other"), "relation", F.lit("backward").alias("direction"))
    return forward.unionByName(backward)


_KINDS = "(CASE {c} % 6 WHEN 0 THEN 'episode' WHEN 1 THEN 'person' WHEN 2 THEN 'entity' WHEN 3 THEN 'concept' WHEN 4 THEN 'event' ELSE 'fact' END)"
_ALLOWED = """((relation = 'about' AND l IN ('fact', 'event') AND r IN ('person', 'entity', 'concept', 'event')) OR (relation = 'contains' AND l = 'episode' AND r IN ('fact', 'event'))
  OR (relation IN ('supersedes', 'contradicts') AND l IN ('fact', 'event') AND r = l) OR (relation = 'same_event_as' AND l = 'event' AND r = 'event'))"""
KINDS = ["episode", "person", "entity", "concept", "event", "fact"]


def kind(c):
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col(c) % 6).cast("int") + 1)


@query("edge_type_violations", f"WITH {_EDGES}, t AS (SELECT *, {_KINDS.format(c='src')} AS l, {_KINDS.format(c='dst')} AS r FROM ed) SELECT src, dst, relation, l AS left_kind, r AS right_kind FROM t WHERE NOT {_ALLOWED}")
def edge_type_violations(spark, d):
    e = edges(spark, d).withColumn("left_kind", kind("src")).withColumn("right_kind", kind("dst"))
    return e.where(~G.kinds_allowed("left_kind", "right_kind", "relation"))


@query("edge_canonicalize", f"""WITH {_EDGES}, m AS (SELECT src, dst, relation FROM bi UNION ALL SELECT src, src, relation FROM ed)
SELECT DISTINCT CASE WHEN relation IN ('contradicts', 'same_event_as') THEN least(src, dst) ELSE src END AS src, CASE WHEN relation IN ('contradicts', 'same_event_as') THEN greatest(src, dst) ELSE dst END AS dst, relation FROM m WHERE src <> dst""")
def edge_canonicalize(spark, d):
    e = edges(spark, d)
    return G.canonical(G.both_ways(e).unionByName(e.select("src", F.col("src").alias("dst"), "relation")))


_CONTEXT = """own AS (SELECT user_id, event_id AS node, event_id AS updated FROM ev WHERE event_type <> 'error'),
pre AS (SELECT user_id, node, 0 AS channel, row_number() OVER (PARTITION BY user_id ORDER BY node) AS place FROM own WHERE node % 50 = 0 QUALIFY place <= 40),
hit AS (SELECT user_id, node, 1 AS channel, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, node) AS place FROM own JOIN (SELECT event_id, value FROM ev WHERE event_type = 'purchase') ON event_id = node QUALIFY place <= 80),
rec AS (SELECT user_id, node, 2 AS channel, row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, node) AS place FROM own QUALIFY place <= 40),
onc AS (SELECT user_id, node, min({'c': channel, 'p': place}) AS m FROM (SELECT * FROM pre UNION ALL SELECT * FROM hit UNION ALL SELECT * FROM rec) GROUP BY ALL),
hld AS (SELECT user_id, node, m.c AS channel, m.p AS place, row_number() OVER (PARTITION BY user_id ORDER BY m.c, m.p, node) AS rn FROM onc QUALIFY rn <= 40),
lnk AS (SELECT v.user_id, e.src, e.dst, e.relation FROM ed e JOIN ev v ON v.event_id = e.src),
tch AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY src DESC, src, dst, relation) AS n FROM (SELECT DISTINCT l.* FROM lnk l JOIN hld h ON h.user_id = l.user_id AND h.rn <= 20 AND (h.node = l.src OR h.node = l.dst)) QUALIFY n <= 200),
nbr AS (SELECT user_id, node, 3 AS channel, min(place) AS place FROM (SELECT user_id, src AS node, n * 2 AS place FROM tch UNION ALL SELECT user_id, dst, n * 2 + 1 FROM tch) t WHERE EXISTS (SELECT 1 FROM own o WHERE o.user_id = t.user_id AND o.node = t.node)
  AND NOT EXISTS (SELECT 1 FROM hld h WHERE h.user_id = t.user_id AND h.node = t.node) GROUP BY user_id, node),
ctx AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY channel, place, node) AS BIGINT) AS rn, node AS event_id, CASE channel WHEN 0 THEN 'preferred' WHEN 1 THEN 'hit' WHEN 2 THEN 'recent' ELSE 'neighbour' END AS channel
  FROM (SELECT user_id, node, channel, place FROM hld UNION ALL SELECT user_id, node, channel, place FROM nbr) QUALIFY rn <= 40)"""


def user_context(spark, d):
    """Each user's context and its links: preferred nodes, then hits by value, then recent ones, then link neighbours."""
    n = nodes(spark, d)
    own = n.where("event_type <> 'error'").select("user_id", "node", F.col("node").alias("updated"), "value", "event_type")
    preferred = own.where("node % 50 = 0").select("user_id", "node", F.col("node").alias("place"))
    hits = own.where("event_type = 'purchase'").select("user_id", "node", (-F.col("value")).alias("place"))
    links = edges(spark, d).join(n.select(F.col("node").alias("src"), "user_id"), "src").withColumn("created", F.col("src"))
    return G.maintenance_context(own.select("user_id", "node", "updated"), preferred, hits, links)


@query("maintenance_context", f"WITH {_EDGES}, {_CONTEXT} SELECT * FROM ctx")
def maintenance_context(spark, d):
    return user_context(spark, d)[0].withColumnRenamed("node", "event_id")


@query("maintenance_links", f"WITH {_EDGES}, {_CONTEXT} SELECT user_id, src, dst, relation FROM tch")
def maintenance_links(spark, d):
    return user_context(spark, d)[1]


@query("connection_menu", f"""WITH {_EDGES}, {_CONTEXT}, n AS (SELECT event_id, user_id, day, {_KINDS.format(c='event_id')} AS kind FROM ev SEMI JOIN ctx USING (event_id)),
rel AS (SELECT unnest(['about', 'contains', 'supersedes', 'contradicts', 'same_event_as']) AS relation),
p AS (SELECT a.event_id AS src, b.event_id AS dst, relation, a.kind AS l, b.kind AS r, a.day = b.day AS shared FROM n a JOIN n b ON a.user_id = b.user_id AND a.event_id <> b.event_id, rel)
SELECT src, dst, relation FROM p WHERE {_ALLOWED} AND (relation NOT IN ('contradicts', 'same_event_as') OR src < dst) AND (relation <> 'contains' OR shared)""")
def connection_menu(spark, d):
    """Allowed connections between any two nodes of a user's maintenance context, which is capped and so bounds the
    menu; "contains" needs a shared source, here the day."""
    kept = maintenance_context(spark, d).select(F.col("event_id").alias("node"))
    n = nodes(spark, d).join(kept, "node", "left_semi").select("node", "user_id", "day", kind("node").alias("k"))
    a, b = n.toDF("src", "user_id", "lday", "lk"), n.toDF("dst", "user_id", "rday", "rk")
    p = a.join(b, "user_id").where("src <> dst").withColumn("relation", F.explode(F.array(*[F.lit(r) for r in RELATIONS])))
    symmetric = F.col("relation").isin(*G.SYMMETRIC)
    shared = (F.col("relation") != "contains") | (F.col("lday") == F.col("rday"))
    return p.where(G.kinds_allowed("lk", "rk", "relation") & (~symmetric | (F.col("src") < F.col("dst"))) & shared).select("src", "dst", "relation")


@query("source_states", f"WITH {_EDGES}, s AS (SELECT event_id, unnest([event_id + 1, event_id + 2]) AS source, CASE event_id % 9 WHEN 0 THEN 'superseded' WHEN 1 THEN 'conflict' ELSE 'active' END AS status FROM ev) SELECT DISTINCT source, status FROM s WHERE status IN ('superseded', 'conflict')")
def source_states(spark, d):
    n = F.col("node")
    status = F.when(n % 9 == 0, "superseded").when(n % 9 == 1, "conflict").otherwise("active")
    s = nodes(spark, d).select(status.alias("status"), F.explode(F.array(n + 1, n + 2)).alias("source"))
    return s.where(F.col("status").isin("superseded", "conflict")).select("source", "status").distinct()


# Spans: event e; its parent is e - 7 in the same user's trace or nothing.
_SPANS = "sp AS (SELECT event_id AS span_id, user_id AS trace_id, CASE WHEN event_id % 4 <> 0 THEN event_id - 150 END AS parent_id, epoch_us(ts) // 1000 AS started, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS ended FROM events)"


def spans(spark, d):
    i, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(i.alias("span_id"), F.col("user_id").alias("trace_id"), F.when(i % 4 != 0, i - 150).alias("parent_id"), ms.alias("started"), (ms + F.floor(F.col("value") * 1000)).alias("ended"))


@query("span_orphans", f"WITH {_SPANS} SELECT span_id FROM sp WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sp p WHERE p.span_id = sp.parent_id AND p.trace_id = sp.trace_id)")
def span_orphans(spark, d):
    s = spans(spark, d)
    parents = s.select(F.col("span_id").alias("parent_id"), "trace_id")
    return s.where("parent_id is not null").join(parents, ["parent_id", "trace_id"], "left_anti").select("span_id")


@query("span_time_violations", f"WITH {_SPANS} SELECT c.span_id, p.span_id AS parent_id FROM sp c JOIN sp p ON p.span_id = c.parent_id WHERE c.started < p.started OR c.ended > p.ended")
def span_time_violations(spark, d):
    s = spans(spark, d)
    p = s.select(F.col("span_id").alias("parent_id"), F.col("started").alias("ps"), F.col("ended").alias("pe"))
    return s.join(p, "parent_id").where("started < ps or ended > pe").select("span_id", "parent_id")


@query("edge_summary", f"""WITH {_EDGES}, s AS (SELECT src AS node, 1 AS o, 0 AS i, relation FROM ed UNION ALL SELECT dst, 0, 1, relation FROM ed)
SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming, array_to_string(list_sort(list_distinct(list(relation))), ',') AS relations FROM s GROUP BY node""")
def edge_summary(spark, d):
    e = edges(spark, d)
    s = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "relation").unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "relation"))
    return s.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))


@query("edge_narrative", f"WITH {_EDGES} SELECT src, dst, a.event_type || '#' || src || ' ' || relation || ' ' || b.event_type || '#' || dst AS line FROM ed JOIN ev a ON a.event_id = src JOIN ev b ON b.event_id = dst")
def edge_narrative(spark, d):
    n = nodes(spark, d)
    a, b = n.select(F.col("node").alias("src"), F.col("event_type").alias("at")), n.select(F.col("node").alias("dst"), F.col("event_type").alias("bt"))
    return edges(spark, d).join(a, "src").join(b, "dst").select("src", "dst", F.format_string("%s#%d %s %s#%d", "at", "src", "relation", "bt", "dst").alias("line"))
