"""Ingest and state queries over conversations (sources) and events (plans, jobs, versions)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.operators import ingest as M
from lodestone.plans import duck
from lodestone.plans.registry import query, table
from lodestone.plans.sources import sources

# Requests, a resent copy of every third, and a changed copy of every seventh.
_REQS = f"""{duck.SOURCES},
rq AS (SELECT user_id, request_id, min(sequence) AS first_sequence, sha256(string_agg(role || ':' || text, chr(10) ORDER BY sequence)) AS digest FROM src GROUP BY ALL),
al AS (SELECT *, 0 AS arrival FROM rq UNION ALL SELECT user_id, request_id, first_sequence, digest, 1 FROM rq WHERE first_sequence % 3 = 0 UNION ALL SELECT user_id, request_id, first_sequence, sha256(digest), 2 FROM rq WHERE first_sequence % 7 = 0)"""


def requests(spark, d):
    s = sources(spark, d)
    said = F.array_sort(F.collect_list(F.struct("sequence", F.concat_ws(":", "role", "text").alias("t"))))
    rq = s.groupBy("user_id", "request_id").agg(F.min("sequence").alias("first_sequence"), F.sha2(F.array_join(F.transform(said, lambda x: x["t"]), "\n"), 256).alias("digest"))
    again = rq.where("first_sequence % 3 = 0").withColumn("arrival", F.lit(1))
    changed = rq.where("first_sequence % 7 = 0").withColumn("digest", F.sha2("digest", 256)).withColumn("arrival", F.lit(2))
    return rq.withColumn("arrival", F.lit(0)).unionByName(again).unionByName(changed)


def known(spark):
    return spark.createDataFrame([], "user_id string, request_id string, digest string")


@query("idempotent_requests", f"WITH {_REQS} SELECT user_id, request_id, CAST(count(*) AS BIGINT) AS n_payloads, CASE WHEN count(DISTINCT digest) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replayed' ELSE 'fresh' END AS status FROM al GROUP BY user_id, request_id")
def idempotent_requests(spark, d):
    r = requests(spark, d)
    status = F.when(F.countDistinct("digest") > 1, "conflict").when(F.count("*") > 1, "replayed").otherwise("fresh")
    return r.groupBy("user_id", "request_id").agg(F.count("*").alias("n_payloads"), status.alias("status"))


@query("idempotency_conflicts", f"WITH {_REQS} SELECT user_id, request_id, digest FROM al WHERE arrival = 2")
def idempotency_conflicts(spark, d):
    return M.accept(requests(spark, d), known(spark))[2].select("user_id", "request_id", "digest")


@query("add_pipeline", f"WITH {_REQS} SELECT src.user_id, src.request_id, turn, sequence, '{'memory:episode/'}' || CASE WHEN l = '' THEN 'record' ELSE l END || '~' || CAST(sequence AS VARCHAR) || '#0:' || CAST(length(text) AS VARCHAR) AS ref FROM (SELECT *, left(array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')[1:9], '-'), 64) AS l FROM src) src")
def add_pipeline(spark, d):
    """Fresh requests' messages with their sequence and the reference of their whole-text passage."""
    fresh = M.accept(requests(spark, d), known(spark))[0]
    s = sources(spark, d).join(fresh.select("user_id", "request_id"), ["user_id", "request_id"], "left_semi")
    ref = F.concat(F.lit("memory:episode/"), T.label(F.col("text")), F.lit("~"), F.col("sequence").cast("string"), F.lit("#0:"), F.length("text").cast("string"))
    return s.select("user_id", "request_id", "turn", "sequence", ref.alias("ref"))


@query("assign_sequence", f"WITH {duck.SOURCES} SELECT conv_id, turn, sequence FROM src")
def assign_sequence(spark, d):
    return sources(spark, d).select("conv_id", "turn", "sequence")


@query("reflection_trigger", f"WITH {duck.SOURCES} SELECT conv_id, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(count(DISTINCT request_id) AS BIGINT) AS n_requests, (count(*) >= 5 OR sum(length(text)) >= 3000) AND count(DISTINCT request_id) >= 2 AS triggered FROM src GROUP BY conv_id")
def reflection_trigger(spark, d):
    return M.triggers(sources(spark, d).withColumn("foreign", F.lit(False)), "conv_id", items=5, chars=3000)


@query("trigger_gen2a", f"""WITH {duck.SOURCES}, l AS (SELECT *, last_value(session_id) OVER (PARTITION BY user_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cur FROM src)
SELECT user_id, count(*) >= 40 OR sum(length(text)) >= 30000 OR bool_or({duck.matches('text', fixed.CHANGE)} OR {duck.matches('text', fixed.DIRECT_FORGET)}) OR bool_or(session_id <> cur) AS triggered FROM l GROUP BY user_id""")
def trigger_gen2a(spark, d):
    w = Window.partitionBy("user_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources(spark, d).withColumn("current", F.last("session_id").over(w))
    cue = F.bool_or(T.matches(F.col("text"), fixed.CHANGE) | T.matches(F.col("text"), fixed.DIRECT_FORGET))
    return s.groupBy("user_id").agg(((F.count("*") >= 40) | (F.sum(F.length("text")) >= 30_000) | cue | F.bool_or(F.col("session_id") != F.col("current"))).alias("triggered"))


@query("close_batches")
def close_batches(spark, d):
    return M.close_batches(sources(spark, d), items=6, chars=4000)


_BATCHES = "b AS (SELECT event_id AS batch_id, CASE event_type WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS state FROM events)"


@query("recover_batches", f"WITH {_BATCHES} SELECT batch_id, CASE WHEN state = 'running' THEN 'interrupted' ELSE state END AS state FROM b")
def recover_batches(spark, d):
    state = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return M.recover(table(spark, d, "events").select(F.col("event_id").alias("batch_id"), state.alias("state")))


@query("forget_all_barrier", """WITH b AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events),
s AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'instruction' WHEN event_id < last THEN 'blocked' ELSE 'active' END AS state FROM b)
SELECT user_id, CAST(count(*) FILTER (WHERE state = 'active') AS BIGINT) AS active, CAST(count(*) FILTER (WHERE state = 'blocked') AS BIGINT) AS blocked FROM s GROUP BY user_id""")
def forget_all_barrier(spark, d):
    s = M.forget_barrier(table(spark, d, "events"), F.col("event_type") == "error", "user_id", order="event_id")
    return s.groupBy("user_id").agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "blocked").alias("blocked"))


_CMD = "(role = 'user' AND sequence % 4 = 1)"


@query("confirmation_window", f"""WITH {duck.SOURCES}, m AS (SELECT *, last_value(CASE WHEN {_CMD} THEN sequence WHEN role = 'user' THEN -1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS held FROM src)
SELECT sequence, held AS instruction FROM m WHERE held >= 0 AND role = 'assistant'""")
def confirmation_window(spark, d):
    cmd = (F.col("role") == "user") & (F.col("sequence") % 4 == 1)
    return M.confirmation_window(sources(spark, d), cmd, "user_id").select("sequence", "instruction")


@query("cascade_block", "WITH i AS (SELECT event_id AS item_id, unnest([event_id, event_id + 3, event_id + 9]) AS source FROM events), b AS (SELECT event_id AS source FROM events WHERE event_type = 'error') SELECT item_id, bool_or(source IN (SELECT source FROM b)) AS blocked FROM i GROUP BY item_id")
def cascade_block(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    items = e.select(i.alias("item_id"), F.array(i, i + 3, i + 9).alias("sources"))
    return M.cascade_block(items, e.where("event_type = 'error'").select(i.alias("source"))).select("item_id", "blocked")


@query("active_corpus", f"WITH {duck.SOURCES} SELECT user_id, session_id, sequence FROM src WHERE length(text) >= 50")
def active_corpus(spark, d):
    """Every user's active corpus; a source counts as active here from 50 characters on."""
    return sources(spark, d).where(F.length("text") >= 50).select("user_id", "session_id", "sequence")


@query("pending_items", f"WITH {duck.SOURCES}, q AS (SELECT sequence, CASE WHEN sequence % 3 = 0 THEN 'organized' ELSE 'pending' END AS state FROM src) SELECT user_id, sequence, length(text) AS n_chars FROM src JOIN q USING (sequence) WHERE state = 'pending'")
def pending_items(spark, d):
    s = sources(spark, d)
    queue = s.select("sequence", F.when(F.col("sequence") % 3 == 0, "organized").otherwise("pending").alias("state")).where("state = 'pending'")
    return s.join(queue, "sequence").select("user_id", "sequence", F.length("text").cast("long").alias("n_chars"))


@query("daily_nodes", "SELECT event_id AS node_id, user_id, 'daily' AS kind, strftime(ts, '%Y-%m-%d') AS day, 'active' AS status, CAST(1 AS BIGINT) AS version FROM events")
def daily_nodes(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("node_id"), "user_id", F.lit("daily").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("active").alias("status"), F.lit(1).cast("long").alias("version"))


@query("working_memory_view", f"""WITH {duck.SOURCES}, v AS (SELECT user_id, conv_id, turn, row_number() OVER w AS rn, sum(length(text)) OVER w AS running FROM src WINDOW w AS (PARTITION BY user_id ORDER BY sequence DESC))
SELECT user_id, conv_id, turn, CAST(running AS BIGINT) AS running_chars FROM v WHERE rn <= 40 AND (running <= 16000 OR rn = 1)""")
def working_memory_view(spark, d):
    return M.working_view(sources(spark, d), "user_id", order=[F.desc("sequence")]).select("user_id", "conv_id", "turn", "running_chars")


@query("maintenance_backlog", f"""WITH {duck.SOURCES}, w AS (SELECT user_id, max(sequence) AS mark FROM src WHERE conv_id < 50 GROUP BY user_id)
SELECT src.user_id, CAST(count(*) AS BIGINT) AS backlog, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM src LEFT JOIN w USING (user_id) WHERE sequence > coalesce(mark, 0) GROUP BY src.user_id""")
def maintenance_backlog(spark, d):
    s = sources(spark, d)
    marks = s.where("conv_id < 50").groupBy("user_id").agg(F.max("sequence").alias("processed_through"))
    return M.pending_after(s, marks, "user_id").groupBy("user_id").agg(F.count("*").alias("backlog"), F.sum(F.length("text")).cast("long").alias("n_chars"))


_JOBS = "j AS (SELECT event_id AS job_id, user_id, CASE event_type WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state, event_id % 6 AS attempts, epoch_us(ts) // 1000 AS available FROM events)"


@query("claimable_jobs", f"WITH {_JOBS} SELECT user_id, job_id FROM j WHERE state IN ('pending', 'failed') AND attempts < 5 AND available <= epoch_us(TIMESTAMP '2024-01-20') // 1000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY available, job_id) <= 3")
def claimable_jobs(spark, d):
    e = table(spark, d, "events").where("event_type <> 'view' and event_id % 6 < 5 and ts <= timestamp_ntz '2024-01-20 00:00:00'")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.unix_millis(F.col("ts").cast("timestamp")), "event_id"))
    return e.withColumn("rn", rn).where("rn <= 3").select("user_id", F.col("event_id").alias("job_id"))


@query("apply_supersede", """SELECT event_id, CASE WHEN n IS NULL THEN 'active' ELSE 'superseded' END AS status, n AS valid_to FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)""")
def apply_supersede(spark, d):
    return M.supersede(table(spark, d, "events"), "user_id", "event_type", order=["event_id"], at="event_id").select("event_id", "status", "valid_to")


_OLD = "SELECT user_id AS id, max(event_id) AS event_time, max(value) AS confidence, count(*) AS activity, 1 AS version, list_sort(list(DISTINCT event_type)) AS sources FROM events WHERE ts {} AND user_id % 4 <> {} GROUP BY user_id"


@query("node_upsert", f"""WITH o AS ({_OLD.format("< TIMESTAMP '2024-01-16'", 0)}), n AS ({_OLD.format(">= TIMESTAMP '2024-01-16'", 1)})
SELECT coalesce(o.id, n.id) AS id, coalesce(n.event_time, o.event_time) AS event_time, round(greatest(o.confidence, n.confidence), 6) AS confidence, CAST(coalesce(o.activity, 0) + CASE WHEN n.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS activity,
CAST(1 + CASE WHEN n.id IS NULL OR o.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version, CAST(len(list_distinct(list_concat(coalesce(o.sources, []), coalesce(n.sources, [])))) AS BIGINT) AS n_sources FROM o FULL JOIN n ON o.id = n.id""")
def node_upsert(spark, d):
    e = table(spark, d, "events")

    def part(df):
        return df.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("event_time"), F.max("value").alias("confidence"), F.count("*").alias("activity"), F.lit(1).alias("version"), F.array_sort(F.collect_set("event_type")).alias("sources"))

    out = M.node_upsert(part(e.where("ts < timestamp_ntz '2024-01-16 00:00:00' and user_id % 4 <> 0")), part(e.where("ts >= timestamp_ntz '2024-01-16 00:00:00' and user_id % 4 <> 1")))
    return out.select("id", "event_time", F.round("confidence", 6).alias("confidence"), "activity", "version", F.size("sources").cast("long").alias("n_sources"))


@query("purge_before", """WITH o AS (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10'), dv AS (SELECT event_id AS id, unnest([event_id - 500, event_id - 20]) AS source FROM events)
SELECT 'event' AS kind, CAST(count(*) AS BIGINT) AS n FROM o UNION ALL SELECT 'derived', CAST(count(DISTINCT id) AS BIGINT) FROM dv WHERE source IN (SELECT event_id FROM o)""")
def purge_before(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    out = M.purge_before(e.select(i.alias("id"), F.col("ts").alias("ingested")), e.select(i.alias("id"), F.array(i - 500, i - 20).alias("sources")), F.expr("timestamp_ntz '2024-01-10 00:00:00'"))
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("plan_prefix", f"""WITH {duck.SOURCES}, n AS (SELECT *, lead(session_id) OVER (PARTITION BY user_id ORDER BY sequence) AS nx FROM src),
a AS (SELECT user_id, max(CASE WHEN nx <> session_id THEN sequence END) AS ses, max(sequence) AS fin, count(DISTINCT request_id) >= 2 AND (count(*) >= 45 OR sum(length(text)) >= 40000) AS acc,
count(*) >= 90 OR sum(length(text)) >= 80000 AS cap, bool_or(role = 'user' AND {duck.matches('text', fixed.EXPLICIT_CHANGE)}) AS sd FROM n GROUP BY user_id)
SELECT user_id, CASE WHEN acc OR cap OR sd THEN fin ELSE coalesce(ses, 0) END AS target, concat_ws(',', CASE WHEN ses IS NOT NULL THEN 'session_prefix' END, CASE WHEN acc THEN 'accumulation' END, CASE WHEN cap THEN 'capacity' END, CASE WHEN sd THEN 'explicit_change' END) AS reasons FROM a""")
def plan_prefix(spark, d):
    return M.plan_prefix(sources(spark, d), "user_id", items=45, chars=40_000, requests=2)


@query("reply_background", f"""WITH {duck.SOURCES}, r AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM src)
SELECT a.sequence, CAST(count(u.sequence) AS BIGINT) AS n_background, min(u.sequence) AS first_background FROM r a LEFT JOIN r u ON u.session_id = a.session_id AND coalesce(u.run, 0) = coalesce(a.run, 0) AND u.role = 'user' WHERE a.role = 'assistant' GROUP BY a.sequence""")
def reply_background(spark, d):
    """Each assistant message with the run of user messages before it."""
    w = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    r = sources(spark, d).withColumn("run", F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(w), F.lit(0)))
    user = F.when(F.col("role") == "user", F.col("sequence"))
    g = r.groupBy("session_id", "run").agg(F.max(F.when(F.col("role") == "assistant", F.col("sequence"))).alias("sequence"), F.count(user).alias("n_background"), F.min(user).alias("first_background"))
    return g.where("sequence is not null").select("sequence", "n_background", "first_background")


@query("advance_watermark", """WITH w AS (SELECT user_id, event_id, min(CASE WHEN value > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM events)
SELECT user_id, coalesce(max(CASE WHEN ok = 1 THEN event_id END), 0) AS settled_through FROM w GROUP BY user_id""")
def advance_watermark(spark, d):
    return M.advance_watermark(table(spark, d, "events"), "user_id", order="event_id", done=F.col("value") > 5)


@query("apply_conflicts", """WITH e AS (SELECT event_id AS src, event_id + 10 AS dst, CASE event_id % 6 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'contradicts' ELSE 'about' END AS relation FROM events)
SELECT n.event_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE relation = 'supersedes' AND dst = n.event_id) THEN 'superseded' WHEN EXISTS (SELECT 1 FROM e WHERE relation = 'contradicts' AND (dst = n.event_id OR src = n.event_id)) THEN 'conflict' ELSE 'active' END AS status FROM events n""")
def apply_conflicts(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    rel = F.when(i % 6 == 0, "supersedes").when(i % 6 == 1, "contradicts").otherwise("about")
    edges = e.select(i.alias("src"), (i + 10).alias("dst"), rel.alias("relation"))
    hits = edges.where("relation = 'supersedes'").select(F.col("dst").alias("event_id"), F.lit(2).alias("s"))
    both = edges.where("relation = 'contradicts'").select(F.explode(F.array("src", "dst")).alias("event_id"), F.lit(1).alias("s"))
    level = hits.unionByName(both).groupBy("event_id").agg(F.max("s").alias("s"))
    return e.select("event_id").join(level, "event_id", "left").select("event_id", F.when(F.col("s") == 2, "superseded").when(F.col("s") == 1, "conflict").otherwise("active").alias("status"))


@query("store_stats", "SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def store_stats(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("retained_projection", """WITH r AS (SELECT event_id AS id, unnest([event_id, event_id + 4, event_id + 8]) AS source, unnest([0, 1, 2]) AS p FROM events),
b AS (SELECT event_id AS source FROM events WHERE event_type IN ('error', 'view')), f AS (SELECT r.*, b.source IS NOT NULL AS bl FROM r LEFT JOIN b ON b.source = r.source)
SELECT id, string_agg(CAST(source AS VARCHAR), ',' ORDER BY p) FILTER (WHERE NOT bl) AS kept, bool_or(bl) AS rebuilt FROM f GROUP BY id HAVING count(*) FILTER (WHERE NOT bl) > 0""")
def retained_projection(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    rows = e.select(i.alias("id"), F.array(i, i + 4, i + 8).alias("sources"))
    out = M.retained(rows, e.where("event_type in ('error', 'view')").select(i.alias("source")))
    return out.select("id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "rebuilt")


@query("unplanned_sources", f"WITH {duck.SOURCES}, p AS (SELECT unnest([sequence, sequence + 1]) AS s FROM src WHERE sequence % 5 = 0) SELECT sequence FROM src WHERE sequence NOT IN (SELECT s FROM p)")
def unplanned_sources(spark, d):
    s = sources(spark, d).select("sequence")
    planned = s.where("sequence % 5 = 0").select(F.explode(F.array(F.col("sequence"), F.col("sequence") + 1)).alias("sequence"))
    return s.join(planned, "sequence", "left_anti")


@query("changed_groups", """WITH a AS (SELECT user_id, event_type, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS g FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY ALL),
b AS (SELECT user_id, event_type, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS g FROM events GROUP BY ALL)
SELECT b.user_id, bool_and(coalesce(a.g = b.g, FALSE)) AS unchanged FROM b LEFT JOIN a USING (user_id, event_type) GROUP BY b.user_id""")
def changed_groups(spark, d):
    e = table(spark, d, "events")

    def digests(df, name):
        ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))
        return df.groupBy("user_id", "event_type").agg(F.sha2(F.array_join(ids, ","), 256).alias(name))

    both = digests(e, "new").join(digests(e.where("ts < timestamp_ntz '2024-01-29 00:00:00'"), "old"), ["user_id", "event_type"], "left")
    return both.groupBy("user_id").agg(F.bool_and(F.coalesce(F.col("old") == F.col("new"), F.lit(False))).alias("unchanged"))


@query("pending_after_watermark", f"""WITH {duck.SOURCES}, c AS (SELECT user_id, session_id, min(sequence) + 1 AS m FROM src WHERE conv_id % 2 = 0 GROUP BY ALL)
SELECT user_id, session_id, sequence FROM src LEFT JOIN c USING (user_id, session_id) WHERE sequence > coalesce(m, 0)""")
def pending_after_watermark(spark, d):
    s = sources(spark, d)
    cursors = s.where("conv_id % 2 = 0").groupBy("user_id", "session_id").agg((F.min("sequence") + 1).alias("processed_through"))
    return M.pending_after(s, cursors, "user_id", "session_id").select("user_id", "session_id", "sequence")


@query("patch_upsert", """SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 UNION ALL SELECT event_id, 'patched' FROM events WHERE event_id % 5 = 0""")
def patch_upsert(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return M.patch(e, e.where("event_id % 7 = 0"), e.where("event_id % 5 = 0").withColumn("event_type", F.lit("patched")), "event_id")
