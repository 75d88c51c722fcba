"""Selection, normalisation and sampling queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ingest as M
from lodestone.operators import select as P
from lodestone.plans import duck
from lodestone.plans.registry import query, table


@query("select_records", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_records(spark, d):
    wanted = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "lang")


@query("select_anchor_turns", "SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = c.conv_id AND c.turn = b.item_id % 3)")
def select_anchor_turns(spark, d):
    anchors = table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"), (F.col("item_id") % 3).alias("turn"))
    return table(spark, d, "conversations").join(anchors, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")


@query("select_window_turns", "SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN turn = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM conversations) WHERE a = 1")
def select_window_turns(spark, d):
    return P.window_turns(table(spark, d, "conversations"), F.col("turn") == 3, "conv_id", order="turn", radius=1).select("conv_id", "turn")


@query("cutoff_turns", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000 END, epoch_us(date_trunc('day', ts)) // 1000) < epoch_us(TIMESTAMP '2024-01-12 06:00:00') // 1000")
def cutoff_turns(spark, d):
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    own = F.when(F.col("event_id") % 3 != 0, ms(F.col("ts")))
    out = P.before(table(spark, d, "events"), ms(F.expr("timestamp_ntz '2024-01-12 06:00:00'")), F.coalesce(own, ms(F.date_trunc("day", "ts"))))
    return out.select("event_id")


@query("missing_evidence", "WITH k AS (SELECT list(doc_id) AS ks FROM documents) SELECT item_id, array_to_string(list_filter([item_id, item_id + 500, item_id + 990], lambda x: NOT list_contains(ks, x)), ',') AS missing FROM benchmark, k")
def missing_evidence(spark, d):
    gold = table(spark, d, "benchmark").select("item_id", F.posexplode(F.array(F.col("item_id"), F.col("item_id") + 500, F.col("item_id") + 990)).alias("p", "doc_id"))
    known = table(spark, d, "documents").select("doc_id", F.lit(True).alias("known"))
    m = gold.join(known, "doc_id", "left")
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("p", "doc_id")))), lambda x: x["doc_id"].cast("string"))
    return m.groupBy("item_id").agg(F.array_join(names, ",").alias("missing"))


@query("group_holdout_split", """WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('s1:' || source)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, rn <= greatest(1, least(n - 1, CAST(round(n * 0.2) AS BIGINT))) AS held_out FROM documents JOIN g USING (source)""")
def group_holdout_split(spark, d):
    return P.holdout(table(spark, d, "documents").select("doc_id", "source"), F.col("source"), 0.2, "s1").select("doc_id", "held_out")


@query("stable_hash_sample", "SELECT doc_id, sha256('s2:' || CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY 2 LIMIT 50")
def stable_hash_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", P.hash_order("s2", F.col("doc_id")).alias("h")).orderBy("h").limit(50)


@query("balanced_round_robin_sample", """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('s3:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
SELECT lang, doc_id, CAST(row_number() OVER (ORDER BY rn, lang) AS BIGINT) AS rn FROM r QUALIFY row_number() OVER (ORDER BY rn, lang) <= 30""")
def balanced_round_robin_sample(spark, d):
    s = P.round_robin(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 30, "s3")
    within = F.row_number().over(Window.partitionBy("lang").orderBy(P.hash_order("s3", F.col("doc_id")), "doc_id"))
    ranked = s.withColumn("_w", within)
    return ranked.withColumn("rn", F.row_number().over(Window.orderBy("_w", "lang")).cast("long")).select("lang", "doc_id", "rn")


@query("first_n_per_category", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def first_n_per_category(spark, d):
    return P.first_n(table(spark, d, "documents").select("source", "doc_id"), "source", 3, "doc_id")


@query("tasks_running_limit", "SELECT source, doc_id FROM documents QUALIFY count(*) OVER (ORDER BY source, doc_id) <= 120")
def tasks_running_limit(spark, d):
    """The cumulative limit over records in order is the first 120 tasks of that order."""
    return table(spark, d, "documents").select("source", "doc_id").orderBy("source", "doc_id").limit(120)


@query("visible_events_before_query", """WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT q.event_id AS query_event_id, CAST(count(e.event_id) FILTER (WHERE e.ts < q.ts) AS BIGINT) AS visible, CAST(count(e.event_id) FILTER (WHERE e.ts >= q.ts) AS BIGINT) AS excluded FROM q JOIN events e ON e.user_id = q.user_id GROUP BY q.event_id""")
def visible_events_before_query(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    out = P.as_of_counts(e.where("event_type = 'purchase'"), e, "user_id", "ts", "event_id")
    return out.withColumnRenamed("event_id", "query_event_id")


@query("visible_event_counts", """WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT q.user_id, count(e.event_id) FILTER (WHERE e.ts < q.ts) AS n FROM q JOIN events e ON e.user_id = q.user_id GROUP BY q.user_id, q.event_id)
SELECT user_id, CAST(count(*) AS BIGINT) AS queries, CAST(sum(n) AS BIGINT) AS visible FROM v GROUP BY user_id""")
def visible_event_counts(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    q = e.where("event_type = 'purchase'")
    seen = P.as_of_counts(q, e, "user_id", "ts", "event_id").join(q.select("event_id", "user_id"), "event_id")
    return seen.groupBy("user_id").agg(F.count("*").alias("queries"), F.sum("visible").alias("visible"))


@query("tasks_evidence_in_history", """WITH h AS (SELECT DISTINCT conv_id AS evidence FROM conversations WHERE role = 'user'),
t AS (SELECT item_id, unnest([item_id, item_id * 3]) AS evidence FROM benchmark)
SELECT item_id, bool_and(h.evidence IS NOT NULL) AS kept FROM t LEFT JOIN h USING (evidence) GROUP BY item_id""")
def tasks_evidence_in_history(spark, d):
    """Tasks whose evidence ids all lie in the history: conversations in which a user speaks."""
    turns = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("evidence")).distinct().withColumn("held", F.lit(True))
    tasks = table(spark, d, "benchmark").select("item_id", F.explode(F.array(F.col("item_id"), F.col("item_id") * 3)).alias("evidence"))
    return tasks.join(turns, "evidence", "left").groupBy("item_id").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("kept"))


@query("session_id_uniquify", "SELECT event_id, 's' || CAST(event_id % 40 AS VARCHAR) || CASE WHEN rn > 1 THEN '#' || CAST(rn AS VARCHAR) ELSE '' END AS session_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY event_id) AS rn FROM events)")
def session_id_uniquify(spark, d):
    e = table(spark, d, "events").withColumn("s", F.concat(F.lit("s"), (F.col("event_id") % 40).cast("string")))
    rn = F.row_number().over(Window.partitionBy("user_id", "s").orderBy("event_id"))
    e = e.withColumn("rn", rn)
    return e.select("event_id", F.when(F.col("rn") > 1, F.concat("s", F.lit("#"), F.col("rn").cast("string"))).otherwise(F.col("s")).alias("session_id"))


@query("evidence_dedup", f"SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, {duck.signature('text')}")
def evidence_dedup(spark, d):
    sig = F.sha2(T.signature(F.col("text")), 256)
    return table(spark, d, "documents").groupBy("source", sig.alias("s")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("question_is_last_user_turn", "SELECT conv_id, max(turn) AS question_turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def question_is_last_user_turn(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    return M.last_write(c, "conv_id", order=[F.desc("turn")]).select("conv_id", F.col("turn").alias("question_turn"))


@query("single_link_per_group", "SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS links, count(DISTINCT event_type) = 1 AS single FROM events GROUP BY user_id")
def single_link_per_group(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("links"))
    return g.withColumn("single", F.col("links") == 1)


@query("dangling_evidence", "SELECT item_id, item_id * 30 AS evidence FROM benchmark WHERE item_id * 30 NOT IN (SELECT doc_id FROM documents)")
def dangling_evidence(spark, d):
    e = table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 30).alias("evidence"))
    return e.join(table(spark, d, "documents").select(F.col("doc_id").alias("evidence")), "evidence", "left_anti").select("item_id", "evidence")


_NUMBERED = "(CAST(doc_id % 7 AS VARCHAR) || '. ' || text)"


@query("numbered_lines", f"""WITH l AS (SELECT doc_id, string_split({_NUMBERED} || chr(10) || 'x. no' || chr(10) || '12. yes', chr(10)) AS ls FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, CAST(regexp_extract(ls[i], '^([0-9]+)\\.', 1) AS BIGINT) AS fact_no FROM l, range(1, len(ls) + 1) r(i) WHERE regexp_matches(ls[i], '^[0-9]+\\.')""")
def numbered_lines(spark, d):
    said = F.concat(F.concat((F.col("doc_id") % 7).cast("string"), F.lit(". "), "text"), F.lit("\nx. no\n12. yes"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(said, "\n", -1)).alias("n", "line")).where(F.regexp_like("line", F.lit(r"^[0-9]+\.")))
    return lines.select("doc_id", F.col("n").cast("long").alias("line_no"), F.regexp_extract("line", r"^([0-9]+)\.", 1).cast("long").alias("fact_no"))


@query("normalize_dialog_ids", "SELECT event_id, 'D' || CAST(event_id % 12 AS VARCHAR) || ':' || CAST(event_id % 30 AS VARCHAR) AS dialog_ids FROM events")
def normalize_dialog_ids(spark, d):
    said = F.concat(F.lit("see D"), F.lpad((F.col("event_id") % 12).cast("string"), 3, "0"), F.lit(":"), F.lpad((F.col("event_id") % 30).cast("string"), 2, "0"))
    found = T.findall(said, r"D:?\d+:\d+")
    part = lambda x, k: F.regexp_extract(x, r"D:?(\d+):(\d+)", k).cast("int").cast("string")
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(found, lambda x: F.concat(F.lit("D"), part(x, 1), F.lit(":"), part(x, 2))), " ").alias("dialog_ids"))


@query("chunk_requests", "SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS request_no FROM conversations WHERE role <> 'system'")
def chunk_requests(spark, d):
    c = table(spark, d, "conversations").where("role <> 'system'")
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.floor((rn - 1) / 3).alias("request_no"))
