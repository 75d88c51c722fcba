"""Queries over stored records: audits, gates, attachments, request states, fragments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import temporal as D
from lodestone.functions import text as T
from lodestone.operators import records as X
from lodestone.operators import retrieve as R
from lodestone.plans import duck
from lodestone.plans.q_chunk import _ISLANDS, shown
from lodestone.plans.q_retrieve import _bm25_sql, bm25_best
from lodestone.plans.q_temporal import _ANCHOR, _P, DATED, _rules
from lodestone.plans.registry import query, table

_TERMS = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: NOT list_contains({duck.listed(fixed.TERM_STOP)}, t))"
_ONCE = "list_filter({t}, lambda x, i: list_position({t}, x) = i)"
long = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")


@query("supplemental_queries", f"""WITH p AS (SELECT item_id, text, ['  ' || text || ' ', text || ' when', lower(text), split_part(text, ' ', 1), text || ' when'] AS l FROM benchmark),
k AS (SELECT item_id, list_filter(l, lambda x: lower(trim(x)) <> lower(trim(text))) AS f FROM p), o AS (SELECT item_id, {_ONCE.format(t='f')} AS u FROM k)
SELECT item_id, CAST(i - 1 AS BIGINT) AS position, u[i] AS query FROM o, range(1, 6) r(i) WHERE i <= len(u)""")
def supplemental_queries(spark, d):
    t = F.col("text")
    said = F.array(F.concat(F.lit("  "), t, F.lit(" ")), F.concat(t, F.lit(" when")), F.lower(t), F.split_part(t, F.lit(" "), F.lit(1)), F.concat(t, F.lit(" when")))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(X.supplemental(said, t)).alias("position", "query")).withColumn("position", long("position"))


@query("query_with_options", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE text || ' ' || array_to_string(['first', 'second', 'third'][1:CAST(item_id % 3 + 1 AS INTEGER)], ' ') END AS query FROM benchmark")
def query_with_options(spark, d):
    """A question's options are searched with it."""
    some = F.slice(T.words_in(["first", "second", "third"]), 1, (F.col("item_id") % 3 + 1).cast("int"))
    given = F.when(F.col("item_id") % 3 == 0, F.slice(some, 1, 0)).otherwise(some)
    return table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", "text", given).alias("query"))


@query("fulltext_match", f"""WITH {_bm25_sql()} SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS BIGINT) AS rn FROM bm
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) <= 30""")
def fulltext_match(spark, d):
    """Any-term matches by rank, then by recency; three times the answer of ten."""
    return bm25_best(spark, d, 30, newest=True).select("item_id", "doc_id", "rn")


@query("lexical_rank_scores", f"""WITH {_bm25_sql(tok=_TERMS, most=64)} SELECT item_id, doc_id, round(1.0 / (60 + rn), 9) AS score FROM bm WHERE rn <= 48""")
def lexical_rank_scores(spark, d):
    """Matches of the query's first 64 distinct terms, scored by rank alone."""
    top = bm25_best(spark, d, fixed.CHANNEL_DEPTH, tokens=T.terms_ascii, most=64)
    return top.select("item_id", "doc_id", F.round(1 / (fixed.RRF_K + F.col("rn")), 9).alias("score"))


@query("unread_pages", f"""WITH {_ISLANDS}, pg AS (SELECT doc_id, k * 300 AS s, least(k * 300 + 300, length(text)) AS e FROM documents, range((SELECT max(length(text)) FROM documents) // 300 + 1) r(k) WHERE k * 300 < length(text))
SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM pg
WHERE NOT (doc_id % 2 = 0 AND e <= 1400 AND EXISTS (SELECT 1 FROM isl i WHERE i.doc_id = pg.doc_id AND i.s <= pg.s AND i.e >= pg.e))""")
def unread_pages(spark, d):
    """Pages of 300 characters; even documents were read up to 1400."""
    docs = table(spark, d, "documents").select("doc_id", long(F.length("text")).alias("size")).where("size > 0")
    pages = docs.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(300).cast("long"))).alias("start"))
    pages = pages.select("doc_id", "start", F.least(F.col("start") + 300, "size").alias("end"))
    read = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(1400).cast("long").alias("end"))
    return X.unread_pages(pages, shown(spark, d).select("doc_id", "start", "end"), read, "doc_id").select("doc_id", "start", "end")


_FRAGMENT = "sha256('[\"doc:' || doc_id || '\",\"' || sha256(text) || '\",' || s || ',' || {e} || ']')"


@query("fragment_ids", f"""WITH f AS (SELECT doc_id, text, greatest(0, doc_id % 50 - 10) AS s, least(length(text), doc_id % 50 + 400) AS e FROM documents)
SELECT doc_id, {_FRAGMENT.format(e='e')} AS fragment_id, s = 0 AND e = length(text) AS complete, {_FRAGMENT.format(e='least(e, s + 120)')} AS shrunk_id, length(substring(text, s + 1, greatest(0, least(e, s + 120) - s))) AS shrunk_chars FROM f""")
def fragment_ids(spark, d):
    """A fragment's identity is its source, version and range; shrinking moves the end and so renames it."""
    i = F.col("doc_id")
    s = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc:"), i.cast("string")).alias("ref"), "text", (i % 50 - 10).alias("start"), (i % 50 + 400).alias("end"))
    small = X.fragments(s, limit=120).select("doc_id", F.col("fragment_id").alias("shrunk_id"), long(F.length("piece")).alias("shrunk_chars"))
    return X.fragments(s).select("doc_id", "fragment_id", "complete").join(small, "doc_id")


@query("episode_labels", f"""WITH s AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'),
a AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS said, list(role ORDER BY turn) AS roles FROM s GROUP BY conv_id),
w AS (SELECT conv_id, list_filter({_TERMS('said')}, lambda t: NOT list_contains({duck.listed(X.GREETINGS)}, t)) AS t, roles FROM a)
SELECT conv_id, array_to_string(list_concat(CASE WHEN conv_id % 4 = 0 THEN [] ELSE [CAST(DATE '2024-01-01' + CAST(conv_id % 300 AS INTEGER) AS VARCHAR)] END, list_concat(({_ONCE.format(t='roles')})[1:2], ({_ONCE.format(t='t')})[1:4])), '-') AS label FROM w""")
def episode_labels(spark, d):
    day = F.when(F.col("conv_id") % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int")))
    s = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn", day.alias("day"), F.concat(F.lit("Speaker: "), "role", F.lit("\n"), "text").alias("text"))
    return X.episode_labels(s, "conv_id", "turn")


@query("embedding_audit", """WITH i AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), v AS (SELECT vec_id, len(embedding[1:CASE WHEN vec_id % 11 = 0 THEN 63 ELSE 64 END]) AS n FROM embeddings)
SELECT coalesce(doc_id, vec_id) AS ref, CASE WHEN doc_id IS NULL THEN 'orphan' WHEN vec_id IS NULL THEN 'missing' ELSE 'dimensions' END AS problem FROM i FULL JOIN v ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL OR n <> 64""")
def embedding_audit(spark, d):
    size = F.when(F.col("vec_id") % 11 == 0, 63).otherwise(64)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ref"), F.slice("embedding", F.lit(1), size).alias("vector"))
    return X.embedding_audit(table(spark, d, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("ref")), v, 64)


@query("embedding_replace", """SELECT vec_id AS ref, 0 AS version FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE vec_id % 3 = 0""")
def embedding_replace(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ref"), F.lit(0).alias("version"))
    return X.replace_embeddings(v, v.where("ref % 3 = 0").withColumn("version", F.lit(1)))


@query("fingerprint_gate", """SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'stored' WHEN event_type = first_value(event_type) OVER w THEN 'same' ELSE 'mismatch' END AS state
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def fingerprint_gate(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("fingerprint"))
    return X.fingerprint_gate(e, "user_id", "event_id").select("event_id", "state")


@query("suite_by_family", """WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
r AS (SELECT conv_id, k // 20 AS request, sum(length(text)) AS chars, count(*) FILTER (WHERE role = 'user') AS asked FROM c GROUP BY ALL),
s AS (SELECT 'f' || CAST(conv_id % 4 AS VARCHAR) AS family, conv_id AS record, count(*) AS adds, CAST(sum(asked) AS BIGINT) AS questions, CAST(sum(chars) AS BIGINT) AS original_chars, CAST(max(chars) AS BIGINT) AS max_request_chars FROM r GROUP BY conv_id)
SELECT *, row_number() OVER (PARTITION BY family ORDER BY sha256('20261029:' || family || ':' || record), record) AS ordinal FROM s
QUALIFY row_number() OVER (PARTITION BY family ORDER BY sha256('20261029:' || family || ':' || record), record) <= 5""")
def suite_by_family(spark, d):
    """Five conversations of each family, drawn by hash, with the requests, questions and sizes of each."""
    c = table(spark, d, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    r = c.groupBy("conv_id", F.floor(F.col("k") / 20).alias("request")).agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("asked"))
    s = r.groupBy(F.col("conv_id").alias("record")).agg(F.count("*").alias("adds"), F.sum("asked").alias("questions"), F.sum("chars").alias("original_chars"), F.max("chars").alias("max_request_chars"))
    return X.suite(s.withColumn("family", F.concat(F.lit("f"), (F.col("record") % 4).cast("string"))), 5, 20261029)


@query("observations_attached", """WITH n AS (SELECT count(*) * 2 AS n FROM benchmark), o AS (SELECT event_id, event_id % n AS task, event_id % 9 AS pack_sha, event_id % 5 + 1 AS rank, row_number() OVER (PARTITION BY event_id % n ORDER BY event_id) AS rn FROM events, n)
SELECT event_id, CASE WHEN item_id IS NULL THEN 'unknown' WHEN rn > 1 THEN 'duplicate' WHEN pack_sha <> item_id % 3 THEN 'pack mismatch' WHEN rank > item_id % 8 THEN 'invalid ranks' ELSE 'attached' END AS verdict
FROM o LEFT JOIN benchmark ON item_id = task""")
def observations_attached(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("task"), (F.col("item_id") % 3).alias("pack"), (F.col("item_id") % 8).alias("n_results"))
    n = q.agg((F.count("*") * 2).alias("n"))
    i = F.col("event_id")
    o = table(spark, d, "events").join(F.broadcast(n)).select("event_id", (i % F.col("n")).alias("task"), (i % 9).alias("pack_sha"), F.array(i % 5 + 1).alias("ranks"))
    return X.attach(o, q, ["task"], "event_id").select("event_id", "verdict")


@query("case_runs", """WITH p AS (SELECT s_suppkey AS run_id, s_suppkey + k AS record, k AS search_id FROM supplier, range(6) r(k))
SELECT item_id AS case_id, run_id, search_id FROM p JOIN benchmark ON item_id = record
WHERE run_id % 3 = item_id % 3 AND (run_id + search_id) % 5 <> 0 AND (run_id % 4 = 0 OR record IN (run_id, run_id + 3))""")
def case_runs(spark, d):
    """Runs plan six searches each, report most of them, and may have been limited to two records."""
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), (F.col("item_id") % 3).alias("dataset"), F.col("item_id").alias("record"))
    run = F.col("run_id")
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id"))
    planned = runs.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("search_id")).withColumn("record", run + F.col("search_id"))
    runs = runs.select("run_id", (run % 3).alias("dataset"), F.when(run % 4 != 0, F.array(run, run + 3)).alias("selected"))
    return X.case_runs(cases, runs, planned, planned.where("(run_id + search_id) % 5 <> 0"))


@query("span_table", "SELECT user_id AS run_id, event_id % 7 AS span_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id DESC) = 1")
def span_table(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 7).alias("span_id"), "event_id", "event_type")
    return X.span_table(e, "event_id")


@query("fact_hints", f"""WITH h AS (SELECT event_id, CAST(ts AS DATE) AS day, {_rules()} AS h FROM (SELECT event_id, ts, {_P} AS p, {_ANCHOR} AS a FROM events)),
f AS (SELECT event_id // 3 AS fact, coalesce(list(h ORDER BY event_id) FILTER (WHERE h IS NOT NULL), []) AS hs, min(day) AS day FROM h GROUP BY ALL),
g AS (SELECT fact, hs, CASE WHEN fact % 4 = 0 THEN 'Yesterday' END AS req, CASE WHEN fact % 4 <> 1 THEN day END AS day,
  list_filter(hs, lambda x: lower(x.e) = 'yesterday') AS eq, list_distinct(list_transform(hs, lambda x: x.e || '|' || coalesce(CAST(x.s AS VARCHAR), '') || '|' || coalesce(CAST(x.t AS VARCHAR), ''))) AS kinds FROM f)
SELECT fact, CASE WHEN req IS NOT NULL THEN CASE WHEN len(eq) > 0 THEN eq[1].e ELSE req END WHEN len(kinds) = 1 THEN hs[-1].e ELSE CAST(day AS VARCHAR) END AS expression,
  CAST(CASE WHEN req IS NOT NULL THEN eq[1].s WHEN len(kinds) = 1 THEN hs[-1].s ELSE day END AS VARCHAR) AS start_date,
  CASE WHEN req IS NOT NULL THEN CASE WHEN len(eq) > 0 THEN eq[1].k ELSE 'expression' END WHEN len(kinds) = 1 THEN hs[-1].k WHEN day IS NOT NULL THEN 'day' END AS time_precision FROM g""")
def fact_hints(spark, d):
    """Facts of three events each; every fourth asks for an expression, every fourth has no day of its own."""
    phrase = F.element_at(T.words_in(DATED), (F.col("event_id") % len(DATED)).cast("int") + 1)
    hint = D.temporal_hint(phrase, F.when(F.col("event_id") % 5 != 0, F.to_date("ts")))
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("fact"), F.to_date("ts").alias("day"), F.struct("event_id", hint.alias("h")).alias("row"))
    f = e.groupBy("fact").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.min("day").alias("day"))
    hints = F.filter(F.transform("rows", lambda r: r["h"]), lambda h: h.isNotNull() & h["expression"].isNotNull())
    f = f.select("fact", hints.alias("hints"), F.when(F.col("fact") % 4 == 0, "Yesterday").alias("requested"), F.when(F.col("fact") % 4 != 1, F.col("day")).alias("event_day"))
    return X.fact_hints(f).select("fact", F.col("hint.expression").alias("expression"), F.col("hint.start").cast("string").alias("start_date"), F.col("hint.precision").alias("time_precision"))


_LOG = """lg AS (SELECT user_id, event_id // 2 AS request_id, event_id AS moment, CASE event_id % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'planned' WHEN 2 THEN 'raw' ELSE 'done' END AS stage FROM events),
st AS (SELECT *, CASE stage WHEN 'raw' THEN 1 WHEN 'planned' THEN 2 ELSE 3 END AS step FROM lg), ah AS (SELECT *, step - coalesce(lag(step) OVER (PARTITION BY user_id, request_id ORDER BY moment), 0) AS ahead FROM st),
rq AS (SELECT user_id, request_id, arg_max(stage, moment) AS stage, bool_and(ahead IN (0, 1)) AS legal FROM ah GROUP BY ALL)"""


def _log(spark, d):
    i = F.col("event_id")
    stage = F.when(i % 5 == 1, "planned").when((i % 5 == 0) | (i % 5 == 2), "raw").otherwise("done")
    return table(spark, d, "events").select("user_id", F.floor(i / 2).alias("request_id"), i.alias("at"), stage.alias("stage"))


@query("request_states", f"WITH {_LOG} SELECT * FROM rq")
def request_states(spark, d):
    return X.request_states(_log(spark, d))


@query("request_admission", f"WITH {_LOG} SELECT user_id, count(*) FILTER (WHERE stage <> 'done') AS n_incomplete, bool_and(stage = 'done') AS admitted FROM rq GROUP BY user_id")
def request_admission(spark, d):
    return X.admission(X.request_states(_log(spark, d)))


@query("missing_material", """SELECT doc_id AS ref FROM documents WHERE NOT (length(text) = 0 OR doc_id % 2 = 0 AND doc_id % 3 <> 0 AND (doc_id % 5 <> 0 OR length(text) <= 600))""")
def missing_material(spark, d):
    """Even documents were read whole in two parts, a third of all in another version, a fifth shown only up to 600."""
    i, none = F.col("doc_id"), F.lit(0).cast("long")
    docs = table(spark, d, "documents").select("doc_id", i.alias("ref"), F.sha2("text", 256).alias("version"), long(F.length("text")).alias("length"))
    half = F.floor(F.col("length") / 2)
    read = docs.where("doc_id % 2 = 0").select("ref", F.when(i % 3 == 0, "old").otherwise(F.col("version")).alias("version"), F.explode(F.array(F.struct(none.alias("start"), half.alias("end")), F.struct(half.alias("start"), F.col("length").alias("end")))).alias("r"))
    seen = docs.select("ref", "version", none.alias("start"), F.when(i % 5 == 0, F.least("length", F.lit(600).cast("long"))).otherwise(F.col("length")).alias("end"))
    return X.missing_material(docs.select("ref"), docs.select("ref", "version", "length"), seen, read.select("ref", "version", "r.start", "r.end"))
