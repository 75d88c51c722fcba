"""Evaluation queries: benchmark lines are gold evidence for BM25 results; events give latencies and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluate as E
from lodestone.plans import duck
from lodestone.plans.q_assemble import ranked_docs
from lodestone.plans.q_graph import _SPANS, spans
from lodestone.plans.q_retrieve import _bm25_sql
from lodestone.plans.registry import query, table
from lodestone.sources.shared import written

_EXPECTED = """ex AS (SELECT item_id, CAST(i - 1 AS BIGINT) AS target_index, ls[i] AS line FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark) t, range(1, len(ls) + 1) r(i) WHERE length(ls[i]) > 20)"""
_RANKS = f"""{_bm25_sql()}, {_EXPECTED},
rs AS (SELECT item_id, rn, text FROM bm JOIN documents USING (doc_id) WHERE rn <= 10),
m AS (SELECT ex.item_id, target_index, min(rn) AS match_rank FROM ex JOIN rs ON rs.item_id = ex.item_id WHERE contains(lower(text), lower(line)) GROUP BY ALL),
rk AS (SELECT ex.item_id, ex.target_index, match_rank FROM ex LEFT JOIN m ON m.item_id = ex.item_id AND m.target_index = ex.target_index)"""


def expected(spark, d):
    lines = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("target_index", "line")).where(F.length("line") > 20)
    return lines.select("item_id", F.col("target_index").cast("long").alias("target_index"), F.array().cast("array<bigint>").alias("ids"), F.array("line").alias("contains_any"))


def results(spark, d, k=10):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    top = written(ranked_docs(spark, d, k).withColumnRenamed("query_id", "item_id"), "found")
    return top.join(docs, "doc_id").select("item_id", F.col("rn").alias("rank"), F.col("doc_id").alias("id"), "content")


def ranks(spark, d):
    return E.evidence_ranks(results(spark, d), expected(spark, d), "item_id")


@query("evidence_ranks", f"WITH {_RANKS} SELECT item_id, target_index, match_rank FROM rk")
def evidence_ranks(spark, d):
    return ranks(spark, d)


@query("evidence_diagnosis", f"""WITH {_RANKS} SELECT item_id, target_index, CASE WHEN item_id % 17 = 0 THEN 'search_failed' WHEN item_id % 13 = 0 THEN 'source_add_failed' WHEN match_rank IS NULL THEN 'no_literal_evidence_match' WHEN match_rank > 5 THEN 'retrieved_below_top5' ELSE 'retrieved' END AS diagnosis FROM rk""")
def evidence_diagnosis(spark, d):
    i = F.col("item_id")
    return ranks(spark, d).select("item_id", "target_index", E.diagnosis(F.col("match_rank"), i % 17 == 0, i % 13 == 0, F.lit(10)).alias("diagnosis"))


_CATEGORY = "CASE item_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' ELSE 'temporal' END"


@query("retrieval_metrics", f"""WITH {_RANKS}, pc AS (SELECT c AS cutoff, item_id, {_CATEGORY} AS grp, count(*) AS t, count(*) FILTER (WHERE match_rank <= c) AS f, max(coalesce(1.0 / match_rank, 0)) AS rr FROM rk, (VALUES (1), (5), (10)) v(c) GROUP BY ALL)
SELECT CAST(cutoff AS BIGINT) AS cutoff, coalesce(grp, 'all') AS "group", CAST(count(*) AS BIGINT) AS eligible_queries, round(sum(f) / sum(t), 6) AS evidence_recall, round(count(*) FILTER (WHERE f > 0) / count(*), 6) AS hit_rate,
round(count(*) FILTER (WHERE f = t) / count(*), 6) AS chain_coverage, round(avg(rr), 6) AS mrr FROM pc GROUP BY GROUPING SETS ((cutoff, grp), (cutoff))""")
def retrieval_metrics(spark, d):
    i = F.col("item_id")
    r = ranks(spark, d).withColumn("category", F.when(i % 3 == 0, "single").when(i % 3 == 1, "multi").otherwise("temporal"))
    return E.retrieval_metrics(r, "item_id", F.lit(10), by="category")


@query("retrieval_metrics_macro", f"""WITH {_RANKS}, p AS (SELECT item_id, count(*) AS t, count(*) FILTER (WHERE match_rank <= 10) AS f FROM rk GROUP BY item_id)
SELECT CAST(count(*) AS BIGINT) AS searches, round(avg(f / t), 6) AS macro_recall, round(count(*) FILTER (WHERE t > 1 AND f = t) / nullif(count(*) FILTER (WHERE t > 1), 0), 6) AS chain_coverage FROM p""")
def retrieval_metrics_macro(spark, d):
    return E.macro_metrics(ranks(spark, d), "item_id", 10)


@query("lexical_study_by_type", f"""WITH {_RANKS}, p AS (SELECT item_id, count(*) AS t, count(*) FILTER (WHERE match_rank <= 5) AS f5, count(*) FILTER (WHERE match_rank <= 10) AS f10 FROM rk GROUP BY item_id)
SELECT {_CATEGORY} AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE f5 > 0) AS BIGINT) AS any5, CAST(count(*) FILTER (WHERE f5 = t) AS BIGINT) AS complete5, CAST(count(*) FILTER (WHERE f10 = t) AS BIGINT) AS complete10 FROM p GROUP BY 1""")
def lexical_study_by_type(spark, d):
    p = ranks(spark, d).groupBy("item_id").agg(F.count("*").alias("t"), F.count_if(F.col("match_rank") <= 5).alias("f5"), F.count_if(F.col("match_rank") <= 10).alias("f10"))
    kind = F.when(F.col("item_id") % 3 == 0, "single").when(F.col("item_id") % 3 == 1, "multi").otherwise("temporal")
    full = lambda c: F.count_if(F.col(c) == F.col("t"))
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("f5") > 0).alias("any5"), full("f5").alias("complete5"), full("f10").alias("complete10"))


@query("duplicate_rate", f"""WITH {_RANKS}, p AS (SELECT item_id, count(*) AS n, count(DISTINCT {duck.signature('text')}) AS u FROM rs GROUP BY item_id)
SELECT CAST(sum(n) AS BIGINT) AS results, CAST(sum(n - u) AS BIGINT) AS duplicates, round(sum(n - u) / sum(n), 6) AS rate FROM p""")
def duplicate_rate(spark, d):
    return E.duplicate_rate(results(spark, d), "item_id", T.signature(F.col("content")))


@query("manifest_grading", f"WITH {_EXPECTED}, c AS (SELECT b.item_id, count(line) AS n FROM benchmark b LEFT JOIN ex ON ex.item_id = b.item_id GROUP BY b.item_id) SELECT item_id, CASE WHEN n > 0 THEN 'evidence' WHEN item_id % 2 = 0 THEN 'empty' ELSE 'ungraded' END AS grading, coalesce(CASE WHEN item_id % 4 = 0 THEN 'cat' END, CASE WHEN item_id % 4 = 1 THEN 'type' END, 'general') AS category, CAST(n AS BIGINT) AS targets FROM c")
def manifest_grading(spark, d):
    i = F.col("item_id")
    n = expected(spark, d).groupBy("item_id").agg(F.count("*").alias("targets"))
    c = table(spark, d, "benchmark").select("item_id").join(n, "item_id", "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    grading = F.when(F.col("targets") > 0, "evidence").when(i % 2 == 0, "empty").otherwise("ungraded")
    category = F.coalesce(F.when(i % 4 == 0, "cat"), F.when(i % 4 == 1, "type"), F.lit("general"))
    return c.select("item_id", grading.alias("grading"), category.alias("category"), "targets")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max_value FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return E.latency(table(spark, d, "events"), "event_type", "value")


@query("latency_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max_value FROM events GROUP BY event_type")
def latency_nearest_rank(spark, d):
    return E.latency_nearest(table(spark, d, "events"), "event_type", "value")


@query("distribution_summary", """WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, CAST(count(*) AS BIGINT) AS n, min(n_chars) AS min_value, median(n_chars) AS median_value, max(CASE WHEN i = (n - 1) * 9 // 10 THEN n_chars END) AS p90, max(n_chars) AS max_value, CAST(sum(n_chars) AS BIGINT) AS total FROM s GROUP BY lang""")
def distribution_summary(spark, d):
    return E.summary(table(spark, d, "documents"), "lang", "n_chars")


@query("corpus_census", f"""SELECT lang, source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(count(*) FILTER (WHERE n_chars > 1800) AS BIGINT) AS long_docs, CAST(count(DISTINCT {duck.signature('text')}) AS BIGINT) AS distinct_texts FROM documents GROUP BY lang, source""")
def corpus_census(spark, d):
    g = table(spark, d, "documents").groupBy("lang", "source")
    return g.agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 1800).alias("long_docs"), F.countDistinct(F.sha2(T.signature(F.col("text")), 256)).alias("distinct_texts"))


@query("key_frequency", "SELECT k AS key, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def key_frequency(spark, d):
    keys = table(spark, d, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


_VERDICTS = "v AS (SELECT event_id // 4 AS answer_id, 'c' || CAST(CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id % 4 END AS VARCHAR) AS criterion, CASE WHEN value < 2 THEN 'uncertain' WHEN value < 40 THEN 'pass' ELSE 'fail' END AS verdict FROM events)"


@query("assessment_rollup", f"""WITH {_VERDICTS} SELECT answer_id, CASE WHEN count(*) <> count(DISTINCT criterion) OR count(DISTINCT criterion) <> 4 THEN 'invalid' WHEN bool_or(verdict = 'uncertain') THEN 'uncertain' WHEN bool_and(verdict = 'pass') THEN 'correct' ELSE 'incorrect' END AS verdict FROM v GROUP BY answer_id""")
def assessment_rollup(spark, d):
    i = F.col("event_id")
    criterion = F.concat(F.lit("c"), F.when(i % 97 == 0, 0).otherwise(i % 4).cast("string"))
    verdict = F.when(F.col("value") < 2, "uncertain").when(F.col("value") < 40, "pass").otherwise("fail")
    v = table(spark, d, "events").select(F.floor(i / 4).alias("answer_id"), criterion.alias("criterion"), verdict.alias("verdict"))
    return E.rollup_assessments(v, "answer_id", F.lit(4))


@query("sum_known", "SELECT user_id, CASE WHEN count(v) = count(*) THEN round(sum(v), 4) END AS total FROM (SELECT user_id, CASE WHEN event_id % 211 <> 0 THEN value END AS v FROM events) GROUP BY user_id")
def sum_known(spark, d):
    v = F.when(F.col("event_id") % 211 != 0, F.col("value"))
    return table(spark, d, "events").select("user_id", v.alias("v")).groupBy("user_id").agg(F.round(E.sum_known(F.col("v")), 4).alias("total"))


@query("campaign_status", """WITH r AS (SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS tokens FROM events GROUP BY user_id)
SELECT run_id, CASE WHEN failed * 5 > n THEN 'failed' WHEN done >= 12 THEN 'completed' WHEN done > 0 THEN 'running' ELSE 'pending' END AS state, CAST(tokens AS BIGINT) AS tokens FROM r""")
def campaign_status(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    r = e.groupBy(F.col("user_id").alias("run_id")).agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count("*").alias("n"), F.sum("k").alias("tokens"))
    state = F.when(F.col("failed") * 5 > F.col("n"), "failed").when(F.col("done") >= 12, "completed").when(F.col("done") > 0, "running").otherwise("pending")
    return r.select("run_id", state.alias("state"), "tokens")


@query("trace_plan_mismatch", """WITH p AS (SELECT event_id FROM events WHERE event_id % 10 <> 3), t AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 2 ELSE 1 END AS n FROM events WHERE event_id % 11 <> 5)
SELECT coalesce(p.event_id, t.event_id) AS event_id, CASE WHEN t.event_id IS NULL THEN 'missing' WHEN p.event_id IS NULL THEN 'unplanned' ELSE 'repeated' END AS problem FROM p FULL JOIN t ON p.event_id = t.event_id WHERE t.event_id IS NULL OR p.event_id IS NULL OR n > 1""")
def trace_plan_mismatch(spark, d):
    e = table(spark, d, "events").select("event_id")
    p = e.where("event_id % 10 <> 3").withColumn("planned", F.lit(True))
    t = e.where("event_id % 11 <> 5").withColumn("n", F.when(F.col("event_id") % 31 == 0, 2).otherwise(1))
    both = p.join(t, "event_id", "full_outer").where("n is null or planned is null or n > 1")
    return both.select("event_id", F.when(F.col("n").isNull(), "missing").when(F.col("planned").isNull(), "unplanned").otherwise("repeated").alias("problem"))


@query("span_validation", f"""WITH {_SPANS} SELECT span_id, array_to_string(list_filter([CASE WHEN ended < started THEN 'ends_before_start' END, CASE WHEN parent_id = span_id THEN 'own_parent' END, CASE WHEN parent_id < 0 THEN 'bad_parent' END, CASE WHEN ended - started > 60000 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS problems
FROM sp WHERE ended < started OR coalesce(parent_id = span_id, FALSE) OR coalesce(parent_id < 0, FALSE) OR ended - started > 60000""")
def span_validation(spark, d):
    s = spans(spark, d)
    rules = {"ends_before_start": F.col("ended") < F.col("started"), "own_parent": F.col("parent_id") == F.col("span_id"), "bad_parent": F.col("parent_id") < 0, "too_long": F.col("ended") - F.col("started") > 60_000}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return s.select("span_id", found.alias("p")).where(F.size("p") > 0).select("span_id", F.array_join("p", ",").alias("problems"))
