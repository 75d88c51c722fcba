"""Scans and the relational surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import ingest as M
from lodestone.plans.numbering import numbered
from lodestone.plans.registry import query, table


@query("scan_parquet", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de' AND n_chars > 1000")
def scan_parquet(spark, d):
    return table(spark, d, "documents").where((F.col("lang") == "de") & (F.col("n_chars") > 1000)).select("doc_id", "lang", "n_chars")


@query("pack_duplicate_ids", "SELECT 'session' AS level, CAST(conv_id AS VARCHAR) AS id, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT conv_id, turn // 4 AS s FROM conversations) GROUP BY conv_id HAVING count(*) > 1 UNION ALL SELECT 'turn', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), CAST(count(*) AS BIGINT) FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1")
def pack_duplicate_ids(spark, d):
    c = table(spark, d, "conversations")
    s = c.select("conv_id", F.floor(F.col("turn") / 4).alias("s")).distinct().select(F.lit("session").alias("level"), F.col("conv_id").cast("string").alias("id"))
    t = c.select(F.lit("turn").alias("level"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))
    return s.unionByName(t).groupBy("level", "id").agg(F.count("*").alias("n")).where("n > 1")


@query("slice_rows", "SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn BETWEEN 101 AND 150")
def slice_rows(spark, d):
    return numbered(table(spark, d, "documents").select("doc_id"), "doc_id", "doc_id", name="rn").where("rn between 101 and 150")


@query("render_node_markdown", "SELECT event_id, '# ' || event_type || ' ' || CAST(event_id AS VARCHAR) || chr(10) || '- user: ' || CAST(user_id AS VARCHAR) || chr(10) || '- day: ' || strftime(ts, '%Y-%m-%d') AS page FROM events")
def render_node_markdown(spark, d):
    return table(spark, d, "events").select("event_id", F.format_string("# %s %d\n- user: %d\n- day: %s", "event_type", "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("page"))


@query("join_inner_filter", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice > 300000")
def join_inner_filter(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000")
    return o.join(table(spark, d, "customer").where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_left_outer", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def join_left_outer(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_undirected", "WITH e AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation) SELECT e.a, e.b, r_name, CASE WHEN e.a = r_regionkey THEN e.b ELSE e.a END AS other FROM e JOIN region ON r_regionkey = e.a OR r_regionkey = e.b")
def join_undirected(spark, d):
    """Edges of a node from either end: the condition's two equalities are two equi-joins."""
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    r = table(spark, d, "region")
    first = e.join(r, e["a"] == r["r_regionkey"]).select("a", "b", "r_name", F.col("b").alias("other"))
    second = e.where("a <> b").join(r, e["b"] == r["r_regionkey"]).select("a", "b", "r_name", F.col("a").alias("other"))
    return first.unionByName(second)


@query("semi_join_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)")
def semi_join_in(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("exists_anti", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def exists_anti(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(li, "s_suppkey", "left_anti").select("s_suppkey")


@query("unnest_json", "SELECT event_id, k AS key, CAST(json_extract(props, '$.' || k) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def unnest_json(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@query("scalar_subquery_greatest", "SELECT doc_id, greatest(n_chars, 500) AS at_least, n_chars > (SELECT avg(n_chars) FROM documents) AS above FROM documents")
def scalar_subquery_greatest(spark, d):
    return spark.sql("SELECT doc_id, greatest(n_chars, 500) AS at_least, n_chars > (SELECT avg(n_chars) FROM {docs}) AS above FROM {docs}", docs=table(spark, d, "documents"))


@query("aggregates_basic", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(props)) AS BIGINT) AS chars, max(event_id) AS last_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), 0) AS last_purchase FROM events GROUP BY user_id")
def aggregates_basic(spark, d):
    bought = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.length("props")).cast("long").alias("chars"), F.max("event_id").alias("last_id"), F.coalesce(bought, F.lit(0)).alias("last_purchase"))


@query("group_by_two", "SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang, source")
def group_by_two(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("distinct_rows", "SELECT DISTINCT event_type, user_id FROM events")
def distinct_rows(spark, d):
    return table(spark, d, "events").select("event_type", "user_id").distinct()


@query("upsert_last_write", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_write(spark, d):
    return M.last_write(table(spark, d, "events"), "user_id", "event_type", order=[F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("order_limit_ties", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def order_limit_ties(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("like_substr_lower", "SELECT c_custkey, lower(substr(c_mktsegment, 1, 4)) AS seg FROM customer WHERE c_name LIKE '%99%'")
def like_substr_lower(spark, d):
    return table(spark, d, "customer").where("c_name like '%99%'").select("c_custkey", F.lower(F.substring("c_mktsegment", 1, 4)).alias("seg"))


@query("delete_rewrite", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_rewrite(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("grouping_sets", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, d):
    g = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return g.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "revenue")
