"""Retrieval and fusion queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.operators import containment
from lodestone.operators import retrieve as R
from lodestone.plans import duck
from lodestone.plans.registry import query, table
from lodestone.sources.shared import written

# Search corpus: documents; queries: the distinct tokens of benchmark texts; one corpus (user).
_DISTINCT = "list_filter({t}, lambda x, i: list_position({t}, x) = i)"


def _bm25_sql(docs: str = "documents", tok=duck.tokens, where: str = "TRUE", most: int = 1 << 30) -> str:
    return f"""d AS (SELECT doc_id, {tok('text')} AS ts FROM {docs} WHERE {where}),
q0 AS (SELECT item_id, {tok('text')} AS ts FROM benchmark),
q AS (SELECT item_id, unnest(({_DISTINCT.format(t='ts')})[1:{most}]) AS term FROM q0),
st AS (SELECT count(*) AS n, greatest(sum(len(ts)) / count(*), 1.0) AS av FROM d),
tf AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / av))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY item_id, doc_id),
bm AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM sc)"""


def bm25_best(spark, d, k, tokens=T.tokens, where=None, most=None, newest=False):
    docs = table(spark, d, "documents").where(F.lit(True) if where is None else where).select("doc_id", tokens(F.col("text")).alias("terms"))
    q = table(spark, d, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("terms"))
    if most is not None:
        q = q.withColumn("terms", F.slice("terms", 1, most))
    return R.bm25_best(docs, q, "doc_id", "item_id", k, newest)


@query("bm25_topk", f"WITH {_bm25_sql()} SELECT item_id, doc_id, score, CAST(rn AS BIGINT) AS rn FROM bm WHERE rn <= 10")
def bm25_topk(spark, d):
    return bm25_best(spark, d, 10)


_CUTOFF = "doc_id <= (SELECT max(doc_id) // 2 FROM documents)"


@query("bm25_before_cutoff", f"WITH {_bm25_sql(where=_CUTOFF)} SELECT item_id, doc_id, score, CAST(rn AS BIGINT) AS rn FROM bm WHERE rn <= 10")
def bm25_before_cutoff(spark, d):
    """Statistics are those of the documents before the cutoff, the middle of the table: the filter comes before the ranking."""
    middle = table(spark, d, "documents").agg(F.floor(F.max("doc_id") / 2).alias("middle")).first()["middle"]
    return bm25_best(spark, d, 10, where=F.col("doc_id") <= F.lit(middle))


_STUDY = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: NOT list_contains({duck.listed(fixed.STUDY_STOP)}, t))"


@query("bm25_lexical_baseline", f"WITH {_bm25_sql(tok=_STUDY)} SELECT item_id, doc_id, score, CAST(rn AS BIGINT) AS rn FROM bm WHERE rn <= 10 AND score > 0")
def bm25_lexical_baseline(spark, d):
    return bm25_best(spark, d, 10, tokens=T.study_tokens).where("score > 0")


_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_VEC = f"""vs AS (SELECT q.vec_id AS query_id, e.vec_id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM vs)"""


def asked_vectors(spark, d):
    """The query set: the vectors that stand for benchmark items, as many as there are items."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    rows = table(spark, d, "embeddings").join(items, "vec_id", "left_semi").select("vec_id", "embedding").collect()
    return [(r["vec_id"], r["embedding"]) for r in rows]


@query("vector_topk", f"WITH {_VEC} SELECT query_id, vec_id, score, CAST(rn AS BIGINT) AS rn FROM vr WHERE rn <= 10")
def vector_topk(spark, d):
    return R.vector_search(table(spark, d, "embeddings"), asked_vectors(spark, d), "vec_id", "embedding", 10)


@query("normalize_vectors", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def normalize_vectors(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, d, "embeddings").where(R.valid_vector(v, 64))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return e.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(norm, 6).alias("norm"))


# Hybrid search: item i asks with its text and with vector i, and vector j stands for document j.
_HYBRID = f"""lex AS (SELECT item_id AS query_id, doc_id, rn FROM bm WHERE rn <= 48),
sem AS (SELECT query_id, vec_id AS doc_id, rn FROM vr WHERE rn <= 48),
ch AS (SELECT * FROM lex UNION ALL SELECT * FROM sem),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rn)), 6) AS score FROM ch GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM fused)"""


def channels(spark, d):
    lex = bm25_best(spark, d, fixed.CHANNEL_DEPTH).withColumnRenamed("item_id", "query_id")
    sem = R.vector_search(table(spark, d, "embeddings"), asked_vectors(spark, d), "vec_id", "embedding", fixed.CHANNEL_DEPTH).withColumnRenamed("vec_id", "doc_id")
    return lex, sem


@query("rrf_hybrid", f"WITH {_bm25_sql()}, {_VEC}, {_HYBRID} SELECT query_id, doc_id, score, CAST(rn AS BIGINT) AS rn FROM rrf WHERE rn <= 10")
def rrf_hybrid(spark, d):
    return R.ranked(R.rrf(list(channels(spark, d)), "query_id", "doc_id"), "query_id", "doc_id", 10)


_BRANCHES = f"""br AS (SELECT query_id, 0 AS branch, doc_id, rn FROM lex UNION ALL SELECT query_id, 1, doc_id, rn FROM sem)"""


@query("interleave_branches", f"""WITH {_bm25_sql()}, {_VEC}, {_HYBRID}, {_BRANCHES},
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rn, branch) AS i FROM br WHERE rn <= 10)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rn, branch) AS BIGINT) AS rn FROM f WHERE i = 1""")
def interleave_branches(spark, d):
    lex, sem = channels(spark, d)
    both = lex.select("query_id", F.lit(0).alias("branch"), "doc_id", "rn").unionByName(sem.select("query_id", F.lit(1).alias("branch"), "doc_id", "rn"))
    return R.interleave(both.where("rn <= 10"), "query_id", "doc_id").drop("routes")


@query("rrf_multi_branch", f"""WITH {_bm25_sql()}, {_VEC}, {_HYBRID}, {_BRANCHES},
b2 AS (SELECT * FROM br UNION ALL SELECT query_id - 10, 2, doc_id, rn FROM lex WHERE query_id >= 10),
s AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rn)), 6) AS score, array_to_string(list_sort(list(CAST(branch AS VARCHAR) || '#' || CAST(rn AS VARCHAR))), ',') AS lineage FROM b2 GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, lineage, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rn FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 24""")
def rrf_multi_branch(spark, d):
    lex, sem = channels(spark, d)
    parts = [lex.select("query_id", "doc_id", "rn", F.lit(0).alias("branch")), sem.select("query_id", "doc_id", "rn", F.lit(1).alias("branch"))]
    parts.append(lex.where("query_id >= 10").select((F.col("query_id") - 10).alias("query_id"), "doc_id", "rn", F.lit(2).alias("branch")))
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    lineage = F.array_join(F.array_sort(F.collect_list(F.concat_ws("#", F.col("branch").cast("string"), F.col("rn").cast("string")))), ",")
    scored = union.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (fixed.RRF_K + F.col("rn"))), 6).alias("score"), lineage.alias("lineage"))
    return R.top_k(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], fixed.CANDIDATES)


@query("query_centroid", """
WITH s AS (SELECT label AS slice_of, vec_id, CAST(vec_id % 7 + 1 AS DOUBLE) AS w, embedding FROM embeddings),
f AS (SELECT slice_of, CAST(i - 1 AS BIGINT) AS pos, sum(CAST(embedding[i] AS DOUBLE) * w) AS s FROM s, range(1, 65) r(i) GROUP BY ALL)
SELECT slice_of, pos, round(s / sqrt(sum(s * s) OVER (PARTITION BY slice_of)), 6) AS value FROM f""")
def query_centroid(spark, d):
    s = table(spark, d, "embeddings").select(F.col("label").alias("slice_of"), (F.col("vec_id") % 7 + 1).cast("double").alias("w"), "embedding")
    return R.centroid(s, "slice_of", "embedding", "w").withColumn("pos", F.col("pos").cast("long"))


# Chunked vectors: vector v is a chunk of node v % 100.
@query("semantic_best_chunk", f"""WITH {_VEC}, b AS (SELECT query_id, vec_id % 100 AS node, max(score) AS sim FROM vs GROUP BY ALL)
SELECT query_id, node, round(greatest(0.0, least(1.0, (sim + 1) / 2)) + 1e-9, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node DESC) AS BIGINT) AS rn FROM b
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node DESC) <= 10""")
def semantic_best_chunk(spark, d):
    hits = R.vector_search(table(spark, d, "embeddings"), asked_vectors(spark, d), "vec_id", "embedding", 1, group=100)
    best = hits.select("query_id", "node", F.col("score").alias("sim"))
    out = R.top_k(best, ["query_id"], [F.desc("sim"), F.desc("node")], 10)
    return out.select("query_id", "node", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sim") + 1) / 2)) + 1e-9, 5).alias("score"), "rn")


@query("vector_best_passage", f"""WITH {_VEC}, p AS (SELECT query_id, vec_id % 50 AS node, vec_id, score, row_number() OVER (PARTITION BY query_id, vec_id % 50 ORDER BY score DESC, vec_id) AS i FROM vs WHERE score > 0),
n AS (SELECT query_id, node, max(score) AS best, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY i) AS passages FROM p WHERE i <= 3 GROUP BY ALL)
SELECT query_id, node, passages, round(1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY best DESC, node)), 6) AS score FROM n""")
def vector_best_passage(spark, d):
    top = R.vector_search(table(spark, d, "embeddings"), asked_vectors(spark, d), "vec_id", "embedding", 3, group=50).where("score > 0").withColumnRenamed("rn", "i")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",")
    nodes = top.groupBy("query_id", "node").agg(F.max("score").alias("best"), ids.alias("passages"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "node"))
    return nodes.select("query_id", "node", "passages", F.round(1.0 / (fixed.RRF_K + rn), 6).alias("score"))


_FEATURES = """ft AS (SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'fact' WHEN 2 THEN 'entity' ELSE 'concept' END AS kind,
  coalesce(l.quality, 0) * 0.8 AS confidence, d.doc_id % 13 AS activity, CASE WHEN d.doc_id % 5 = 0 THEN 'superseded' ELSE 'active' END AS status,
  'c' || lpad(CAST(d.doc_id % 97 AS VARCHAR), 3, '0') AS created_at, CASE WHEN d.doc_id % 4 <> 0 THEN 's' || CAST(d.doc_id % 211 AS VARCHAR) END AS grp
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def features(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    f = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "daily").when(i % 4 == 1, "fact").when(i % 4 == 2, "entity").otherwise("concept")
    return f.select(
        "doc_id",
        kind.alias("kind"),
        (F.coalesce("quality", F.lit(0)) * 0.8).alias("confidence"),
        (i % 13).alias("activity"),
        F.when(i % 5 == 0, "superseded").otherwise("active").alias("status"),
        F.concat(F.lit("c"), F.lpad((i % 97).cast("string"), 3, "0")).alias("created_at"),
        F.when(i % 4 != 0, F.concat(F.lit("s"), i % 211)).alias("group_key"),
    )


@query("weighted_fusion", f"""WITH {_bm25_sql()}, {_VEC}, {_HYBRID}, {_FEATURES},
tmp AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rn FROM lex WHERE rn <= 12),
u AS (SELECT query_id, doc_id, 1.0 / (60 + rn) AS p FROM lex UNION ALL SELECT query_id, doc_id, 0.9 / (60 + rn) FROM sem UNION ALL SELECT query_id, doc_id, 0.85 / (60 + rn) FROM tmp),
r AS (SELECT query_id, u.doc_id, sum(p) AS p, any_value(kind) AS kind, any_value(confidence) AS confidence, any_value(activity) AS activity, any_value(status) AS status, any_value(created_at) AS created_at, any_value(grp) AS grp
  FROM u LEFT JOIN ft ON u.doc_id = ft.doc_id GROUP BY query_id, u.doc_id),
s AS (SELECT query_id, doc_id, created_at, coalesce(grp, CAST(doc_id AS VARCHAR)) AS grp, round(p + CASE WHEN kind IS NULL THEN 0.0 ELSE
  CASE kind WHEN 'daily' THEN 0.0035 WHEN 'fact' THEN 0.003 WHEN 'entity' THEN 0.001 ELSE 0.0005 END + greatest(0.0, least(confidence, 1.0)) * 0.001 + least(activity / 10.0, 1.0) * 0.001 + CASE WHEN status = 'active' THEN 0.0015 ELSE 0.0005 END END, 9) AS raw FROM r),
n AS (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, row_number() OVER (PARTITION BY query_id, grp ORDER BY raw DESC, coalesce(created_at, '') DESC, doc_id DESC) AS g FROM s)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, coalesce(created_at, '') DESC, doc_id DESC) AS BIGINT) AS rn FROM n WHERE g = 1
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, coalesce(created_at, '') DESC, doc_id DESC) <= 10""")
def weighted_fusion(spark, d):
    lex, sem = channels(spark, d)
    recent = lex.where("rn <= 12").withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_id"))))
    return R.weighted_fusion({"lexical": lex, "semantic": sem, "temporal": recent}, features(spark, d), "query_id", "doc_id")


@query("fact_evidence_boost", f"""WITH {_bm25_sql()}, {_VEC}, {_HYBRID},
par AS (SELECT query_id, doc_id, rn - 1 AS pr FROM rrf WHERE rn <= 12 AND doc_id % 4 = 1),
b AS (SELECT query_id, (doc_id + 2 + k) AS doc_id, sum(0.012 / (1.0 + pr * 0.25) / (1.0 + k * 0.25)) AS bonus FROM par, range(4) r(k) GROUP BY ALL)
SELECT query_id, doc_id, round(score + coalesce(bonus, 0.0), 6) AS score FROM rrf LEFT JOIN b USING (query_id, doc_id)""")
def fact_evidence_boost(spark, d):
    fused = R.ranked(R.rrf(list(channels(spark, d)), "query_id", "doc_id"), "query_id", "doc_id", 1 << 20)
    near = F.array(*[F.col("doc_id") + 2 + k for k in range(5)])
    parents = fused.where("rn <= 12").select("query_id", (F.col("rn") - 1).alias("parent_rank"), F.when(F.col("doc_id") % 4 == 1, "fact").otherwise("daily").alias("kind"), near.alias("sources"))
    out = R.fact_boost(fused.drop("rn"), parents, "query_id", "doc_id")
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("evidence_group_key", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'sources|' || array_to_string(list_sort(list_distinct([source, lang, source])), '|') ELSE CASE WHEN doc_id % 8 = 0 THEN 'group' ELSE CAST(doc_id AS VARCHAR) END END AS group_key FROM documents""")
def evidence_group_key(spark, d):
    kind = F.when(F.col("doc_id") % 4 == 0, "daily").otherwise("fact")
    group = F.when(F.col("doc_id") % 8 == 0, "group")
    return table(spark, d, "documents").select("doc_id", R.evidence_group_key(kind, F.array("source", "lang", "source"), group, F.col("doc_id").cast("string")).alias("group_key"))


@query("rank_graph_paths", """
WITH p AS (SELECT user_id AS query_id, [event_id, event_id + 1, event_id + 2][1:CAST(event_id % 3 AS INTEGER) + 1] AS path, value / 100 AS score, (event_id % 10) / 10.0 AS qr, (event_id % 4) / 4.0 AS rr, event_id % 3 AS hop, event_id % 6 AS ns FROM events),
s AS (SELECT query_id, path[i] AS node, coalesce(score, 0.0) + 0.2 * qr + 0.1 * rr + 0.08 * greatest(0, hop - 1) + 0.08 * (least(ns, 4) / 4.0) - 0.005 * (i - 2) AS v FROM p, range(2, 4) r(i) WHERE i <= len(path))
SELECT query_id, node, round(max(v), 6) AS score FROM s GROUP BY ALL""")
def rank_graph_paths(spark, d):
    i = F.col("event_id")
    path = F.slice(F.array(i, i + 1, i + 2), F.lit(1), (i % 3).cast("int") + 1)
    p = table(spark, d, "events").select(F.col("user_id").alias("query_id"), path.alias("path"), (F.col("value") / 100).alias("score"), (i % 10 / 10.0).alias("query_relevance"), (i % 4 / 4.0).alias("relation_relevance"), (i % 3).alias("hop"), (i % 6).alias("n_sources"))
    return R.rank_paths(p, "query_id")


_LIKE = f"""q AS (SELECT item_id, ({duck.query_tokens('text')})[1:5] AS toks FROM benchmark),
h AS (SELECT item_id, doc_id FROM q, documents WHERE len(list_filter(toks, lambda t: contains(lower(text), t))) > 0)"""


@query("like_fallback_search", f"""WITH {_LIKE} SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) AS BIGINT) AS rn FROM h
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) <= 20""")
def like_fallback_search(spark, d):
    """Newest documents that hold any of the first five query tokens as a substring."""
    q = table(spark, d, "benchmark").select("item_id", F.slice(T.query_tokens(F.col("text")), 1, 5).alias("toks"), F.lower("text").alias("asked"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    any_held = lambda hits, sizes, phrase, refs: np.where(hits > 0, 1.0, -np.inf)
    return containment.best_by_tokens(docs, q, "item_id", "doc_id", 20, any_held, newest=True).select("item_id", "doc_id", "rn")


@query("lexical_search_gen1", f"""WITH {_bm25_sql()},
c AS (SELECT bm.item_id, bm.doc_id, bm.rn - 1 AS idx, q.text AS question, d.text, {duck.query_tokens('q.text')} AS toks FROM bm JOIN benchmark q ON bm.item_id = q.item_id JOIN documents d ON d.doc_id = bm.doc_id WHERE bm.rn <= 30),
s AS (SELECT item_id, doc_id, round(greatest(0.0, least(1.0, 0.4 + 0.45 * (len(list_filter(toks, lambda t: contains(lower(text), t))) / len(toks)) + CASE WHEN contains(lower(text), lower(question)) THEN 0.15 ELSE 0.0 END - least(idx * 0.0025, 0.15) + 1e-9)), 6) AS score FROM c)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS BIGINT) AS rn FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) <= 10""")
def lexical_search_gen1(spark, d):
    """Full-text candidates (three times the answer), rescored by coverage, phrase and position."""
    found = written(bm25_best(spark, d, 30), "found")
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    rows = found.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(q, "item_id")
    s = rows.select("item_id", "doc_id", T.lexical_score(F.col("question"), F.col("text"), F.col("rn") - 1).alias("score"))
    return R.top_k(s, ["item_id"], [F.desc("score"), F.desc("doc_id")], 10)


@query("search_gen1_pipeline")
def search_gen1_pipeline(spark, d):
    """Lexical, semantic and temporal channels with graph paths over documents of one source, fused by weight."""
    lex, sem = channels(spark, d)
    i = F.col("doc_id")
    recent = lex.where("rn <= 12").withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_id"))))
    paths = lex.where("rn <= 8").select("query_id", F.array(i, i + 20, i + 40).alias("path"), (1 / (fixed.RRF_K + F.col("rn"))).alias("score"), F.lit(0.5).alias("query_relevance"), F.lit(0.5).alias("relation_relevance"), F.lit(2).alias("hop"), F.lit(1).alias("n_sources"))
    walked = R.top_k(R.rank_paths(paths, "query_id").withColumnRenamed("node", "doc_id"), ["query_id"], [F.desc("score"), F.col("doc_id")], fixed.CHANNEL_DEPTH)
    return R.weighted_fusion({"lexical": lex, "semantic": sem, "temporal": recent, "path": walked}, features(spark, d), "query_id", "doc_id", intent="multi_hop")


@query("search_pipeline", f"WITH {_bm25_sql()}, {_VEC}, {_HYBRID} SELECT query_id, doc_id, score, CAST(rn AS BIGINT) AS rn, sha256(text) AS text_sha FROM rrf JOIN documents USING (doc_id) WHERE rn <= 5")
def search_pipeline(spark, d):
    """All queries in one job: hybrid ranking, then the delivered texts."""
    top = written(R.ranked(R.rrf(list(channels(spark, d)), "query_id", "doc_id"), "query_id", "doc_id", 5), "found")
    texts = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    return top.join(texts, "doc_id").select("query_id", "doc_id", "score", "rn", "text_sha")
