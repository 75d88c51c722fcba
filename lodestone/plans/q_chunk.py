"""Chunking and range queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunk, interval
from lodestone.operators.retrieve import top_k
from lodestone.plans import duck
from lodestone.plans.registry import query, table
from lodestone.plans.sources import sources

# Deterministic ranges over documents: five per document, some touching, some apart.
_RANGES = """rng AS (SELECT doc_id, k, (doc_id * 37 + k * 131) % 900 AS s, (doc_id * 37 + k * 131) % 900 + 40 + (doc_id + k) % 5 * 60 AS e
  FROM documents, range(5) t(k))"""


def shown(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    s = (F.col("doc_id") * 37 + F.col("k") * 131) % 900
    return r.select("doc_id", "k", s.alias("start"), (s + 40 + (F.col("doc_id") + F.col("k")) % 5 * 60).alias("end"))


_ISLANDS = _RANGES + """, m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM rng),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS island FROM m),
isl AS (SELECT doc_id, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM g GROUP BY doc_id, island)"""


@query("chunk_ranges")
def chunk_ranges(spark, d):
    out = chunk.explode_ranges(table(spark, d, "documents").select("doc_id", "text"), chunk.chunk_ranges("text"))
    return out.select("doc_id", "part", "start", "end", F.sha2("piece", 256).alias("piece_sha"))


@query("passage_ranges")
def passage_ranges(spark, d):
    out = chunk.explode_ranges(table(spark, d, "documents").select("doc_id", "text"), chunk.passage_ranges("text"))
    return out.select("doc_id", "part", "start", "end", F.sha2("piece", 256).alias("piece_sha"))


@query("reading_units")
def reading_units(spark, d):
    out = chunk.explode_ranges(table(spark, d, "documents").select("doc_id", "text"), chunk.unit_ranges("text"))
    return out.select("doc_id", "part", "start", "end", F.sha2("piece", 256).alias("piece_sha"))


@query("add_requests")
def add_requests(spark, d):
    return chunk.add_requests(sources(spark, d), words=120, messages=4)


_HEADED = "CASE WHEN doc_id % 4 = 0 THEN '# Part one' || chr(10) || text WHEN doc_id % 4 = 1 THEN left(text, 100) || chr(10) || 'Steps to take:' || chr(10) || text ELSE text END"
_HEADS = f"""
l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM (SELECT doc_id, {_HEADED} AS t FROM documents)),
x AS (SELECT doc_id, n, trim(regexp_replace(ls[n], '^\\s+|\\s+$', '', 'g')) AS v, list_sum(list_transform(ls[1:n - 1], lambda y: length(y) + 1)) AS before FROM l, range(1, len(ls) + 1) r(n)),
heads AS (SELECT doc_id, CAST(coalesce(before, 0) AS BIGINT) AS start, v AS title FROM x
WHERE v <> '' AND length(v) <= 220 AND (regexp_matches(v, '^#{{1,6}}\\s+\\S') OR (length(v) <= 90 AND regexp_matches(v, '[:：]$')) OR regexp_matches(v, '^.{{0,60}}(#|№)\\d{{3,}}\\b')))"""


def headed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# Part one\n"), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.left("text", F.lit(100)), F.lit("\nSteps to take:\n"), "text")).otherwise(F.col("text"))
    return docs.withColumn("text", t)


@query("headings", f"WITH {_HEADS} SELECT * FROM heads")
def headings(spark, d):
    return chunk.headings(headed(spark, d), "doc_id")


@query("nearest_heading", f"""WITH {_HEADS}, p AS (SELECT doc_id, unnest(range(0, length({_HEADED}), 500)) AS pos FROM documents)
SELECT p.doc_id, CAST(p.pos AS BIGINT) AS pos, h.start AS heading_start, h.title FROM p ASOF LEFT JOIN heads h ON p.doc_id = h.doc_id AND p.pos >= h.start""")
def nearest_heading(spark, d):
    docs = headed(spark, d)
    at = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(500))).alias("pos"))
    both = at.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("k")).unionByName(chunk.headings(docs, "doc_id").select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("k"), "title"), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("k") == 0, F.struct(F.col("pos").alias("s"), "title")), ignorenulls=True).over(w)
    return both.withColumn("h", last).where("k = 1").select("doc_id", "pos", F.col("h.s").alias("heading_start"), F.col("h.title").alias("title"))


@query("range_complement", f"""WITH {_ISLANDS}, t AS (SELECT doc_id, length(text) AS n FROM documents), k AS (SELECT i.doc_id, i.s, least(i.e, n) AS e, n FROM isl i JOIN t ON t.doc_id = i.doc_id AND i.s < n),
b AS (SELECT doc_id, s, e FROM k UNION ALL SELECT doc_id, n, n FROM t),
c AS (SELECT doc_id, s, greatest(0, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM b)
SELECT doc_id, CAST(f AS BIGINT) AS "start", CAST(s AS BIGINT) AS "end" FROM c WHERE f < s""")
def range_complement(spark, d):
    """What the shown ranges leave of each whole text; they end with it."""
    lengths = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("length"))
    within = shown(spark, d).join(lengths, "doc_id").where(F.col("start") < F.col("length"))
    return interval.complement(within.withColumn("end", F.least("end", "length")), lengths, "doc_id")


@query("fixed_overlap_chunks", """
SELECT doc_id, CAST(k AS BIGINT) AS part, CAST(k * 2200 AS BIGINT) AS "start", CAST(length(substring(text, k * 2200 + 1, 2400)) AS BIGINT) AS n_chars
FROM documents, range((SELECT max(length(text)) FROM documents) // 2200 + 2) r(k) WHERE k <= greatest(0, ceil((length(text) - 200) / 2200.0) - 1)""")
def fixed_overlap_chunks(spark, d):
    out = chunk.fixed_windows(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("part").cast("long").alias("part"), F.col("start").cast("long").alias("start"), F.length("piece").cast("long").alias("n_chars"))


@query("fixed_pages", "SELECT doc_id, CAST(k AS BIGINT) AS page, sha256(substring(text, k * 700 + 1, 700)) AS page_sha FROM documents, range((SELECT max(length(text)) FROM documents) // 700 + 1) r(k) WHERE k * 700 < length(text)")
def fixed_pages(spark, d):
    out = chunk.pages(table(spark, d, "documents").select("doc_id", "text"), 700)
    return out.select("doc_id", F.col("part").cast("long").alias("page"), F.sha2("piece", 256).alias("page_sha"))


@query("ranges_complete", f"""WITH {_RANGES}, j AS (SELECT doc_id, e, s <= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ok FROM
  (SELECT doc_id, s, e FROM rng UNION ALL SELECT doc_id, 0, (doc_id * 53) % 1500 FROM documents))
SELECT doc_id, bool_and(ok) AND max(e) >= 1000 AS complete FROM j GROUP BY doc_id""")
def ranges_complete(spark, d):
    docs = table(spark, d, "documents")
    more = shown(spark, d).select("doc_id", "start", "end").unionByName(docs.select("doc_id", F.lit(0).cast("long").alias("start"), (F.col("doc_id") * 53 % 1500).alias("end")))
    return interval.ranges_complete(more, docs.select("doc_id", F.lit(1000).cast("long").alias("length")), "doc_id")


@query("merge_intervals", f'WITH {_ISLANDS} SELECT doc_id, s AS "start", e AS "end" FROM isl')
def merge_intervals(spark, d):
    out = interval.merge_intervals(shown(spark, d), "doc_id")
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("interval_union_contains", f"""WITH {_ISLANDS}, a AS (SELECT doc_id, CAST(k * 200 AS BIGINT) AS s, CAST(k * 200 + 90 AS BIGINT) AS e FROM documents, range(7) r(k))
SELECT a.doc_id, a.s AS "start", a.e AS "end", EXISTS (SELECT 1 FROM isl i WHERE i.doc_id = a.doc_id AND i.s <= a.s AND i.e >= a.e) AS visible FROM a""")
def interval_union_contains(spark, d):
    asked = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1200).cast("long"), F.lit(200).cast("long"))).alias("start"))  # all shown ranges end below 1200
    out = interval.union_contains(shown(spark, d).select("doc_id", "start", "end"), asked.withColumn("end", F.col("start") + 90), "doc_id")
    return out.select("doc_id", "start", "end", "visible")


@query("remap_ranges", """
WITH p AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM conversations),
m AS (SELECT DISTINCT conv_id, 100 AS s, 700 AS e FROM conversations)
SELECT p.conv_id, turn AS part, CAST(greatest(s, o) - o AS BIGINT) AS "start", CAST(least(e, o + n) - o AS BIGINT) AS "end" FROM p JOIN m USING (conv_id) WHERE s < o + n AND o < e""")
def remap_ranges(spark, d):
    c = table(spark, d, "conversations")
    parts = c.select("conv_id", F.col("turn").alias("part"), F.length("text").alias("length"))
    asked = c.select("conv_id").distinct().select("conv_id", F.lit(100).alias("start"), F.lit(700).alias("end"))
    return interval.remap_ranges(parts, asked, "conv_id")


@query("preview_unit", f"""
WITH q AS (SELECT item_id, list_distinct({duck.tokens('text')}) AS toks FROM benchmark),
u AS (SELECT conv_id, turn, text, {duck.tokens('text')} AS ts FROM conversations WHERE role <> 'system'),
o AS (SELECT item_id, conv_id, turn, text, len(list_filter(toks, lambda t: list_contains(ts, t))) AS overlap FROM u, q),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY item_id, conv_id ORDER BY overlap DESC, turn) = 1)
SELECT item_id, conv_id, turn AS "start", CAST(overlap AS BIGINT) AS overlap, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 299) || '…' END AS preview
FROM b WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, conv_id) <= 5""")
def preview_unit(spark, d):
    """Previews of each item's five best conversations of all; items and units meet on the tokens they share."""
    q = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("toks"))
    u = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", F.col("turn").alias("start"), F.col("text").alias("piece"))
    asked = q.select("item_id", F.explode("toks").alias("word"))
    held = u.select("conv_id", "start", F.explode(F.array_distinct(T.tokens(F.col("piece")))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    overlap = held.join(asked, "word").groupBy("item_id", "conv_id", "start").agg(F.count("*").alias("most"))
    best = overlap.groupBy("item_id", "conv_id").agg(F.max("most").alias("most"))
    found = top_k(best, ["item_id"], [F.desc("most"), F.col("conv_id")], 5).select("item_id", "conv_id")
    return chunk.preview(found.join(q, "item_id").join(u, "conv_id"), "item_id", "conv_id", terms="toks")


@query("request_episodes", f"""WITH {duck.SOURCES}, h AS (SELECT *, lag(session_id || role) OVER (PARTITION BY user_id, request_id ORDER BY sequence) AS earlier FROM src)
SELECT user_id, request_id, CAST(count(*) AS BIGINT) AS n_messages, sha256(string_agg(CASE WHEN earlier = session_id || role THEN '' ELSE 'Speaker: ' || role || chr(10) END || text, chr(10) ORDER BY sequence)) AS episode_sha
FROM h GROUP BY ALL""")
def request_episodes(spark, d):
    s = sources(spark, d)
    w = Window.partitionBy("user_id", "request_id").orderBy("sequence")
    mark = F.concat("session_id", "role")
    head = F.when(F.lag(mark).over(w) == mark, F.lit("")).otherwise(F.concat(F.lit("Speaker: "), "role", F.lit("\n")))
    said = s.withColumn("said", F.struct("sequence", F.concat(head, "text").alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("said")), lambda x: x["t"]), "\n")
    return said.groupBy("user_id", "request_id").agg(F.count("*").alias("n_messages"), F.sha2(joined, 256).alias("episode_sha"))
