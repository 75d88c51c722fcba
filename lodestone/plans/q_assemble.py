"""Evidence assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.operators import assemble as A
from lodestone.operators import retrieve as R
from lodestone.plans import duck
from lodestone.plans.q_retrieve import _bm25_sql, bm25_best
from lodestone.plans.registry import query, table
from lodestone.sources.shared import written


def turns(spark, d):
    """Conversation turns as passages of their sessions, one range per turn."""
    c = table(spark, d, "conversations")
    ref = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", "text", F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("sequence"), F.lit(0).alias("start"), F.length("text").alias("end"), F.length("text").alias("source_length"), ref.alias("ref"))


def ranked_docs(spark, d, k=48):
    return bm25_best(spark, d, k).withColumnRenamed("item_id", "query_id")


@query("disclose_candidates")
def disclose_candidates(spark, d):
    """Each ranked document stands for itself and two documents its note links to."""
    i = F.col("doc_id")
    n = table(spark, d, "documents").count()
    targets = F.transform(F.array(i, (i + 7) % n, (i + 20) % n), lambda x: x.cast("string"))
    return A.disclose(ranked_docs(spark, d).select("query_id", "rn", i.cast("string").alias("entry"), targets.alias("targets")))


@query("adjacent_passages", """
SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def adjacent_passages(spark, d):
    out = A.adjacent(turns(spark, d))
    turn = lambda c: F.element_at(F.split(c, "/"), 2).cast("long")
    return out.select("conv_id", "turn", turn("prev_ref").alias("prev_turn"), turn("next_ref").alias("next_turn"))


@query("source_backlinks", """
WITH n AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn // 3 AS VARCHAR) AS note, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS ref FROM conversations)
SELECT DISTINCT a.ref, b.ref AS other FROM n a JOIN n b ON a.note = b.note AND a.ref <> b.ref""")
def source_backlinks(spark, d):
    c = table(spark, d, "conversations")
    note = F.concat_ws(":", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 3).cast("string"))
    return A.backlinks(c.select(note.alias("note"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref")))


@query("context_expansion", f"""WITH {_bm25_sql()},
p AS (SELECT item_id AS query_id, doc_id AS ref, rn FROM bm WHERE rn <= 24),
l AS (SELECT doc_id AS ref, doc_id + k AS other, 'adjacent' AS kind FROM documents, (VALUES (-1), (1)) t(k) UNION ALL SELECT doc_id, (doc_id + 20) % (SELECT count(*) FROM documents), 'backlink' FROM documents),
cq AS (SELECT query_id, rn AS parent, other, kind, row_number() OVER (PARTITION BY query_id, p.ref ORDER BY kind, other) AS turn FROM p JOIN l USING (ref) WHERE rn <= 6),
f AS (SELECT * FROM cq WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = cq.query_id AND p.ref = cq.other) QUALIFY row_number() OVER (PARTITION BY query_id, other ORDER BY turn, parent) = 1),
b AS (SELECT query_id, ref, rn AS place, 'matched_entry' AS reason FROM p UNION ALL SELECT query_id, other, 1000000 + turn * 1000 + parent, kind FROM f)
SELECT query_id, ref, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, ref) AS BIGINT) AS rn, reason FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, ref) <= 48""")
def context_expansion(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    near = docs.select(F.col("doc_id").alias("ref"), F.explode(F.array(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("other"), F.lit("adjacent").alias("kind"))
    back = docs.select(F.col("doc_id").alias("ref"), ((F.col("doc_id") + 20) % docs.count()).alias("other"), F.lit("backlink").alias("kind"))
    primary = written(ranked_docs(spark, d, fixed.CANDIDATES).select("query_id", F.col("doc_id").alias("ref"), "rn"), "found")
    return A.context_expansion(primary, near.unionByName(back))


@query("context_closure", f"""
WITH c AS (SELECT *, turn % 2 = 1 AS sel, lag(turn) OVER w AS p, lag(turn % 2 = 1) OVER w AS ps FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, p AS added_turn FROM c WHERE sel AND p IS NOT NULL AND NOT coalesce(ps, FALSE)
  AND {duck.squeeze('text')} <> '' AND ({duck.matches(duck.squeeze('text'), fixed.PRONOUN)} OR {duck.matches(duck.squeeze('text'), fixed.SHORT_OPENING)})""")
def context_closure(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = A.context_closure(c, c.where("turn % 2 = 1"), "conv_id", order="turn")
    return out.withColumnRenamed("added", "added_turn")


# A turn is a passage, its lines are units; odd turns were selected by their first and third line, system turns were not disclosed.
@query("closure_across_episodes", f"""
WITH u AS (SELECT conv_id, turn, role, i - 1 AS unit, string_split(text, chr(10))[i] AS line FROM conversations, range(1, (SELECT max(length(text)) FROM conversations) + 2) r(i) WHERE i <= len(string_split(text, chr(10)))),
l AS (SELECT conv_id, turn, max(unit) AS last FROM u GROUP BY ALL),
s AS (SELECT * FROM u WHERE turn % 2 = 1 AND unit IN (0, 2) AND {duck.squeeze('line')} <> '' AND ({duck.matches(duck.squeeze('line'), fixed.PRONOUN)} OR {duck.matches(duck.squeeze('line'), fixed.SHORT_OPENING)})),
v AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'system' OR turn % 2 = 1),
f AS (SELECT conv_id, turn, unit, turn AS added_turn, unit - 1 AS added_unit, 'same_episode' AS scope FROM s WHERE unit > 0
  UNION ALL SELECT s.conv_id, s.turn, s.unit, v.before, l.last, 'adjacent_episode' FROM s JOIN v ON v.conv_id = s.conv_id AND v.turn = s.turn JOIN l ON l.conv_id = s.conv_id AND l.turn = v.before
    JOIN conversations b ON b.conv_id = s.conv_id AND b.turn = v.before AND b.role <> 'system' WHERE s.unit = 0)
SELECT conv_id, turn, CAST(unit AS BIGINT) AS unit, added_turn, CAST(added_unit AS BIGINT) AS added_unit, scope FROM f WHERE NOT (added_turn % 2 = 1 AND added_unit IN (0, 2))
QUALIFY row_number() OVER (PARTITION BY conv_id, added_turn, added_unit ORDER BY turn * 10 + unit) = 1""")
def closure_across_episodes(spark, d):
    c = table(spark, d, "conversations").withColumn("ref", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    lines = c.select("ref", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("unit", "text"))
    selected = lines.where("turn % 2 = 1 and unit in (0, 2)").select(F.col("conv_id").alias("query_id"), (F.col("turn") * 10 + F.col("unit")).alias("rn"), "ref", "unit")
    passages = c.select("ref", F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence"), F.lit(0).alias("start"), F.length("text").alias("end"))
    out = A.closure_across(selected, c.where("role <> 'system'").select(F.col("conv_id").alias("query_id"), "ref"), passages, lines.select("ref", "unit", "text"))
    turn = lambda r: F.split_part(r, F.lit("/"), F.lit(2)).cast("long")
    return out.select(F.col("query_id").alias("conv_id"), turn(F.col("ref")).alias("turn"), F.col("unit").cast("long").alias("unit"), turn(F.col("added_ref")).alias("added_turn"), F.col("added_unit").cast("long").alias("added_unit"), "scope")


def units(spark, d):
    """The ranked documents' first units with their cost."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    top = written(ranked_docs(spark, d, 30), "found").join(docs, "doc_id")
    return top.select("query_id", "rn", F.col("doc_id").cast("string").alias("ref"), F.lit(0).alias("start"), F.col("n").cast("long").alias("cost"))


@query("pack_evidence")
def pack_evidence(spark, d):
    return A.pack(units(spark, d))


@query("pack_prefix_budget", f"""WITH {_bm25_sql()},
c AS (SELECT item_id AS query_id, rn, bm.doc_id, sum(length(text) + 64) OVER (PARTITION BY item_id ORDER BY rn) AS running FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rn <= 30)
SELECT query_id, CAST(rn AS BIGINT) AS rn, CAST(doc_id AS VARCHAR) AS ref, CAST(running AS BIGINT) AS running FROM c WHERE running <= {fixed.PACK_BUDGET}""")
def pack_prefix_budget(spark, d):
    return A.pack_prefix(units(spark, d)).select("query_id", "rn", "ref", "running")


@query("near_duplicate_notes", f"""
WITH t AS (SELECT conv_id, turn, list_distinct({duck.tokens('text')}) AS ts FROM conversations),
f AS (SELECT conv_id, turn, len(ts) AS n, unnest(ts) AS w FROM t)
SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, round(count(*) / least(a.n, b.n), 6) AS similarity
FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn < b.turn GROUP BY a.conv_id, a.turn, b.turn, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.8""")
def near_duplicate_notes(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("terms"))
    out = A.near_duplicate_notes(c, "conv_id", "turn", "terms")
    return out.withColumnsRenamed({"a": "turn_a", "b": "turn_b"})


@query("assemble_state_groups")
def assemble_state_groups(spark, d):
    rows = units(spark, d).withColumn("component", F.col("ref").cast("long") % 11).withColumn("status", F.when(F.col("ref").cast("long") % 7 == 0, "superseded").otherwise("active"))
    return A.assemble_states(rows, 20_000)
