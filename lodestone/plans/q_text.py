"""Scalar text queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.operators import containment as X
from lodestone.operators.retrieve import six_digits
from lodestone.plans import duck
from lodestone.plans.registry import query, table

# Phrases that exercise the cue functions; the driver's texts are invented words.
PHRASES = [
    "What did I say before?", "When is the trip", "Where am I currently", "Why did it fail", "Please forget my address.",
    "What else besides tea", "Compare both plans", "Who is her friend", "Actually, I changed my plan", "Do not forget this",
    "how many in total", "update my phone", "现在哪里", "忘记全部记录", "Is it 3.5 or 42", "yes, they did",
]
SAID = f"{duck.listed(PHRASES)}[CAST(doc_id % {len(PHRASES)} AS INTEGER) + 1] || ' ' || text"


def said(spark, d):
    """documents with ``q``, a phrase and the whole text."""
    docs = table(spark, d, "documents")
    phrase = F.element_at(T.words_in(PHRASES), (F.col("doc_id") % len(PHRASES)).cast("int") + 1)
    return docs.withColumn("q", F.concat(phrase, F.lit(" "), "text"))


@query("tokenize_documents", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, {duck.tokens('text')} AS t FROM documents)""")
def tokenize_documents(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("terms_ascii", f"""
SELECT doc_id, sha256(array_to_string(t, ' ')) AS terms_sha, CAST(len(t) AS BIGINT) AS n_terms FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains({duck.listed(fixed.TERM_STOP)}, t)) AS t FROM documents)""")
def terms_ascii(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.terms_ascii(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha2(F.array_join("t", " "), 256).alias("terms_sha"), F.size("t").cast("long").alias("n_terms"))


@query("tokens_lexical_study", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains({duck.listed(fixed.STUDY_STOP)}, t)) AS t FROM documents)""")
def tokens_lexical_study(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.study_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"))


@query("query_tokens_gen1", f"""
SELECT item_id, array_to_string({duck.query_tokens('text')}, ' ') AS query_tokens FROM benchmark""")
def query_tokens_gen1(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("query_tokens"))


@query("excerpt_text", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 199) || '…' END AS excerpt FROM documents")
def excerpt_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text"), 200).alias("excerpt"))


@query("excerpt_query", """
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE CASE WHEN start > 0 THEN '…' ELSE '' END || substring(text, start + 1, 280) || '… [片段截断]' END AS excerpt
FROM (SELECT doc_id, text, greatest(0, coalesce(list_min(list_filter(list_transform(['tion', 'ment', 'und'], lambda t: strpos(lower(text), t)), lambda p: p > 0)), 1) - 1 - 75) AS start FROM documents)""")
def excerpt_query(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt_around(F.col("text"), T.words_in(["tion", "ment", "und"]), 300).alias("excerpt"))


@query("excerpt_head_tail", "SELECT doc_id, CASE WHEN length(text) <= 150 THEN text ELSE left(text, 100) || '…' || right(text, 50) END AS excerpt FROM documents")
def excerpt_head_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt_head_tail(F.col("text"), 100, 50).alias("excerpt"))


@query("label_slug", """
SELECT doc_id, CASE WHEN l = '' THEN 'record' ELSE l END AS label, left(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 36) AS slug
FROM (SELECT doc_id, text, left(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:9], '-'), 64) AS l FROM documents)""")
def label_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", T.label(F.col("text")).alias("label"), T.slug(F.col("text")).alias("slug"))


@query("source_time_label", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown (do not infer a date)' ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S+00:00') END AS label,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso
FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)""")
def source_time_label(spark, d):
    ms = F.when(F.col("event_id") % 7 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", T.source_time(ms).alias("label"), T.iso_millis(ms).alias("iso"))


@query("payload_digest", """
SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS digest FROM conversations""")
def payload_digest(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.payload_digest(conv_id=F.col("conv_id"), role=F.col("role"), turn=F.col("turn")).alias("digest"))


@query("stable_ids", f"""
SELECT doc_id, 'ent_' || left(sha256({duck.signature('source')} || chr(31) || {duck.signature('text')}), 32) AS entity_id FROM documents""")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_id("ent", F.col("source"), F.col("text")).alias("entity_id"))


@query("content_signature_dups", f"""
SELECT sha256({duck.signature('text')}) AS signature_sha, CAST(count(*) AS BIGINT) AS n_docs, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_signature_dups(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2(T.signature(F.col("text")), 256).alias("signature_sha"))
    return t.groupBy("signature_sha").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id")).where("n_docs > 1")


_SCORED = f"""
WITH q AS (SELECT item_id, lower(text) AS question, {duck.query_tokens('text')} AS toks FROM benchmark),
d AS (SELECT doc_id, lower(text) AS low, doc_id % 80 AS idx FROM documents),
p AS (SELECT item_id, doc_id, question, toks, low, idx, len(list_filter(toks, lambda t: contains(low, t))) AS hits FROM q, d),
"""
_BEST = "SELECT item_id, doc_id, {v}, CAST(row_number() OVER (PARTITION BY item_id ORDER BY {v} DESC, doc_id) AS BIGINT) AS rn FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY {v} DESC, doc_id) <= 10"


def best_of_all(spark, d, score):
    q = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("asked"), T.query_tokens(F.col("text")).alias("toks"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return X.best_by_tokens(docs, q, "item_id", "doc_id", 10, score)


def share(hits, sizes):
    return hits / np.maximum(sizes, 1)


@query("lexical_score_gen1", _SCORED + """
s AS (SELECT item_id, doc_id, round(greatest(0.0, least(1.0, 0.4 + 0.45 * (hits / len(toks)) + CASE WHEN contains(low, question) THEN 0.15 ELSE 0.0 END - least(idx * 0.0025, 0.15) + 1e-9)), 6) AS score FROM p)
""" + _BEST.format(v="score"))
def lexical_score_gen1(spark, d):
    """Only a document with all tokens of a question can hold it as a phrase; one without any scores by its place alone."""

    def score(hits, sizes, phrase, refs):
        raw = 0.4 + 0.45 * share(hits, sizes) + np.where(phrase, 0.15, 0.0) - np.minimum(np.fmod(refs, 80) * 0.0025, 0.15)[:, None] + 1e-9
        return six_digits(np.clip(raw, 0.0, 1.0))

    return best_of_all(spark, d, score)


@query("query_relevance", _SCORED + "s AS (SELECT item_id, doc_id, round(hits / len(toks), 6) AS relevance FROM p) " + _BEST.format(v="relevance"))
def query_relevance(spark, d):
    out = best_of_all(spark, d, lambda hits, sizes, phrase, refs: six_digits(share(hits, sizes)))
    return out.withColumnRenamed("score", "relevance")


@query("classify_intent", f"SELECT doc_id, CASE {' '.join(f'WHEN {duck.matches('q', p)} THEN {duck.text(n)}' for n, p in fixed.INTENTS)} ELSE 'general' END AS intent FROM (SELECT doc_id, {SAID} AS q FROM documents)")
def classify_intent(spark, d):
    return said(spark, d).select("doc_id", T.intent(F.col("q")).alias("intent"))


@query("task_shape_flags", f"""
SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {duck.any_of('q', m)} THEN {duck.text(n)} END" for n, m in fixed.SHAPES.items())}], lambda x: x IS NOT NULL), ',') AS shapes
FROM (SELECT doc_id, lower({SAID}) AS q FROM documents)""")
def task_shape_flags(spark, d):
    return said(spark, d).select("doc_id", F.array_join(T.shapes(F.col("q")), ",").alias("shapes"))


@query("query_purpose", f"SELECT doc_id, CASE {' '.join(f'WHEN {duck.any_of('q', m)} THEN {duck.text(n)}' for n, m in fixed.PURPOSES)} ELSE 'other' END AS purpose FROM (SELECT doc_id, lower({SAID} || ' ') AS q FROM documents)")
def query_purpose(spark, d):
    return said(spark, d).select("doc_id", T.purpose(F.col("q"), F.lit("")).alias("purpose"))


@query("forget_commands", f"SELECT doc_id, {duck.matches('q', fixed.DIRECT_FORGET)} AS is_command FROM (SELECT doc_id, {SAID} AS q FROM documents)")
def forget_commands(spark, d):
    return said(spark, d).select("doc_id", T.matches(F.col("q"), fixed.DIRECT_FORGET).alias("is_command"))


@query("forget_authorized", f"""
SELECT doc_id, NOT regexp_matches(v, '^[\\[{{]') AND q <> '' AND starts_with(v, q) AND {duck.matches('q', fixed.DIRECT_QUOTE)} AND length(q) >= length(f) AND NOT {duck.matches('f', fixed.NEGATED)} AS authorized
FROM (SELECT doc_id, v, q, trim(regexp_extract(v, '^([^.!?。！？\\n]*[.!?。！？]?)', 1)) AS f FROM (SELECT doc_id, trim({SAID}) AS v, trim(left({SAID}, 25)) AS q FROM documents))""")
def forget_authorized(spark, d):
    return said(spark, d).select("doc_id", T.forget_authorized(F.col("q"), F.left("q", F.lit(25))).alias("authorized"))


@query("change_cues", f"""
SELECT doc_id, {', '.join(f'{duck.matches("q", p)} AS {n}' for n, p in [('change', fixed.CHANGE), ('is_complex', fixed.COMPLEX), ('is_update', fixed.UPDATE), ('explicit_change', fixed.EXPLICIT_CHANGE)])}
FROM (SELECT doc_id, {SAID} AS q FROM documents)""")
def change_cues(spark, d):
    cues = {"change": fixed.CHANGE, "is_complex": fixed.COMPLEX, "is_update": fixed.UPDATE, "explicit_change": fixed.EXPLICIT_CHANGE}
    return said(spark, d).select("doc_id", *[T.matches(F.col("q"), p).alias(n) for n, p in cues.items()])


@query("ungrounded_numbers", f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), lambda n: NOT list_contains(regexp_extract_all(q, '[0-9]+(?:[.,][0-9]+)*'), n)))), ' ') AS ungrounded
FROM (SELECT doc_id, text, {SAID} AS q FROM documents)""")
def ungrounded_numbers(spark, d):
    return said(spark, d).select("doc_id", F.array_join(T.ungrounded_numbers(F.col("text"), F.col("q")), " ").alias("ungrounded"))


@query("time_quote_supported", f"""
SELECT doc_id, contains({duck.signature('p')}, {duck.signature('e')}) AND {duck.squeeze('e')} <> '' AND list_contains(regexp_extract_all(p, '[0-9]+'), CAST(2020 + doc_id % 4 AS VARCHAR)) AS supported
FROM (SELECT doc_id, 'In  May 2021 ' || text AS p, CASE WHEN doc_id % 3 = 0 THEN 'in may' ELSE left(text, 12) END AS e FROM documents)""")
def time_quote_supported(spark, d):
    docs = table(spark, d, "documents")
    e = F.when(F.col("doc_id") % 3 == 0, F.lit("in may")).otherwise(F.left("text", F.lit(12)))
    return docs.select("doc_id", T.time_quote_supported(e, F.concat(F.lit("In  May 2021 "), "text"), 2020 + F.col("doc_id") % 4).alias("supported"))


@query("needs_context", f"SELECT conv_id, turn, {duck.squeeze('text')} <> '' AND ({duck.matches(duck.squeeze('text'), fixed.PRONOUN)} OR {duck.matches(duck.squeeze('text'), fixed.SHORT_OPENING)}) AS needs_context FROM conversations")
def needs_context(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.needs_context(F.col("text")).alias("needs_context"))


_RENDERED = "'Evidence ' || (turn + 1) || chr(10) || 'Message role: ' || role || '; said at unknown (do not infer a date) (not an event date).' || chr(10) || 'Selected original text:' || chr(10) || text"


@query("render_evidence", f"SELECT conv_id, turn, sha256({_RENDERED}) AS rendered_sha, CAST(length({_RENDERED}) AS BIGINT) AS n_chars FROM conversations")
def render_evidence(spark, d):
    r = T.render_evidence(F.col("turn") + 1, F.col("role"), F.lit(None).cast("long"), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(r, 256).alias("rendered_sha"), F.length(r).cast("long").alias("n_chars"))


@query("delivery_cost", f"SELECT conv_id, turn, CAST(length({_RENDERED}) + {fixed.GROUP_COST} AS BIGINT) AS cost FROM conversations")
def delivery_cost(spark, d):
    r = T.render_evidence(F.col("turn") + 1, F.col("role"), F.lit(None).cast("long"), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.length(r) + fixed.GROUP_COST).cast("long").alias("cost"))
