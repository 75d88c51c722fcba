"""Arena tables: manifest checks, span checks and trees, drill-down from searches to the Adds behind them.

A check is a table of (row key, reason): rules are named conditions, and a row may break several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the span protocol.
OPERATIONS = ["add", "extract", "store", "index", "search", "retrieve", "select", "reflection", "rerank", "context", "answer", "eval", "model"]
STATUSES = ["ok", "error", "skipped"]
REPLAYS = ["none", "cached", "resumed"]
RELATIONS = ["derived_from", "retrieved_from", "selected_from", "supports", "contradicts", "supersedes"]
KINDS = ["source", "memory", "query", "result", "context", "answer", "evaluation"]


def said(c: str | Column) -> Column:
    """Whether a string is there and not blank."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c) != "")


def broken(rows: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, reason) of every rule that a row breaks; an unknown condition counts as broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("reason"))


def check_adds(adds: DataFrame) -> DataFrame:
    """adds: case_id, request_id, user_id, session_id, messages (role, content, timestamp)."""
    n = F.count("*").over(Window.partitionBy("case_id", "request_id"))
    rules = {
        "blank_id": said("request_id") & said("user_id") & said("session_id"),
        "message_count": F.size("messages").between(1, 20),
        "role": F.forall("messages", lambda m: m["role"].isin("user", "assistant")),
        "blank_content": F.forall("messages", lambda m: said(m["content"])),
        "timestamp": F.forall("messages", lambda m: m["timestamp"].isNull() | (m["timestamp"] >= 0)),
        "repeated_request": F.col("_n") == 1,
    }
    return broken(adds.withColumn("_n", n), rules, "case_id", "request_id")


def check_searches(searches: DataFrame) -> DataFrame:
    """searches: case_id, search_id, query, user_id, top_k, expect_empty, grading, expected (ids, contains_any).

    Without a grading it follows from what is expected; a grading that contradicts it breaks a rule."""
    n = F.count("*").over(Window.partitionBy("search_id"))
    has = F.size(F.coalesce("expected", F.array().cast("array<struct<ids:array<string>,contains_any:array<string>>>"))) > 0
    empty = F.coalesce("expect_empty", F.lit(False))
    grading = F.coalesce("grading", F.when(empty, "empty").when(has, "evidence"))
    agrees = F.when(grading == "evidence", has & ~empty).when(grading == "empty", ~has & empty).when(grading == "ungraded", ~has & ~empty)
    target = lambda t: (F.size(t["ids"]) + F.size(t["contains_any"]) > 0) & F.forall(t["ids"], said) & F.forall(t["contains_any"], said)
    rules = {
        "blank": said("query") & said("user_id") & said("search_id"),
        "top_k": F.col("top_k").between(1, 100),
        "grading": agrees,
        "target": ~has | F.forall("expected", target),
        "repeated_search": F.col("_n") == 1,
    }
    return broken(searches.withColumn("_n", n), rules, "case_id", "search_id")


def check_spans(spans: DataFrame) -> DataFrame:
    """(span_id, reason) over span events with typed fields; inputs and outputs are arrays of (id, kind, artifact, sha256,
    locator), links of (from_id, to_id, relation), candidates of (ref_id, rank, score, selected)."""
    hexes = lambda c: F.regexp_like(c, F.lit("^[0-9a-f]{64}$"))
    refs = F.concat("inputs", "outputs")
    ids = F.transform(refs, lambda r: r["id"])
    path = lambda r: ~F.regexp_like(r["artifact"], F.lit(r"^/|:|\\|(^|/)\.\.(/|$)"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    ranks = F.transform("candidates", lambda c: c["rank"])
    tokens = [F.coalesce(F.col(f"model.{f}") >= 0, F.col(f"model.{f}").isNull()) for f in ("input_tokens", "output_tokens", "cached_tokens", "cost_usd")]
    rules = {
        "blank_field": said("run_id") & said("trace_id") & said("span_id") & said("record_id") & said("request_id") & said("name"),
        "pack_digest": hexes(F.col("dataset_pack_sha256")),
        "optional_field": (F.col("parent_span_id").isNull() | said("parent_span_id")) & (F.col("task_id").isNull() | said("task_id")),
        "operation": F.col("operation").isin(OPERATIONS) & F.col("status").isin(STATUSES),
        "attempt": (F.col("attempt") >= 1) & F.col("replay").isin(REPLAYS),
        "model_not_invoked": ~((F.col("operation") == "model") & ((F.col("status") == "skipped") | (F.col("replay") == "cached"))),
        "duration": finite(F.col("duration_ms")) & (F.col("duration_ms") >= 0),
        "times": F.col("ended_at") >= F.col("started_at"),
        "reference": F.forall(refs, lambda r: said(r["id"]) & said(r["locator"]) & r["kind"].isin(KINDS) & hexes(r["sha256"]) & path(r)),
        "repeated_reference": F.size(F.array_distinct(ids)) == F.size(ids),
        "link": F.forall("links", lambda x: x["relation"].isin(RELATIONS) & F.array_contains(ids, x["from_id"]) & F.array_contains(ids, x["to_id"])),
        "candidate": F.forall("candidates", lambda c: F.array_contains(ids, c["ref_id"]) & (c["rank"] >= 1) & c["selected"].isNotNull() & (c["score"].isNull() | finite(c["score"]))),
        "repeated_rank": F.size(F.array_distinct(ranks)) == F.size(ranks),
        "model": F.col("model").isNull() | ((F.col("operation") == "model") & said("model.provider") & said("model.name") & said("model.usage_source") & tokens[0] & tokens[1] & tokens[2] & tokens[3]),
        "error": F.when(F.col("status") == "error", said("error.code") & F.col("error.retryable").isNotNull()).otherwise(F.col("error").isNull()),
    }
    return broken(spans, rules, "span_id")


def span_cycles(spans: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Spans whose chain of parents never ends: what is left after taking off, over and over, the spans whose parent
    is absent or already taken off."""
    left = spans.select("span_id", "parent_span_id")
    for _ in range(max_rounds):
        names = left.select(F.col("span_id").alias("parent_span_id"))
        rest = left.join(names, "parent_span_id", "left_semi").select("span_id", "parent_span_id").cache()
        if rest.count() == left.count():
            return rest.select("span_id")
        left = rest
    raise RuntimeError("chains are longer than max_rounds")


def adds_behind(expected: DataFrame, adds: DataFrame) -> DataFrame:
    """expected (search_id, add_request_id) with the Adds that bear this request id, whole or as the last part of a
    namespaced one."""
    own = F.element_at(F.split("request_id", ":"), -1)
    a = adds.select(F.explode(F.array_distinct(F.array("request_id", own))).alias("add_request_id"), "case_id", "request_id").distinct()
    return expected.join(a, "add_request_id")


def answer_inputs(trace: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` searches that did not fail, in trace order."""
    ok = trace.where("error is null")
    return ok.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("position"))).where(F.col("_n") <= limit).drop("_n")


def current_notes(notes: DataFrame) -> DataFrame:
    """Append-only notes that no later note supersedes."""
    gone = notes.where("supersedes is not null").select(F.col("supersedes").alias("note_id"))
    return notes.join(gone, "note_id", "left_anti")
