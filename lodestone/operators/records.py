"""Checks and projections over stored records: audits, gates, attachments, request states, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.interval import ranges_complete, union_contains

GREETINGS = ["hey", "hi", "good", "thanks", "yeah", "speaker"]  # fixed values
STAGES = ["raw", "planned", "done"]  # fixed values


def supplemental(queries: Column, question: Column) -> Column:
    """The proposed queries that are not the question again (case and outer white space aside), each once, in order."""
    said = lambda q: F.lower(F.btrim(q, F.lit(" \t\n\r\f\v")))
    return F.array_distinct(F.filter(queries, lambda q: said(q) != said(question)))


def fragment_id(ref: Column, version: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the compact JSON array [ref, version, start, end]."""
    names = F.to_json(F.array(ref, version))
    parts = F.concat_ws(",", F.substring(names, F.lit(1), F.length(names) - 1), start.cast("string"), end.cast("string"))
    return F.sha2(F.concat(parts, F.lit("]")), 256)


def fragments(sources: DataFrame, limit: int | None = None) -> DataFrame:
    """sources (ref, text, start, end) as half-open ranges within the text, cut to ``limit`` characters at the end."""
    size, version = F.length("text"), F.sha2("text", 256)
    low = F.greatest(F.lit(0), F.col("start"))
    high = F.least(size, F.col("end")) if limit is None else F.least(size, F.col("end"), low + limit)
    cut = sources.withColumn("content_digest", version).withColumn("start", low).withColumn("end", high)
    cut = cut.withColumn("complete", (F.col("start") == 0) & (F.col("end") == size))
    cut = cut.withColumn("piece", F.substring("text", F.col("start") + 1, F.greatest(F.lit(0), F.col("end") - F.col("start"))))
    return cut.withColumn("fragment_id", fragment_id(F.col("ref"), F.col("content_digest"), F.col("start"), F.col("end"))).drop("text")


def unread_pages(pages: DataFrame, shown: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """Pages (key, start, end) that the unions of shown and of read ranges do not both cover."""
    seen = union_contains(shown, pages, key).withColumnRenamed("visible", "_shown")
    return union_contains(read, seen, key).where(~(F.col("_shown") & F.col("visible"))).drop("_shown", "visible")


def episode_labels(sources: DataFrame, key: str, order: str) -> DataFrame:
    """(key, label): the first day, up to two speakers and four salient words of a request's sources in order.

    sources: key, order, day, text. A source's first four words are enough to find the first four of all.
    """
    header = r"(?m)^Speaker:\s*([^\n]+)"
    speaker = F.btrim(F.regexp_extract("text", header, 1))
    words = T.terms_ascii(F.regexp_replace("text", r"(?m)^Speaker:[^\n]*", ""))
    words = F.slice(F.array_distinct(F.array_except(words, T.words_in(GREETINGS))), 1, 4)
    rows = sources.select(key, F.struct(F.col(order).alias("o"), F.col("day").alias("d"), speaker.alias("s"), words.alias("w")).alias("row"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    day = F.filter(F.array(F.col("rows")[0]["d"].cast("string")), lambda d: d.isNotNull())
    speakers = F.slice(F.array_distinct(F.filter(F.transform("rows", lambda r: r["s"]), lambda s: s != "")), 1, 2)
    first = F.slice(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["w"]))), 1, 4)
    return rows.select(key, F.array_join(F.concat(day, speakers, first), "-").alias("label"))


def embedding_audit(items: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """(ref, problem) of vectors without an item, items without a vector, and wrong lengths."""
    both = items.select("ref", F.lit(True).alias("_item")).join(vectors.select("ref", F.size("vector").alias("_size")), "ref", "full_outer")
    problem = F.when(F.col("_item").isNull(), "orphan").when(F.col("_size").isNull(), "missing").when(F.col("_size") != dimensions, "dimensions")
    return both.select("ref", problem.alias("problem")).where("problem is not null")


def replace_embeddings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next version of the vectors: all rows of a ref that fresh holds give way to fresh's rows."""
    return stored.join(fresh.select("ref").distinct(), "ref", "left_anti").unionByName(fresh)


def fingerprint_gate(opened: DataFrame, key: str, order: str) -> DataFrame:
    """opened with ``state``: the first fingerprint of a store is kept, every later one must equal it."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.first("fingerprint").over(w)
    return opened.withColumn("state", F.when(F.row_number().over(w) == 1, "stored").when(F.col("fingerprint") == first, "same").otherwise("mismatch"))


def suite(records: DataFrame, per_family: int, seed: int) -> DataFrame:
    """The per_family records of each family that come first in the seeded hash order, with their ordinal."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), "family", F.lit(":"), F.col("record").cast("string")), 256)
    w = Window.partitionBy("family").orderBy("_h", "record")
    picked = records.withColumn("_h", drawn).withColumn("ordinal", F.row_number().over(w))
    return picked.where(F.col("ordinal") <= per_family).withColumn("ordinal", F.col("ordinal").cast("long")).drop("_h")


def attach(observations: DataFrame, queries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """observations with ``verdict``: known key, first of its key, same pack, ranks within the query's results.

    queries: keys, pack, n_results; observations: keys, order, pack_sha, ranks.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    joined = observations.withColumn("_rn", rn).join(queries, keys, "left")
    bad = F.exists("ranks", lambda r: (r < 1) | (r > F.col("n_results")))
    verdict = F.when(F.col("n_results").isNull(), "unknown").when(F.col("_rn") > 1, "duplicate")
    verdict = verdict.when(F.col("pack_sha") != F.col("pack"), "pack mismatch").when(bad, "invalid ranks").otherwise("attached")
    return joined.withColumn("verdict", verdict).drop("_rn", "pack", "n_results")


def case_runs(cases: DataFrame, runs: DataFrame, planned: DataFrame, reported: DataFrame) -> DataFrame:
    """(case_id, run_id, search_id) of runs of the case's data set whose selection admits the case's record (null:
    any), that planned its task and reported the search.

    cases: case_id, dataset, record; runs: run_id, dataset, selected; planned, reported: run_id, record, search_id.
    """
    bound = planned.join(reported, ["run_id", "record", "search_id"], "left_semi").join(runs, "run_id")
    found = bound.join(cases, ["dataset", "record"])
    return found.where(F.col("selected").isNull() | F.array_contains("selected", F.col("record"))).select("case_id", "run_id", "search_id")


def span_table(spans: DataFrame, order: str) -> DataFrame:
    """One row per run and span, the last observed; queries then hold span ids only."""
    w = Window.partitionBy("run_id", "span_id").orderBy(F.desc(order))
    return spans.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fact_hints(facts: DataFrame) -> DataFrame:
    """facts (hints: ordered structs expression, start, end, precision; requested; event_day) with their ``hint``.

    A requested expression takes the first hint of that expression, or stands without dates; else the only distinct
    hint holds; else the event's day.
    """
    equal = F.filter("hints", lambda h: F.lower(h["expression"]) == F.lower(F.col("requested")))
    bare = F.struct(F.col("requested").alias("expression"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit("expression").alias("precision"))
    named = F.when(F.size(equal) > 0, equal[0]).otherwise(bare)
    kinds = F.array_distinct(F.transform("hints", lambda h: F.struct(h["expression"], h["start"], h["end"])))
    day = F.struct(F.col("event_day").cast("string").alias("expression"), F.col("event_day").alias("start"), F.date_add("event_day", 1).alias("end"), F.lit("day").alias("precision"))
    hint = F.when(F.coalesce("requested", F.lit("")) != "", named).when(F.size(kinds) == 1, F.element_at("hints", -1)).when(F.col("event_day").isNotNull(), day)
    return facts.withColumn("hint", hint)


def request_states(log: DataFrame) -> DataFrame:
    """(user_id, request_id, stage, legal) of a log of stages: requests go through STAGES in order, none left out;
    a stage that is logged again is a resumed one."""
    step = F.array_position(T.words_in(STAGES), F.col("stage"))
    w = Window.partitionBy("user_id", "request_id").orderBy("at")
    ahead = step - F.coalesce(F.lag(step).over(w), F.lit(0))
    legal = log.withColumn("_ok", (ahead == 1) | ((ahead == 0) & (step > 0))).groupBy("user_id", "request_id")
    return legal.agg(F.max_by("stage", "at").alias("stage"), F.min("_ok").alias("legal"))


def admission(states: DataFrame) -> DataFrame:
    """(user_id, n_incomplete, admitted): nothing new is taken while one of the user's requests is not done."""
    open_ = F.count_if(F.col("stage") != STAGES[-1])
    return states.groupBy("user_id").agg(open_.alias("n_incomplete"), (open_ == 0).alias("admitted"))


def missing_material(targets: DataFrame, bodies: DataFrame, shown: DataFrame, read: DataFrame) -> DataFrame:
    """The targets (ref) whose whole body, in its present version, was not both read and shown.

    bodies: ref, version, length; shown, read: ref, version, start, end.
    """
    lengths = targets.select("ref").distinct().join(bodies, "ref", "left")

    def whole(ranges: DataFrame, name: str) -> DataFrame:
        own = ranges.join(bodies.select("ref", "version"), ["ref", "version"], "left_semi")
        return ranges_complete(own, lengths.select("ref", "length"), "ref").withColumnRenamed("complete", name)

    both = lengths.join(whole(shown, "_shown"), "ref", "left").join(whole(read, "_read"), "ref", "left")
    return both.where(~(F.coalesce("_shown", F.lit(False)) & F.coalesce("_read", F.lit(False)) & F.col("version").isNotNull())).select("ref")
