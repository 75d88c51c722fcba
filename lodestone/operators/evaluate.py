"""Evaluation: evidence ranks, diagnosis, retrieval metrics, latencies, census and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b to 6 digits; null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b), 6)


def evidence_ranks(results: DataFrame, expected: DataFrame, search: str) -> DataFrame:
    """(search, target_index, match_rank): the first result whose id is expected or whose content contains an expected
    fragment, case-folded; null if none. results: search, rank, id, content; expected: search, target_index, ids,
    contains_any."""
    hit = F.array_contains("ids", F.col("id")) | F.exists("contains_any", lambda x: F.contains(F.lower("content"), F.lower(x)))
    first = results.join(expected, search).where(hit).groupBy(search, "target_index").agg(F.min("rank").alias("match_rank"))
    return expected.select(search, "target_index").join(first, [search, "target_index"], "left")


def diagnosis(rank: Column, failed: Column, add_failed: Column, top_k: Column) -> Column:
    return (
        F.when(failed, "search_failed")
        .when(add_failed, "source_add_failed")
        .when(rank.isNull(), "no_literal_evidence_match")
        .when(rank > F.least(F.lit(5), top_k), "retrieved_below_top5")
        .otherwise("retrieved")
    )


def retrieval_metrics(ranks: DataFrame, search: str, top_k: Column, cutoffs: tuple[int, ...] = (1, 5, 10), by: str | None = None) -> DataFrame:
    """(by, cutoff, eligible_queries, evidence_recall, hit_rate, chain_coverage, mrr), per category and overall.

    ranks: search, target_index, match_rank (null: missed), by. Only searches that asked for at least a cutoff count
    at it; recall is over targets, hit rate and chain coverage over searches; the reciprocal rank of a miss is 0.
    """
    keys = [search] + ([by] if by else [])
    per = None
    for c in cutoffs:
        own = ranks.where(top_k >= c).groupBy(*keys).agg(F.count("*").alias("targets"), F.count_if(F.col("match_rank") <= c).alias("found"), F.max(F.coalesce(1 / F.col("match_rank"), F.lit(0.0))).alias("rr"))
        own = own.withColumn("cutoff", F.lit(c).cast("long"))
        per = own if per is None else per.unionByName(own)
    per = per.withColumn("group", F.coalesce(F.col(by), F.lit("unknown")) if by else F.lit("all"))
    sets = per.rollup("cutoff", "group") if by else per.groupBy("cutoff", "group")
    out = sets.agg(
        F.count("*").alias("eligible_queries"),
        ratio(F.sum("found"), F.sum("targets")).alias("evidence_recall"),
        ratio(F.count_if(F.col("found") > 0), F.count("*")).alias("hit_rate"),
        ratio(F.count_if(F.col("found") == F.col("targets")), F.count("*")).alias("chain_coverage"),
        F.round(F.avg("rr"), 6).alias("mrr"),
    )
    return out.where("cutoff is not null").withColumn("group", F.coalesce("group", F.lit("all")))


def macro_metrics(ranks: DataFrame, search: str, cutoff: int) -> DataFrame:
    """One row: mean recall per search, share of complete chains among searches with several targets."""
    per = ranks.groupBy(search).agg(F.count("*").alias("targets"), F.count_if(F.col("match_rank") <= cutoff).alias("found"))
    several = F.col("targets") > 1
    return per.agg(
        F.count("*").alias("searches"),
        F.round(F.avg(F.col("found") / F.col("targets")), 6).alias("macro_recall"),
        ratio(F.count_if(several & (F.col("found") == F.col("targets"))), F.count_if(several)).alias("chain_coverage"),
    )


def duplicate_rate(results: DataFrame, search: str, signature: Column) -> DataFrame:
    per = results.groupBy(search).agg(F.count("*").alias("n"), F.countDistinct(signature).alias("u"))
    return per.agg(F.sum("n").alias("results"), F.sum(F.col("n") - F.col("u")).alias("duplicates"), ratio(F.sum(F.col("n") - F.col("u")), F.sum("n")).alias("rate"))


def latency(df: DataFrame, key: str, value: str) -> DataFrame:
    """p50 and p95 with linear interpolation, and the maximum."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return df.groupBy(key).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.max(value).alias("max_value"))


def latency_nearest(df: DataFrame, key: str, value: str) -> DataFrame:
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")
    return df.groupBy(key).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.max(value).alias("max_value"))


def summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, min, median, p90 (the lower index), max, total; the p90 is a row_number pick, so no group is collected."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1
    n = F.count("*").over(Window.partitionBy(key))
    marked = df.select(key, value, F.when(rn == F.floor((n - 1) * 9 / 10), F.col(value)).alias("_p"))
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("min_value"), F.percentile(value, F.lit(0.5)).alias("median_value"), F.max("_p").alias("p90"), F.max(value).alias("max_value"), F.sum(value).alias("total"))


def sum_known(value: Column) -> Column:
    """The sum if every value is known, else null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def rollup_assessments(rows: DataFrame, key: str, expected: Column) -> DataFrame:
    """(key, verdict): every criterion exactly once, else invalid; any uncertain, then all passed."""
    agg = rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("criterion").alias("u"), F.bool_or(F.col("verdict") == "uncertain").alias("any_unsure"), F.bool_and(F.col("verdict") == "pass").alias("all_pass"), F.first(expected).alias("want"))
    bad = (F.col("n") != F.col("u")) | (F.col("u") != F.col("want"))
    return agg.select(key, F.when(bad, "invalid").when(F.col("any_unsure"), "uncertain").when(F.col("all_pass"), "correct").otherwise("incorrect").alias("verdict"))
