"""Exact quantiles without a buffer for each key: rank selection over range-partitioned counts.

Equal values of a key are counted before they are shuffled, the counts are sorted over all keys at once, and running sums
(of partitions first, then within each) say which value holds a rank. A key with most of the rows is spread over as
many partitions as its values need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, share, value): for each key and share the value at rank (n - 1) * share, between two ranks the straight
    line. Null values are left out; a key without any value has no rows; null keys are a key. NaN is the largest value."""
    counts = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ordered = counts.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_part", F.spark_partition_id())
    ordered = written(ordered, "quantile-counts")
    # A row for each key and partition.
    parts = ordered.groupBy(*keys, "_part").agg(F.sum("_n").alias("_own"))
    before = F.coalesce(F.sum("_own").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).withColumn("_total", F.sum("_own").over(Window.partitionBy(*keys)))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("share"), ((F.col("_total") - 1) * F.lit(float(p))).alias("at")) for p in shares])
    parts = parts.withColumn("_ranks", ranks)
    # Partitions without a wanted rank are not looked into.
    near = lambda low, high: lambda r: (F.ceil(r["at"]) >= low) & (F.floor(r["at"]) < high)
    parts = parts.withColumn("_ranks", F.filter("_ranks", near(F.col("_before"), F.col("_before") + F.col("_own")))).where(F.size("_ranks") > 0)
    wanted = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before", "_ranks")
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    held = ordered.join(wanted, same)
    upto = F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_high", F.col("_before") + upto).withColumn("_low", F.col("_high") - F.col("_n"))
    hit = held.withColumn("_r", F.explode(F.filter("_ranks", near(F.col("_low"), F.col("_high")))))
    at = F.col("_r.at")
    holds = lambda rank: (F.col("_low") <= rank) & (rank < F.col("_high"))
    both = hit.groupBy(*keys, F.col("_r.share").alias("share")).agg(F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias("_a"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias("_b"), F.max(at - F.floor(at)).alias("_f"))
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    return both.select(*keys, "share", between.alias("value"))
