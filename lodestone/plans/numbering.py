"""Global row numbers without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, *order: str, name: str = "sequence", width: int = 4096) -> DataFrame:
    """df with a 1-based global row number by (key, *order); key is integral.

    Rows are numbered within bins of ``width`` keys; only the bins' counts are summed up in one window.
    """
    binned = df.withColumn("_bin", F.floor(F.col(key) / width))
    counts = binned.groupBy("_bin").count()
    earlier = F.sum("count").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_bin", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    # Within a bin keys are dealt on: rows before a key, then rows within it.
    per_key = binned.groupBy("_bin", key).count()
    before = F.sum("count").over(Window.partitionBy("_bin").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    per_key = per_key.select("_bin", F.col(key).alias("_key"), F.coalesce(before, F.lit(0)).alias("_before"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    out = binned.withColumn("_rn", rn).join(counts, "_bin").join(per_key.drop("_bin"), F.col(key) == F.col("_key"))
    return out.withColumn(name, (F.col("_earlier") + F.col("_before") + F.col("_rn")).cast("long")).drop("_bin", "_earlier", "_key", "_before", "_rn")


def query_blocks(items: DataFrame, key: str, size: int = 256) -> list[DataFrame]:
    """A stated query set as blocks of at most ``size`` rows, which may be broadcast; key is integral and unique."""
    q = numbered(items, key, key)
    block = F.floor((F.col("sequence") - 1) / size)
    return [q.where(block == k).drop("sequence") for k in range(max(1, -(-items.count() // size)))]
