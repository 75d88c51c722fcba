"""The engine's tables over the driver's: messages and sources, passages, nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.numbering import numbered
from lodestone.plans.registry import table


def sources(spark: SparkSession, d: str) -> DataFrame:
    """conversations as sources: user u<conv_id mod 10>, session conv_id, requests of two turns, commit sequence."""
    c = table(spark, d, "conversations").where("role <> 'system'")
    c = numbered(c, "conv_id", "turn")
    return c.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat_ws("/", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string")).alias("request_id"),
        "sequence",
    )
