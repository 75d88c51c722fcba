"""Readers: strict JSON arrays, JSON lines, CSV, parquet, files with digests, Python-literal and soft decoding."""

from __future__ import annotations

import ast
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file that holds one JSON array; malformed files fail."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object per line, blank lines skipped. Not strict: a torn line is left out, as at the end of a live log."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("r")).where("r._corrupt is null").select("r.*").drop("_corrupt")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a mandatory header that names the schema's columns; quoted fields may hold newlines, a BOM is skipped."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False, encoding="UTF-8")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, git_sha1) of whole files."""
    f = spark.read.format("binaryFile").load(path)
    header = F.concat(F.lit("blob "), F.col("length").cast("string"), F.lit("\u0000")).cast("binary")
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), F.sha1(F.concat(header, F.col("content"))).alias("git_sha1"))


def check_digests(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (path, sha256, length) rows that are missing or differ, with the reason."""
    got = found.select("path", F.col("sha256").alias("got"), F.col("length").alias("n"))
    both = expected.join(got, "path", "left")
    reason = F.when(F.col("got").isNull(), "missing").when(F.col("n") != F.col("length"), "length").when(F.col("got") != F.col("sha256"), "digest")
    return both.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def gaps(rows: DataFrame, index: str, *keys: str) -> DataFrame:
    """Rows whose index does not follow the one before: offsets of paged reads must be contiguous."""
    w = Window.partitionBy(*keys).orderBy(index) if keys else Window.orderBy(index)
    return rows.withColumn("_before", F.lag(index).over(w)).where(F.col("_before").isNotNull() & (F.col(index) != F.col("_before") + 1)).drop("_before")


def soft_value(text: str | None, limit: int = 100_000) -> Any:
    """JSON, else a Python literal, else the text itself; texts of limit characters or more are not tried."""
    if text is None or len(text) >= limit:
        return text
    for parse in (json.loads, ast.literal_eval):
        try:
            return parse(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return text


@F.pandas_udf(StringType())
def literal_to_json(text: pd.Series) -> pd.Series:
    """Python-literal columns as JSON text, for from_json; anything else is an error."""
    return text.map(lambda t: None if t is None else json.dumps(ast.literal_eval(t), ensure_ascii=False))


@F.pandas_udf(StringType())
def soft_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json.dumps(soft_value(t), ensure_ascii=False, default=str))


def literal(column: Column, schema: str) -> Column:
    return F.from_json(literal_to_json(column), schema)


def duplicate_keys(rows: DataFrame, level: str, *keys: str) -> DataFrame:
    """(level, key, n) of key values that occur more than once; packs must have none."""
    return rows.groupBy(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(level).alias("level"), "key", "n")


def blank_content(turns: DataFrame, content: str = "content") -> DataFrame:
    return turns.where(F.trim(F.coalesce(content, F.lit(""))) == "")
