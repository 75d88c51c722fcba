"""Dictionary encoding of repeated values: rows hold small codes, each value stands once.

A column's codes are the places of its values in their order, counted from 0 over range partitions (sizes of partitions first,
places within one then), so no task sorts a whole column. Encoding and decoding are joins; a value or code that very many
rows share is a join key that can be split, since the other side has it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestone.sources.shared import written


def dictionary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, code, value): the distinct values of each column (of all elements, if it is an array), as text, in order."""
    parts = None
    for c in columns:
        is_array = isinstance(rows.schema[c].dataType, ArrayType)
        flat = rows.select((F.explode(c) if is_array else F.col(c)).alias("value"))
        own = flat.select(F.lit(c).alias("name"), F.col("value").cast("string").alias("value")).where("value is not null").distinct()
        parts = own if parts is None else parts.unionByName(own)
    ordered = parts.repartitionByRange("name", "value").sortWithinPartitions("name", "value").withColumn("_part", F.spark_partition_id())
    ordered = written(ordered, "dictionary")
    sizes = ordered.groupBy("name", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("name", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part", "name").orderBy("value")) - 1
    return ordered.join(F.broadcast(sizes), ["name", "_part"]).select("name", (F.col("_before") + place).cast("long").alias("code"), "value")


def replaced(rows: DataFrame, known: DataFrame, column: str, key: str, come: str, go: str, kind: str) -> DataFrame:
    """rows with ``column`` mapped from ``come`` to ``go`` of the dictionary; elements of arrays keep their order."""
    own = known.where(F.col("name") == column).select(F.col(come).alias("_come"), F.col(go).alias("_go"))
    if not isinstance(rows.schema[column].dataType, ArrayType):
        found = rows.join(own, F.col(column).cast("string") == F.col("_come").cast("string"), "left")
        return found.withColumn(column, F.col("_go").cast(kind)).select(*rows.columns)
    flat = rows.select(key, F.posexplode(column).alias("_p", "_e")).join(own, F.col("_e").cast("string") == F.col("_come").cast("string"), "left")
    held = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_go"))), lambda x: x["_go"].cast(kind)).alias("_new"))
    empty = F.array().cast(f"array<{kind}>")
    new = F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.coalesce("_new", empty))
    return rows.join(held, key, "left").withColumn(column, new).select(*rows.columns)


def encode(rows: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, rows with codes for the columns' values). ``key`` is unique; null values, null arrays and null
    elements stay null."""
    known = dictionary(rows, columns)
    known = written(known, "codes")
    for c in columns:
        rows = replaced(rows, known, c, key, "value", "code", "long")
    return known, rows


def decode(known: DataFrame, rows: DataFrame, kinds: dict[str, str], key: str) -> DataFrame:
    """The rows that were encoded; kinds: the type of each column's values, or of an array's elements."""
    for c, kind in kinds.items():
        rows = replaced(rows, known, c, key, "code", "value", kind)
    return rows


def compact_spans(spans: DataFrame, references: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, events, references) of the spans that queries hold: each query's span ids in order, each event once with the
    ids of what it refers to, and each thing referred to once.

    spans: query_id, place, span_id, and per column of ``references`` an array of structs with ``id``; a span or reference
    that stands more than once is the same each time, and any of its rows is taken.
    """
    queries = spans.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "span_id"))), lambda x: x["span_id"]).alias("spans"))
    fields = [c for c in spans.columns if c not in ("query_id", "place", "span_id", *references)]
    ids = [F.transform(c, lambda r: r["id"]).alias(c) for c in references]
    events = spans.select("span_id", *fields, *ids).groupBy("span_id").agg(*[F.any_value(c).alias(c) for c in [*fields, *references]])
    flat = None
    for c in references:
        own = spans.select(F.explode(c).alias("r")).select("r.*")
        flat = own if flat is None else flat.unionByName(own)
    return queries, events, flat.groupBy("id").agg(*[F.any_value(c).alias(c) for c in flat.columns if c != "id"])


def expand_spans(queries: DataFrame, events: DataFrame, held: DataFrame, references: list[str]) -> DataFrame:
    """The spans that compact_spans was given."""
    whole = F.struct(*[c for c in held.columns])
    for c in references:
        flat = events.select("span_id", F.posexplode(c).alias("_p", "id")).join(held, "id").groupBy("span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", whole.alias("_r")))), lambda x: x["_r"]).alias("_new"))
        none = F.transform(F.filter(c, lambda x: F.lit(False)), lambda x: F.lit(None).cast(held.select(whole.alias("r")).schema["r"].dataType))
        events = events.join(flat, "span_id", "left").withColumn(c, F.coalesce("_new", none)).drop("_new")
    return queries.select("query_id", F.posexplode("spans").alias("place", "span_id")).join(events, "span_id")
