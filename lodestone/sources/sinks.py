"""Sinks: versioned table sets, append-only traces, content-addressed artifacts, Markdown pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTables:
    """A directory of table versions. A version is complete once its _commit row is written; readers take the newest
    complete one, so a failed write leaves nothing visible."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commit(self, version: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        done = self.spark.createDataFrame([(version, sorted(tables))], "version long, tables array<string>")
        done.write.mode("append").json(f"{self.root}/_commits")

    def latest(self) -> int | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("version long, tables array<string>").json(f"{self.root}/_commits").agg(F.max("version")).first()[0]

    def read(self, name: str, schema: str) -> DataFrame:
        version = self.latest()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/version={version}")


def append_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def artifacts(rows: DataFrame, *payload: str) -> DataFrame:
    """rows with the SHA-256 of their canonical payload as id: equal artifacts share it."""
    body = F.to_json(F.struct(*sorted(payload)))
    return rows.withColumn("artifact", body).withColumn("artifact_id", F.sha2("artifact", 256))


def write_markdown(pages: DataFrame, path: str, day: str = "day", page: str = "page") -> None:
    """One folder of Markdown text per day; rewriting a day replaces it."""
    pages.select(day, F.col(page).alias("value")).write.mode("overwrite").partitionBy(day).text(path)
