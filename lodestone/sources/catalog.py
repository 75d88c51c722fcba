"""A catalog of data sets in two sections, and snapshots of source trees that tell a run whether its code has changed."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "array<struct<id:string,path:string,format:string,pack_adapter:string>>"


class CatalogError(ValueError):
    pass


def entries(spark: SparkSession, path: str, sections: tuple[str, str] = ("datasets", "assets")) -> DataFrame:
    """(section, id, path, format, pack_adapter) of both sections of a JSON catalog; a section that is missing is empty."""
    whole = spark.read.schema(", ".join(f"{s} {ENTRY}" for s in sections)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    parts = [whole.select(F.lit(s).alias("section"), F.explode(s).alias("e")).select("section", "e.*") for s in sections]
    return parts[0].unionByName(parts[1])


def repeated(catalog: DataFrame) -> DataFrame:
    """(id, sections) of ids that stand more than once, in one section or both."""
    return catalog.groupBy("id").agg(F.array_sort(F.collect_list("section")).alias("sections")).where(F.size("sections") > 1)


def find(catalog: DataFrame, ident: str, root: str) -> dict:
    """The one entry of an id, its path resolved within root. Unknown or repeated ids, and paths that leave root, are errors."""
    found = catalog.where(F.col("id") == ident).limit(2).collect()
    if len(found) != 1:
        raise CatalogError(f"{ident}: {'unknown' if not found else 'more than one entry'}")
    entry = found[0].asDict()
    base = root.rstrip("/")
    at = posixpath.normpath(f"{base}/{entry['path']}") if entry["path"] else base
    if entry["path"] and (entry["path"].startswith("/") or not at.startswith(posixpath.normpath(base) + "/")):
        raise CatalogError(f"{ident}: path leaves its root")
    return entry | {"path": at}


def snapshot(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(path, sha256, size) of the files below root whose names match, paths relative to root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    inner = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + posixpath.normpath(root.removeprefix("file://")) + "/", "")
    return files.select(inner.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def digest(files: DataFrame) -> str:
    """One hash of a snapshot, the same for the same files wherever they lie. It holds a line for each source file."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat(f["path"], F.lit(":"), f["sha256"]))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256)).first()[0]


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files that were added, removed or changed between two snapshots; a run refuses if there are any."""
    both = before.select("path", F.col("sha256").alias("was")).join(after.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")
