"""Tables as a log of appended files: a commit writes new rows and changes only, readers merge.

    ROOT/data/TABLE/VERSION-ID/bucket=B/...   the rows that one transaction appended to one table
    ROOT/_log/VERSION.json                    a commit: the folders that it adds
    ROOT/_log/VERSION.base.json               a compaction: the folders that hold everything up to it

A version exists once its log file does, which appears by one rename that fails where another writer has taken the
number. Folders that no log file names are not read: what a crashed writer has left is invisible, and ``vacuum`` deletes it.
Rows are changed by appending to a table of changes, of which the newest by key holds; so the bytes of a commit depend
on what it brings and not on what is there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Overlay:
    """A table's ``column`` is overwritten by the newest row of ``changes`` with the same keys; ``vanish`` columns become
    null where the column is no longer ``live``."""

    changes: str
    keys: tuple[str, ...]
    column: str
    live: str = "active"
    vanish: tuple[str, ...] = ()


@dataclass
class Transaction:
    """Appends that become visible together. A staged table can be read back at once."""

    tables: DeltaTables
    base: int
    added: dict[str, list[str]] = field(default_factory=dict)

    @property
    def version(self) -> int:
        return self.base + 1

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        folder = f"data/{name}/{self.version:010d}-{uuid.uuid4().hex}"
        rows = rows.withColumn("_version", F.lit(self.version).cast("long")).withColumn("bucket", bucket_of(self.tables.key))
        rows.write.partitionBy("bucket").parquet(f"{self.tables.root}/{folder}")
        self.added.setdefault(name, []).append(folder)
        return self.tables.spark.read.schema(rows.schema).parquet(f"{self.tables.root}/{folder}").drop("bucket", "_version")

    def commit(self) -> int:
        self.tables.publish(f"{self.version:010d}.json", {"version": self.version, "added": self.added})
        return self.version


class DeltaTables:
    def __init__(self, spark: SparkSession, root: str, overlays: dict[str, Overlay] | None = None, key: str = "user_id"):
        self.spark, self.root, self.overlays, self.key = spark, root.rstrip("/"), overlays or {}, key

    # The log, through Spark's own file systems.

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def publish(self, name: str, entry: dict) -> None:
        fs, jvm = self._fs(), self.spark._jvm
        draft, final = self._path(f"_log/.{uuid.uuid4().hex}.tmp"), self._path(f"_log/{name}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        # Fails where the name is taken.
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        if fs.exists(final):
            fs.delete(draft, False)
            raise ConflictError(name)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
        except Exception as e:
            fs.delete(draft, False)
            raise ConflictError(name) from e

    def latest(self) -> int | None:
        found = [int(n.split(".")[0]) for n in self.names("_log") if n[:1].isdigit()]
        return max(found, default=None)

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table at a version: those of the last compaction up to it and of the commits since."""
        names = [n for n in self.names("_log") if n[:1].isdigit() and (version is None or int(n.split(".")[0]) <= version)]
        base = max((n for n in names if n.endswith(".base.json")), default="")
        since = [n for n in names if n == base or (not n.endswith(".base.json") and n.split(".")[0] > base.split(".")[0])]
        if not since:
            return {}
        lines = self.spark.read.text([f"{self.root}/_log/{n}" for n in since], wholetext=True).collect()
        out: dict[str, list[str]] = {}
        for entry in sorted((json.loads(r["value"]) for r in lines), key=lambda e: e["version"]):
            for table, added in entry["added"].items():
                out.setdefault(table, []).extend(added)
        return out

    # Reading and writing.

    def begin(self) -> Transaction:
        return Transaction(self, self.latest() or 0)

    def rows(self, name: str, schema: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's appended rows with ``_version``, of some buckets only if given: others are not opened."""
        found = self.folders(version).get(name, [])
        whole = f"{schema}, _version long, bucket int"
        if not found:
            rows = self.spark.createDataFrame([], whole)
        else:
            # One scan for each folder, since a folder is where its buckets begin.
            parts = [self.spark.read.schema(whole).parquet(f"{self.root}/{f}") for f in found]
            rows = reduce(DataFrame.unionByName, parts)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def read(self, name: str, schema: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table at a version, changes merged."""
        rows = self.rows(name, schema, version, buckets)
        columns = [c.strip().split()[0] for c in schema.split(", ")]
        over = self.overlays.get(name)
        if over is None:
            return rows.select(*columns)
        kinds = {c.split()[0]: c.split()[1] for c in schema.split(", ")}
        change = ", ".join(f"{c} {kinds[c]}" for c in [*over.keys, over.column])
        newest = self.rows(over.changes, change, version, buckets).groupBy(*over.keys).agg(F.max_by(over.column, "_version").alias("_changed"))
        rows = rows.join(newest, [*over.keys], "left").withColumn(over.column, F.coalesce("_changed", over.column))
        for c in over.vanish:
            rows = rows.withColumn(c, F.when(F.col(over.column) == over.live, F.col(c)))
        return rows.select(*columns)

    def compact(self, schemas: dict[str, str]) -> None:
        """Write every table anew, changes merged, as the base that later readers start from; older versions stay
        readable until ``vacuum``."""
        version = self.latest()
        if version is None:
            return
        added = {}
        for name, schema in schemas.items():
            folder = f"data/{name}/{version:010d}-{uuid.uuid4().hex}"
            rows = self.read(name, schema, version).withColumn("_version", F.lit(version).cast("long")).withColumn("bucket", bucket_of(self.key))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            added[name] = [folder]
        self.publish(f"{version:010d}.base.json", {"version": version, "added": added})

    def vacuum(self, keep: int | None = None) -> int:
        """Delete folders that no version from ``keep`` (the latest) on reads; returns how many. For times without
        writers: an open transaction's folders are not named yet either."""
        latest = self.latest()
        used: set[str] = set()
        for v in range(latest if keep is None else keep, (latest or 0) + 1) if latest is not None else []:
            used.update(f for found in self.folders(v).values() for f in found)
        gone = 0
        for name in self.names("data"):
            for folder in self.names(f"data/{name}"):
                if f"data/{name}/{folder}" not in used:
                    gone += self._fs().delete(self._path(f"data/{name}/{folder}"), True)
        return gone
