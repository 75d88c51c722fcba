"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of our own per application if driver and
    executors are one process (tests, benches), and an error on a cluster, whose executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        found = _own[app]
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, not made yet. What stands there goes when this Python process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs neither recompute it nor
    depend on the executors that made it. The tables go when this Python process ends."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written() -> None:
    """Delete all tables that cut wrote; nothing may read them any more. Without a live JVM they stay."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None:
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: str = "2m") -> None:
    """Whole texts go to Python in Arrow batches of about this size, unless the session states one itself. Spark's own limit
    (10,000 rows or 64 MB) is held several times over by each task: as it grows in the JVM, as it arrives and as it returns."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, most)


def join_hot(rows: DataFrame, small: DataFrame, key: str, counts: DataFrame, total: int, share: int = 1000) -> DataFrame:
    """rows joined with ``small``, which has each key once, without one task for a key that many rows share.

    counts has key and n, the number of rows of it. Keys with more than 1 / share of all rows, fewer than ``share``
    by arithmetic, are joined by broadcast; all others meet by a shuffle.
    """
    hot = counts.where(F.col("n") * share > total).select(key)
    first = rows.join(F.broadcast(small.join(F.broadcast(hot), key, "left_semi")), key)
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(small, key)
    return first.unionByName(rest)


def key_bits(keys: DataFrame, key: str, most: int = 1 << 28) -> np.ndarray:
    """A bit for each hash of the keys (longs), 16 bits a key but ``most`` in all, packed to 64-bit words: a broadcast of
    32 MB at any number of keys. A key that is there has its bit; others have it by chance, more of them the more keys
    there are. So it spares work before an exact join and never decides."""
    n = keys.count()
    bits = max(64, min(most, 1 << max(1, 16 * n - 1).bit_length()))
    at = F.pmod(F.xxhash64(F.lit(7), key), F.lit(bits))
    words = keys.select(F.floor(at / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = np.zeros(bits // 64, np.int64)
    rows = words.toPandas()
    found[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return found


def bit_of(key: str | Column, words: np.ndarray) -> Column:
    """The place of a key among the bits, for has_bit."""
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(64 * len(words)))


def has_bit(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words[at >> 6] >> (at & 63)) & 1).astype(bool)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: tuple[int, int], seed: int = 17) -> DataFrame:
    """(doc_id, text, y): of class y, the per_class[y] labelled rows first in a seeded hash order.

    Only rows for which ``keep`` holds are eligible. A doc_id with several labels takes the largest, one
    with several texts the smallest. At most sum(per_class) rows, so the id side is small by construction
    and may be broadcast.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    )
    picked = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class[y]).select("doc_id", "y")
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
