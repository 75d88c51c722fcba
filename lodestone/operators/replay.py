"""Replay of a recorded request log through the engine's Add and Search, in the order of each case.

Cases are apart from each other (their users are), so a round is one Add or one Search over all of them: a case's log is cut
where it goes from adding to searching and back, and the k-th stretches of all cases are played together. A round's
answers are written before the next round is played; a replay that is begun again skips what is written, and Adds that
were accepted already are replays of themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.engine import MemoryEngine

MESSAGES = schemas.ADD_REQUEST.split("messages ")[1]
LOG = f"case_id string, position long, kind string, user_id string, session_id string, request_id string, messages {MESSAGES}, search_id long, query string, top_k int"
OUTCOME = "user_id string, request_id string, status string"
ANSWER = "search_id long, rank int, id string, content string, score double"


def namespaced(log: DataFrame, run: str) -> DataFrame:
    """The log under names of this run, so that runs in one store don't meet. Null ids stay null."""
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"arena:{run}:"), F.col(c)))
    return log.withColumns({c: name(c) for c in ("user_id", "session_id", "request_id")})


def in_rounds(log: DataFrame) -> DataFrame:
    """The log with ``round``: even ones add, odd ones search; within a case rounds rise with position."""
    w = Window.partitionBy("case_id").orderBy("position")
    search = (F.col("kind") == "search").cast("int")
    turned = F.when(F.lag("kind").over(w).isNull(), search).otherwise((F.col("kind") != F.lag("kind").over(w)).cast("int"))
    return log.withColumn("_turned", turned).withColumn("round", F.sum("_turned").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_turned")


class Replay:
    """One run of a log in a folder: its engine's state, and per round the outcomes of Adds or the answers of Searches."""

    def __init__(self, spark: SparkSession, root: str, run: str, engine: MemoryEngine | None = None):
        self.spark, self.root, self.run = spark, root.rstrip("/"), run
        self.engine = engine or MemoryEngine(spark, f"{self.root}/store")

    def _done(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def play(self, log: DataFrame, part: str = "0") -> None:
        """Play a log (LOG), or one part of it: parts are played one after the other, as micro-batches are."""
        rounds = in_rounds(namespaced(log, self.run))
        last = rounds.agg(F.max("round")).first()[0]
        for k in range(0 if last is None else last + 1):
            kind = "answers" if k % 2 else "outcomes"
            path = f"{self.root}/{kind}/part={part}/round={k}"
            if self._done(path):
                continue
            own = rounds.where((F.col("round") == k) & (F.col("kind") == ("search" if k % 2 else "add")))
            found = self._search(own) if k % 2 else self._add(own)
            found.write.mode("overwrite").parquet(path)

    def _add(self, rows: DataFrame) -> DataFrame:
        return self.engine.add(rows.select("request_id", "user_id", "session_id", "messages"))

    def _search(self, rows: DataFrame) -> DataFrame:
        asked = rows.select(F.col("search_id").alias("query_id"), "user_id", "query", "top_k")
        found = self.engine.search(asked)
        return found.select(F.col("query_id").alias("search_id"), F.col("rn").cast("int").alias("rank"), "id", "content", F.col("score").cast("double").alias("score"))

    def play_stream(self, log: DataFrame, checkpoint: str):
        """Each micro-batch is a part; its number names it, so a batch that is run again finds what it has written."""
        return log.writeStream.foreachBatch(lambda df, epoch: self.play(df, str(epoch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _read(self, kind: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        if not at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/part=*/round=*")

    def outcomes(self) -> DataFrame:
        """(user_id, request_id, status) of all Adds, names of this run; a request that was played again keeps its first
        outcome but for replays of itself."""
        found = self._read("outcomes", OUTCOME)
        return found.groupBy("user_id", "request_id").agg(F.min("status").alias("status"))

    def answers(self) -> DataFrame:
        return self._read("answers", ANSWER)
