"""The memory engine over DataFrames: add batches of requests, search batches of queries.

State is a log of appended rows: an Add writes its own sources, passages, receipts and status changes, and all become visible
by one commit. What it reads of earlier state are the buckets of its own users. Searches read one version and never
change it. All work is keyed by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import fixed
from lodestone.functions import text as T
from lodestone.operators import assemble, chunk, forget, ingest, retrieve
from lodestone.plans.numbering import query_blocks
from lodestone.providers import Embedder, HashEmbedder
from lodestone.sources.delta import BUCKETS, DeltaTables, Overlay, bucket_of

RECEIPT = schemas.RECEIPT
STATUS = "user_id string, sequence bigint, status string"
BY_STATUS = ("user_id", "sequence")


class MemoryEngine:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, verifier: forget.Verifier | None = None):
        self.spark, self.embedder, self.verifier = spark, embedder or HashEmbedder(), verifier
        overlays = {"sources": Overlay("status", BY_STATUS, "status"), "passages": Overlay("status", BY_STATUS, "status", vanish=("vector",))}
        self.tables = DeltaTables(spark, root, overlays)

    def add(self, requests: DataFrame) -> DataFrame:
        """Accept Add requests (see schemas.ADD_REQUEST); returns (user_id, request_id, status): accepted, replayed or
        conflict. A direct command blocks the user's earlier sources, all of them or those of its topic, in request
        order. Raises ConflictError, with nothing added, if another writer has committed meanwhile."""
        digest = F.sha2(F.to_json(F.struct("messages", "request_id", "session_id", "user_id")), 256)
        valid = requests.where(F.size("messages") > 0).withColumn("digest", digest)
        arrival = F.row_number().over(Window.partitionBy("user_id", "request_id").orderBy("digest"))
        valid = valid.withColumn("arrival", arrival)
        # At most BUCKETS numbers: the buckets of this batch's users.
        own = [r[0] for r in valid.select(bucket_of("user_id")).distinct().limit(BUCKETS).collect()]
        tx = self.tables.begin()
        known = self.tables.read("receipts", RECEIPT, tx.base, own)
        fresh, replayed, conflicts = ingest.accept(valid, known)
        old = self.tables.read("sources", schemas.SOURCE, tx.base, own).join(fresh.select("user_id").distinct(), "user_id", "left_semi")
        last = old.groupBy("user_id").agg(F.max("sequence").alias("_last"))
        m = fresh.select("user_id", "session_id", "request_id", F.posexplode("messages").alias("ordinal", "m")).where(F.trim("m.content") != "")
        order = Window.partitionBy("user_id").orderBy("request_id", "ordinal")
        command = (F.col("m.role") == "user") & T.matches(F.col("m.content"), fixed.DIRECT_FORGET)
        new = m.join(last, "user_id", "left").select(
            "user_id",
            "session_id",
            "request_id",
            "ordinal",
            (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("long").alias("sequence"),
            F.col("m.role").alias("role"),
            F.col("m.content").alias("text"),
            F.col("m.timestamp").alias("time"),
            command.alias("instruction"),
            F.when(command, "instruction").otherwise("active").alias("status"),
        )
        new = tx.append("sources", new)
        tx.append("passages", self._passages(new))
        tx.append("receipts", fresh.select("user_id", "request_id", "digest", F.lit(tx.version).cast("long").alias("accepted")))
        if new.where("instruction").limit(1).count():
            tx.append("status", self._blocked(old, new))
        tx.commit()
        out = fresh.withColumn("status", F.lit("accepted"))
        for df, name in ((replayed, "replayed"), (conflicts, "conflict")):
            out = out.unionByName(df.withColumn("status", F.lit(name)))
        return out.select("user_id", "request_id", "status")

    def _blocked(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The status changes that the new commands bring: of users with a command, all active rows before one to forget
        everything, and before any other those that its topic is found in and confirmed for."""
        asked = new.where("instruction").select("user_id").distinct()
        both = old.where("status = 'active'").unionByName(new).join(asked, "user_id", "left_semi")
        everything = F.col("instruction") & T.matches(F.col("text"), forget.EVERYTHING)
        barred = ingest.forget_barrier(both, everything, "user_id").where((F.col("state") == "blocked") & (F.col("status") == "active"))
        topical = forget.forget_topics(both, verifier=self.verifier).where("state = 'blocked'")
        keys = ["user_id", "sequence"]
        return barred.select(*keys).unionByName(topical.select(*keys)).distinct().withColumn("status", F.lit("blocked"))

    def compact(self) -> None:
        """Merge the log to one base, so that reads open one folder a table again."""
        self.tables.compact({"sources": schemas.SOURCE, "passages": schemas.PASSAGE, "receipts": RECEIPT})

    def _passages(self, sources: DataFrame) -> DataFrame:
        cut = chunk.explode_ranges(sources, chunk.passage_ranges("text"))
        ref = F.concat(F.lit("memory:episode/"), T.label(F.col("piece")), F.lit("~"), F.left(F.sha2(F.concat_ws("|", "user_id", F.col("sequence").cast("string")), 256), F.lit(12)), F.lit("#"), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"))
        return cut.select("user_id", "session_id", "request_id", ref.alias("ref"), "sequence", "role", "time", "start", "end", F.length("text").alias("source_length"), F.col("piece").alias("text"), T.tokens_strict("piece").alias("terms"), self.embedder.embed(F.col("piece")).alias("vector"), "status")

    def search(self, queries: DataFrame, budget: int = fixed.PACK_BUDGET) -> DataFrame:
        """(query_id, rn, id, content, score) for queries (query_id, user_id, query, top_k): hybrid ranking within each
        query's user, then packing under the budget. Unknown users get nothing."""
        items = self.tables.read("passages", schemas.PASSAGE).where("status = 'active'")
        asked = queries.withColumn("terms", T.tokens_strict("query")).withColumn("qv", self.embedder.embed(F.col("query")))
        lexical = retrieve.bm25(items.select("user_id", "ref", "terms"), asked.select("user_id", "query_id", "terms"), "user_id", "ref", "query_id")
        semantic = retrieve.vector_search_within(items, query_blocks(asked, "query_id", 1024), "user_id", "ref", "vector", fixed.CHANNEL_DEPTH)
        fused = retrieve.rrf([retrieve.ranked(c, "query_id", "ref", fixed.CHANNEL_DEPTH) for c in (lexical, semantic)], "query_id", "ref")
        top = retrieve.ranked(fused, "query_id", "ref", fixed.CANDIDATES)
        rows = top.join(items.select("ref", "start", "text", "role", "time"), "ref")
        content = T.render_evidence(F.col("rn"), F.col("role"), F.col("time"), F.col("text"))
        cards = rows.select("query_id", "rn", "ref", "start", content.alias("content"), F.length(content).cast("long").alias("cost"))
        packed = assemble.pack(cards.select("query_id", "rn", "ref", "start", "cost"), top_k=100, budget=budget)
        out = packed.join(cards.select("query_id", "ref", "content"), ["query_id", "ref"]).join(queries.select("query_id", "top_k"), "query_id")
        return out.where(F.col("rn") <= F.col("top_k")).select("query_id", "rn", F.col("ref").alias("id"), "content", "score")
