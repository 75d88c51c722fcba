"""Mixing sources to target weights, in DataFrame expressions only.

Every source gets a target of words: its weight's share of all words, at most ``cap`` times its own words, the
excess shared again by weight. A schedule of ``slots`` slots, each of one global block length, is dealt to the sources
by a low-discrepancy sequence: slot k's van der Corput point (the mirrored bits of k) falls into one source's stretch
of the cumulative targets, or behind them all, and then the slot is idle. A source's slots are ranked and joined with
the equal-token blocks of its documents in shuffled (hashed) order: as many blocks are taken as the source has slots.
Only the last block is corrected: it ends at the target, and where the slots fall short one partial block is added.
So a source misses its target by what the sequence's count differs from the target beyond one block; the points of
a power of two of slots are evenly spaced, and their count never does.

Scale: the schedule has a fixed number of slots, so a block grows with the corpus and a document meets few blocks.
Ranks and running sums are taken in two levels (within hash ranges, then over the ranges' totals), so a source
with a third of all rows never meets in one task; the number of ranges grows with the rows. The windows over sources run
over one row per source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SLOTS = 1 << 18
CELLS = 4096
RANGE_ROWS = 4096
COPIES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\f\r", "     ")
    trimmed = F.trim(F.regexp_replace(flat, " +", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "))) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling by weight under the caps.

    One row per source; the windows run over this small table only. Sources are capped in the order of cap over
    weight; the first prefix after which the next source stays below its cap gives the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("most", F.col("source_size").cast("double") * cap)
    s = s.withColumn("ratio", F.col("most") / F.col("w"))
    all_rows = Window.partitionBy(F.lit(0))
    before = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum(F.col("source_size").cast("double")).over(all_rows))
    s = s.withColumn("left_words", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = F.col("left_words") / F.col("left_weight")
    # The level that holds is that of the first source in this order whose cap it does not reach.
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= level, F.struct("ratio", "i", level.alias("level")))).over(all_rows)["level"])
    return s.select("source", "source_size", F.least(F.col("most"), F.col("level") * F.col("w")).alias("target"), "i")


def van_der_corput(k: Column, slots: int) -> Column:
    """The k-th point of the base-2 van der Corput sequence: the bits of k mirrored at the binary point."""
    bits = max(1, (slots - 1).bit_length())
    mirrored = F.reverse(F.lpad(F.bin(k), bits, "0"))
    return F.conv(mirrored, 2, 10).cast("double") / (1 << bits)


def schedule(spark: SparkSession, goals: DataFrame, slots: int = SLOTS, span: float | None = None, point: Callable[[Column, int], Column] = van_der_corput) -> DataFrame:
    """(slot, i, turn): the source i that takes each slot, and how many earlier slots it has.

    goals has i and target; targets are laid end to end over [0, 1), or over their share of ``span`` where that is
    given: slots behind them are idle and have no row. Both sides are cut into CELLS equal cells, so points meet
    stretches by an equi-join.
    """
    total = F.sum("target").over(Window.partitionBy(F.lit(0))) if span is None else F.lit(float(span))
    upto = F.sum("target").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    ends = goals.select("i", "target", (upto / total).alias("hi")).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("i")), F.lit(0.0)))
    ends = ends.where("hi > lo")
    ends = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id"), slots).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(ends, "cell").where("u >= lo and u < hi").select("slot", "i", F.floor(F.col("slot") / 1024).alias("run"))
    dealt = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("i", "run").orderBy("slot")) - 1)
    runs = dealt.groupBy("i", "run").count()
    runs = runs.withColumn("earlier", F.coalesce(F.sum("count").over(Window.partitionBy("i").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(runs, ["i", "run"]).select("slot", "i", (F.col("earlier") + F.col("inside")).alias("turn"))


def shuffled(sized: DataFrame, ranges: int = 1024) -> DataFrame:
    """sized (i, doc_id, size, copy) with ``start``: the words before the document in its source's shuffled order.

    The order is md5 of the doc_id and the copy number (then these themselves), whatever the number of ranges, so
    reruns agree.
    """
    s = sized.withColumn("h", F.md5(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("copy").cast("string"))))
    s = s.withColumn("b", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(ranges) / (1 << 32)))
    inside = Window.partitionBy("i", "b").orderBy("h", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = s.groupBy("i", "b").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("earlier", F.coalesce(F.sum("words").over(Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(sums.select("i", "b", "earlier"), ["i", "b"]).withColumn("start", F.col("earlier") + F.col("inside")).drop("h", "b", "inside", "earlier")


def copies(rows: DataFrame) -> DataFrame:
    """Each of rows' equal rows with a number of its own, ``copy`` (from 1); no array is longer than COPIES."""
    counted = rows.groupBy(*rows.columns).count().withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / COPIES))))
    first = F.col("_c") * COPIES
    return counted.withColumn("copy", F.explode(F.sequence(first + 1, F.least(F.col("count"), first + COPIES)))).drop("count", "_c")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, slots: int = SLOTS, point: Callable[[Column, int], Column] = van_der_corput) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, first_slot for every row of docs.

    ``taken`` counts the words of the row that the mix takes, repeats counted, at most cap times its size.
    ``first_slot`` is the earliest slot whose block reaches it (null if none does). Null texts have size 0 and are
    never taken; null sources are one source, last in order. Rows that repeat a doc_id are mixed as rows of their
    own. Without any words all targets are 0. An empty table gives no rows; extra columns are not read.

    A block is as many words as make ``slots`` blocks of the whole mix, one at least. A source's blocks lie on its
    documents' shuffled stream, repeated up to cap times; the first ones, one per slot, are taken.
    """
    spark = docs.sparkSession
    rows = cut(copies(docs.select(F.col("doc_id").cast("long"), "source", words(F.col("text")).alias("size"))), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_source = cut(by_source, "sources")
    goals = cut(targets(by_source.select("source", "source_size"), weights, cap), "targets")
    total, n = by_source.agg(F.sum("source_size"), F.sum("rows")).first()
    total, n = total or 0, n or 0
    block = max(1, -(-total // slots))
    dealt = cut(schedule(spark, goals, slots, slots * block, point), "schedule")
    turns = F.coalesce("turns", F.lit(0))
    goals = goals.join(dealt.groupBy("i").agg(F.count("*").alias("turns")), "i", "left").withColumn("turns", turns)
    # The last block alone may be cut or, beyond the slots, added in part.
    upto = F.greatest((F.col("turns") - 1) * block, F.least((F.col("turns") + 1) * block, F.floor(F.coalesce("target", F.lit(0.0)))))
    goals = goals.withColumn("upto", F.least(F.greatest(upto, F.lit(0)), F.col("source_size") * cap))
    ranges = 1024 * max(1, -(-n // (1024 * RANGE_ROWS)))
    placed = rows.join(goals.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    placed = cut(shuffled(placed, ranges), "placed")
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    passes = passes.withColumn("start", F.col("start") + F.col("pass") * F.col("source_size"))
    passes = passes.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("upto")))
    met = F.when(F.col("start") < F.col("end"), F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)))
    spread = passes.withColumn("turn", F.explode_outer(met))
    inside = F.least(F.col("end"), (F.col("turn") + 1) * block) - F.greatest(F.col("start"), F.col("turn") * block)
    # A block is taken by its slot, or is the one partial block beyond a source's slots.
    inside = F.when(F.col("slot").isNotNull() | (F.col("turn") == F.col("turns")), inside)
    rows = spread.join(dealt, ["i", "turn"], "left").groupBy("doc_id", "size", "copy", "source", "source_size", "target")
    out = rows.agg(F.sum(inside).alias("taken"), F.min("slot").alias("first_slot"))
    return out.select("doc_id", "size", "source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
