"""Evidence assembly: disclosure, context, closure and budgeted packing per query.

Steps that depend on what was taken before (disclosure rounds, greedy budgets) run per query in applyInPandas over
that query's candidates, of which the ranking leaves at most a few dozen; the rest is windows and joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T


def disclose(ranked: DataFrame, limit: int = fixed.CANDIDATES) -> DataFrame:
    """(query_id, ref, rn, entry): one unread target of each ranked entry per round, in entry order.

    ranked: query_id, rn, entry, targets (array of refs, best first). A target is disclosed once; a queue whose
    head was disclosed goes on to its next. Parents' scores are not inherited.
    """

    def rounds(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        queues = [(e, list(t)) for e, t in rows.sort_values("rn")[["entry", "targets"]].itertuples(index=False)]
        seen: set[str] = set()
        out = []
        while any(q for _, q in queues) and len(out) < limit:
            for entry, q in queues:
                while q and q[0] in seen:
                    q.pop(0)
                if q and len(out) < limit:
                    ref = q.pop(0)
                    seen.add(ref)
                    out.append((key[0], ref, len(out) + 1, entry))
        return pd.DataFrame(out, columns=["query_id", "ref", "rn", "entry"])

    return ranked.groupBy("query_id").applyInPandas(rounds, "query_id long, ref string, rn long, entry string")


def adjacent(passages: DataFrame) -> DataFrame:
    """passages (session_id, sequence, start, end, source_length, ref) with prev_ref and next_ref: the touching range
    of the same source, or at a source's edge the last or first passage of the session's neighbouring source. A gap
    in a source is not crossed."""
    w = Window.partitionBy("session_id").orderBy("sequence", "start")
    p = passages
    for step, name in ((F.lag, "prev"), (F.lead, "next")):
        for c in ("ref", "sequence", "start", "end"):
            p = p.withColumn(f"_{name}_{c}", step(c).over(w))
    same_prev = (F.col("_prev_sequence") == F.col("sequence")) & (F.col("_prev_end") == F.col("start"))
    same_next = (F.col("_next_sequence") == F.col("sequence")) & (F.col("_next_start") == F.col("end"))
    edge_prev = (F.col("start") == 0) & (F.col("_prev_sequence") < F.col("sequence"))
    edge_next = (F.col("end") == F.col("source_length")) & (F.col("_next_sequence") > F.col("sequence"))
    p = p.withColumn("prev_ref", F.when(same_prev | edge_prev, F.col("_prev_ref"))).withColumn("next_ref", F.when(same_next | edge_next, F.col("_next_ref")))
    return p.select(*passages.columns, "prev_ref", "next_ref")


def backlinks(notes: DataFrame) -> DataFrame:
    """(ref, other) of distinct passages that support the same note; notes: note, ref. The pairs are those within a
    note's supports, which a note has few of."""
    other = notes.select("note", F.col("ref").alias("other"))
    return notes.join(other, "note").where("ref <> other").select("ref", "other").distinct()


def context_expansion(primary: DataFrame, links: DataFrame, seeds: int = fixed.CONTEXT_SEEDS, total: int = 2 * fixed.CANDIDATES) -> DataFrame:
    """(query_id, ref, rn, reason): the primaries, then related passages of the first ``seeds`` of them, taken in
    turn, up to ``total`` in all. primary: query_id, ref, rn; links: ref, other, kind (adjacent first)."""
    queues = primary.where(F.col("rn") <= seeds).join(links, "ref")
    place = Window.partitionBy("query_id", "ref").orderBy("kind", "other")
    queues = queues.select("query_id", F.col("rn").alias("parent"), "other", "kind", F.row_number().over(place).alias("turn"))
    fresh = queues.join(primary.select("query_id", F.col("ref").alias("other")), ["query_id", "other"], "left_anti")
    first = fresh.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "other").orderBy("turn", "parent"))).where("_i = 1")
    more = first.select("query_id", F.col("other").alias("ref"), (F.lit(1_000_000) + F.col("turn") * 1000 + F.col("parent")).alias("place"), F.col("kind").alias("reason"))
    both = primary.select("query_id", "ref", F.col("rn").alias("place"), F.lit("matched_entry").alias("reason")).unionByName(more)
    out = both.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "ref")))
    return out.where(F.col("rn") <= total).select("query_id", "ref", F.col("rn").cast("long").alias("rn"), "reason")


def context_closure(units: DataFrame, selected: DataFrame, *keys: str, order: str) -> DataFrame:
    """(keys, order, added): for each selected unit that needs context, the unit before it unless that is selected."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = units.join(selected.select(*keys, order).withColumn("_sel", F.lit(True)), [*keys, order], "left")
    marked = marked.withColumn("_prev", F.lag(order).over(w)).withColumn("_prev_sel", F.lag("_sel").over(w))
    need = F.col("_sel") & T.needs_context(F.col("text")) & F.col("_prev").isNotNull() & F.col("_prev_sel").isNull()
    return marked.where(need).select(*keys, order, F.col("_prev").alias("added"))


def closure_across(selected: DataFrame, disclosed: DataFrame, passages: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, ref, unit, added_ref, added_unit, scope): for each selected unit that needs context the unit before it in
    its passage, or else the last unit of the passage before it among those disclosed to its query: the touching one of
    the same source, or at a source's start the last of the session's source before. A unit is added once, for the first
    selected that needs it, and not if it is selected.

    selected: query_id, rn, ref, unit; disclosed: query_id, ref; passages: ref, session_id, sequence, start, end; units: ref,
    unit (numbered from 0), text.
    """
    asked = selected.join(units, ["ref", "unit"]).where(T.needs_context(F.col("text"))).select("query_id", "rn", "ref", "unit")
    # Passages that a query may look at, in the order of its sessions.
    seen = disclosed.select("query_id", "ref").unionByName(selected.select("query_id", "ref")).distinct().join(passages, "ref")
    w = Window.partitionBy("query_id", "session_id").orderBy("sequence", "start")
    for c in ("ref", "sequence", "end"):
        seen = seen.withColumn(f"_{c}", F.lag(c).over(w))
    touches = (F.col("_sequence") == F.col("sequence")) & (F.col("_end") == F.col("start"))
    before = F.when(touches | ((F.col("start") == 0) & (F.col("_sequence") < F.col("sequence"))), F.col("_ref"))
    # A passage that was selected but not disclosed gives no context to others.
    seen = seen.select("query_id", "ref", before.alias("added_ref"))
    allowed = disclosed.select("query_id", F.col("ref").alias("added_ref")).distinct()
    last = units.groupBy(F.col("ref").alias("added_ref")).agg(F.max("unit").alias("added_unit"))
    within = asked.where("unit > 0").select("query_id", "rn", "ref", "unit", F.col("ref").alias("added_ref"), (F.col("unit") - 1).alias("added_unit"), F.lit("same_episode").alias("scope"))
    across = asked.where("unit = 0").join(seen, ["query_id", "ref"]).join(allowed, ["query_id", "added_ref"], "left_semi").join(last, "added_ref")
    found = within.unionByName(across.withColumn("scope", F.lit("adjacent_episode")))
    known = selected.select("query_id", F.col("ref").alias("added_ref"), F.col("unit").alias("added_unit"))
    first = F.row_number().over(Window.partitionBy("query_id", "added_ref", "added_unit").orderBy("rn", "ref", "unit"))
    found = found.join(known, ["query_id", "added_ref", "added_unit"], "left_anti").withColumn("_i", first).where("_i = 1")
    return found.select("query_id", "ref", "unit", "added_ref", "added_unit", "scope")


def pack(candidates: DataFrame, top_k: int = 10, budget: int = fixed.PACK_BUDGET) -> DataFrame:
    """(query_id, ref, rn, score, n_units, cost): units grouped by ref in first-selected order, at most top_k groups
    within the budget; a unit that does not fit is skipped and later ones may still fit. Units are never cut.

    candidates: query_id, rn, ref, start, cost.
    """

    def greedy(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        groups: dict[str, list] = {}
        total = 0
        for ref, start, cost in rows.sort_values("rn")[["ref", "start", "cost"]].itertuples(index=False):
            known = groups.get(ref)
            if (known is None and len(groups) >= top_k) or (known and start in known[1]):
                continue
            extra = cost + (0 if known else fixed.GROUP_COST)
            if total + extra > budget:
                continue
            total += extra
            if known:
                known[0] += extra
                known[1].add(start)
            else:
                groups[ref] = [extra, {start}]
        out = [(key[0], ref, i, round(1 / i, 6), len(starts), cost) for i, (ref, (cost, starts)) in enumerate(groups.items(), 1)]
        return pd.DataFrame(out, columns=["query_id", "ref", "rn", "score", "n_units", "cost"])

    return candidates.groupBy("query_id").applyInPandas(greedy, "query_id long, ref string, rn long, score double, n_units long, cost long")


def pack_prefix(candidates: DataFrame, budget: int = fixed.PACK_BUDGET) -> DataFrame:
    """The longest prefix of each query's candidates whose summed cost stays within the budget."""
    w = Window.partitionBy("query_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return candidates.withColumn("running", F.sum(F.col("cost") + fixed.GROUP_COST).over(w)).where(F.col("running") <= budget)


def near_duplicate_notes(notes: DataFrame, group: str, ref: str, terms: str, threshold: float = 0.8) -> DataFrame:
    """(group, a, b, similarity) of notes of one group whose token sets overlap by the coefficient |A & B| / min.

    Pairs come from shared tokens: notes meet on the tokens they hold, counted, never as all pairs of a group.
    """
    sets = notes.select(group, ref, F.array_distinct(terms).alias("ts")).withColumn("n", F.size("ts")).where("n > 0")
    flat = sets.select(group, ref, "n", F.explode("ts").alias("t"))
    other = flat.select(group, "t", F.col(ref).alias("b"), F.col("n").alias("nb"))
    shared = flat.withColumnRenamed(ref, "a").join(other, [group, "t"]).where("a < b").groupBy(group, "a", "b", "n", "nb").agg(F.count("*").alias("k"))
    sim = F.col("k") / F.least("n", "nb")
    return shared.where(sim >= threshold).select(group, "a", "b", F.round(sim, 6).alias("similarity"))


def assemble_states(rows: DataFrame, budget: int) -> DataFrame:
    """(query_id, component, n_cards, cost): whole state groups in rank order while the budget lasts; a group that
    does not fit is skipped. rows: query_id, rn, component, ref, status, cost; superseded cards stay hidden."""

    def greedy(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["status"] != "superseded"].drop_duplicates("ref")
        out, left = [], budget
        for component, own in sorted(part.groupby("component"), key=lambda g: (g[1]["rn"].min(), g[0])):
            cost = int(own["cost"].sum())
            if cost <= left:
                left -= cost
                out.append((key[0], component, len(own), cost))
        return pd.DataFrame(out, columns=["query_id", "component", "n_cards", "cost"])

    return rows.groupBy("query_id").applyInPandas(greedy, "query_id long, component long, n_cards long, cost long")
