"""Selection menus: units offered under a character budget, unread directories, paged selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def menu(units: DataFrame, budget: int) -> DataFrame:
    """(query_id, position, ref, start, omitted): offered and carried refs in turn; a unit that does not fit is
    omitted and later ones may still fit. units: query_id, source (0 carried, 1 offered), rn, ref, start, cost."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, used, position, seen = [], 0, 0, set()
        for ref, start, cost in rows.sort_values(["rn", "source", "start"])[["ref", "start", "cost"]].itertuples(index=False):
            if (ref, start) in seen:
                continue
            seen.add((ref, start))
            fits = used + cost <= budget
            used, position = used + cost * fits, position + fits
            out.append((key[0], position if fits else None, ref, start, not fits))
        return pd.DataFrame(out, columns=["query_id", "position", "ref", "start", "omitted"]).astype({"position": "Int64"})

    return units.groupBy("query_id").applyInPandas(fill, "query_id long, position long, ref string, start long, omitted boolean")


def unread_directory(entries: DataFrame, most: int = 24, chars: int = 8000) -> DataFrame:
    """Entries (query_id, rn, ref, preview) in order, each with a line break; one that does not fit is left out and later
    ones may still fit. ``rn`` of the result counts the entries that are listed."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        room, listed = chars, []
        for i, n in enumerate(rows.sort_values("rn")["preview"].str.len().tolist()):
            if len(listed) < most and n <= room:
                listed.append(i)
                room -= n + 1
        kept = rows.sort_values("rn").iloc[listed]
        return kept.assign(rn=range(1, len(kept) + 1))

    plain = entries.select(F.col("query_id").cast("long").alias("query_id"), F.col("rn").cast("int").alias("rn"), "ref", F.coalesce("preview", F.lit("")).alias("preview"))
    return plain.groupBy("query_id").applyInPandas(fill, plain.schema)


def pages(cards: DataFrame, budget: int) -> DataFrame:
    """cards (query_id, rn, ref, cost) with the page they are read on: pages are filled to the budget in order."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        page, used, out = 0, 0, []
        for rn, ref, cost in rows.sort_values("rn")[["rn", "ref", "cost"]].itertuples(index=False):
            if used and used + cost > budget:
                page, used = page + 1, 0
            used += cost
            out.append((key[0], rn, ref, page))
        return pd.DataFrame(out, columns=["query_id", "rn", "ref", "page"])

    return cards.groupBy("query_id").applyInPandas(fill, "query_id long, rn long, ref string, page int")


def reading_cost(budget: int, n: int) -> int:
    """Characters allowed to each of n candidates."""
    return max(600, budget // max(2, min(12, n)))


def violations(choices: DataFrame) -> DataFrame:
    """choices (query_id, positions, queries, read_more, n) that break the bounds, with the reason."""
    unique = F.size(F.array_distinct("positions")) == F.size("positions")
    inside = F.forall("positions", lambda p: (p >= 1) & (p <= F.col("n")))
    reason = (
        F.when(~inside, "position_out_of_range")
        .when(~unique, "repeated_position")
        .when(F.size("queries") > 2, "too_many_queries")
        .when(F.exists("queries", lambda q: F.length(q) > 300), "query_too_long")
        .when(F.size("read_more") > 4, "too_many_read_more")
    )
    return choices.withColumn("reason", reason).where("reason is not null")
