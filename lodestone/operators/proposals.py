"""Generated plans as rows: what a model proposes is normalised by expressions and rejected with reasons, never repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTENTS = ("current", "historical", "temporal", "multi_hop", "general")
FACT = (
    "title string, content string, canonical_key string, time_expression string, source_ordinals array<int>, entities array<string>, concepts array<string>, "
    "event_time string, valid_from string, valid_to string, confidence double, supersedes_memory_ids array<string>"
)
SEARCH = "retrieval_queries array<string>, keywords array<string>, entity_names array<string>, time_hints array<string>, preferred_memory_ids array<string>, intent string"

# The longest text and list of each field.
TEXTS = {"title": 160, "content": 4000, "canonical_key": 240, "time_expression": 120, "event_time": 80, "valid_from": 80, "valid_to": 80}
LISTS = {"source_ordinals": 20, "entities": 20, "concepts": 20, "supersedes_memory_ids": 20}
LABEL, IDENT = 120, 128
SEARCH_LISTS = {"retrieval_queries": (8, 500), "keywords": (20, 120), "entity_names": (20, 120), "time_hints": (8, 120), "preferred_memory_ids": (20, 128)}
DEFAULT_CONFIDENCE = 0.8


def strip(c: str | Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def listed(c: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that hold, in order; a check that is unknown does not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]))


def bad_items(c: str, longest: int) -> Column:
    """Whether a list holds a null, blank or overlong text."""
    return F.exists(c, lambda x: x.isNull() | (x == "") | (F.length(x) > longest))


def facts(rows: DataFrame) -> DataFrame:
    """Fact proposals (FACT and other columns) as they are to be stored, with ``rejected``: all reasons, none if accepted.

    Texts lose outer white space, a key also repeated inner one; lists that are missing are empty, lists lose repeats and keep
    order; a missing confidence is 0.8. Title, content and at least one source are required; sources are ordinals from 0.
    """
    # Limits are on lists as proposed, repeats included.
    r = rows.withColumns({f"_n_{c}": F.size(listed(c, "int" if c == "source_ordinals" else "string")) for c in LISTS})
    r = r.withColumns({c: strip(c) for c in TEXTS})
    r = r.withColumn("canonical_key", F.regexp_replace("canonical_key", r"\s+", " "))
    r = r.withColumn("source_ordinals", F.array_distinct(listed("source_ordinals", "int")))
    r = r.withColumns({c: F.array_distinct(F.transform(listed(c), lambda x: strip(x))) for c in ("entities", "concepts", "supersedes_memory_ids")})
    r = r.withColumn("confidence", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)))
    checks = [(F.coalesce(F.col(c) == "", F.lit(True)), f"{c}_missing") for c in ("title", "content")]
    checks += [(F.length(c) > n, f"{c}_too_long") for c, n in TEXTS.items()]
    checks += [(F.col("canonical_key") == "", "canonical_key_blank")]
    checks += [(F.size("source_ordinals") == 0, "no_source"), (F.exists("source_ordinals", lambda x: x.isNull() | (x < 0)), "source_ordinal_negative")]
    checks += [(F.col(f"_n_{c}") > n, f"{c}_too_many") for c, n in LISTS.items()]
    checks += [(bad_items(c, n), f"{c}_invalid") for c, n in (("entities", LABEL), ("concepts", LABEL), ("supersedes_memory_ids", IDENT))]
    checks += [(F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence_out_of_range")]
    return r.withColumn("rejected", reasons(*checks)).drop(*[f"_n_{c}" for c in LISTS])


def searches(rows: DataFrame) -> DataFrame:
    """Search plans (SEARCH and other columns) as they are to be run, with ``rejected``. Missing lists are empty, a missing
    intent is general; items lose outer white space and repeats."""
    r = rows.withColumns({f"_n_{c}": F.size(listed(c)) for c in SEARCH_LISTS})
    r = r.withColumns({c: F.array_distinct(F.transform(listed(c), lambda x: strip(x))) for c in SEARCH_LISTS})
    r = r.withColumn("intent", F.coalesce("intent", F.lit("general")))
    checks = [(~F.col("intent").isin(*INTENTS), "intent_unknown")]
    checks += [(F.col(f"_n_{c}") > most, f"{c}_too_many") for c, (most, _) in SEARCH_LISTS.items()]
    checks += [(bad_items(c, n), f"{c}_invalid") for c, (_, n) in SEARCH_LISTS.items()]
    return r.withColumn("rejected", reasons(*checks)).drop(*[f"_n_{c}" for c in SEARCH_LISTS])


def known_sources(accepted: DataFrame, batch: DataFrame) -> DataFrame:
    """Accepted facts (plan_id, fact_no, source_ordinals, ...) that cite an ordinal which is not in their plan's batch (plan_id,
    ordinal), with the ordinals: a plan may cite only what it was shown."""
    flat = accepted.select("plan_id", "fact_no", F.explode("source_ordinals").alias("ordinal"))
    odd = flat.join(batch.select("plan_id", "ordinal"), ["plan_id", "ordinal"], "left_anti")
    return odd.groupBy("plan_id", "fact_no").agg(F.array_sort(F.collect_set("ordinal")).alias("unknown"))
