"""Usage of model calls and errors as numbers that the job itself brings along: budgets, sums, a table of error codes.

A call's cost is a column. Budgets are running sums in the order of calls, so a call beyond a budget is refused by data and
not by a counter somewhere; sums are observed while the rows pass and cost no further job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# The codes of failures and the status that each is answered with.
ERRORS = {
    "provider_not_configured": 503,
    "request_deadline": 504,
    "model_input_budget": 413,
    "provider_run_budget": 429,
    "provider_timeout": 504,
    "provider_network": 502,
    "provider_rate_limit": 429,
    "provider_http_failure": 502,
    "provider_invalid_json": 502,
    "provider_invalid_response": 502,
    "embedding_input_budget": 413,
    "embedding_output_invalid": 502,
    "embedding_dimensions": 502,
    "request_conflict": 422,
    "storage_failure": 503,
}
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
UNKNOWN_STATUS = 503


@dataclass(frozen=True)
class Budget:
    """Limits of one run; 0 is none."""

    calls: int = 0
    chars: int = 0
    chars_of_a_call: int = 0


def status_of(code: Column) -> Column:
    """The status of an error code; null without an error."""
    pairs = F.create_map(*[F.lit(x) for p in ERRORS.items() for x in p])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(pairs, code), F.lit(UNKNOWN_STATUS)))


def retryable(code: Column) -> Column:
    return F.when(code.isNotNull(), status_of(code).isin(*RETRYABLE))


def error_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s, s in RETRYABLE) for c, s in sorted(ERRORS.items())], "code string, status int, retryable boolean")


def within_budget(calls: DataFrame, budget: Budget, *keys: str, order: str) -> DataFrame:
    """calls (keys, order, chars) with ``refused``: the code of the budget that a call breaks, else null.

    A call that is too large by itself is refused and counts for nothing. Others count in their order; the first that
    breaks a budget of the run ends it, and all later ones are refused, whatever their size.
    """
    large = (F.col("chars") > budget.chars_of_a_call) if budget.chars_of_a_call else F.lit(False)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(large, 0).otherwise(1)).over(w)
    chars = F.sum(F.when(large, 0).otherwise(F.col("chars"))).over(w)
    over = F.lit(False)
    for limit, used in ((budget.calls, n), (budget.chars, chars)):
        over = over | (used > limit) if limit else over
    return calls.withColumn("refused", F.when(large, "model_input_budget").when(over, "provider_run_budget"))


def observed(calls: DataFrame, name: str = "usage") -> tuple[DataFrame, Observation]:
    """calls (refused, error, input_tokens, output_tokens, cached_tokens, chars) and what passes through them, to be read
    from the observation once an action has run: calls made, characters sent, answers, tokens as far as they are
    known, and failures by whether another try may help. No job of its own."""
    seen = Observation(name)
    made = F.col("refused").isNull()
    known = lambda c: F.sum(F.when(made & (F.col(c) >= 0), F.col(c)))
    failure = F.coalesce("refused", "error")
    metrics = [
        F.count_if(made).alias("calls"),
        F.sum(F.when(made, F.col("chars")).otherwise(0)).alias("input_chars"),
        F.count_if(made & F.col("error").isNull()).alias("responses"),
        *[known(c).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens")],
        F.count_if(made & F.col("input_tokens").isNull()).alias("unknown_usage"),
        F.count_if(retryable(failure)).alias("retryable_failures"),
        F.count_if(~retryable(failure)).alias("final_failures"),
    ]
    return calls.observe(seen, *metrics), seen
