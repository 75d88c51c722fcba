"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

import re

from lodestone.functions import fixed

EDGE = r"[^\p{L}\p{N}_]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def re2(pattern: str) -> str:
    """A search pattern with Unicode word boundaries, as RE2 can state it."""
    opened = re.sub(r"\\b(?=[\w(])", lambda m: f"(?:^|{EDGE})", pattern)
    return text("(?i)" + opened.replace(r"\b", f"(?:$|{EDGE})"))


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {re2(pattern)})"


def any_of(column: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(m)})" for m in markers) + ")"


def grams(t: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({t}) - {n - 1}, 0) + 1), lambda i: substring({t}, i, {n}))"


def tokens(column: str) -> str:
    runs = f"regexp_extract_all(lower({column}), '[一-鿿]+|[\\p{{L}}\\p{{N}}]+')"
    kept = f"list_filter({runs}, lambda t: regexp_matches(t, '^[一-鿿]') OR NOT list_contains({listed(fixed.TOKEN_STOP)}, t))"
    return f"flatten(list_transform({kept}, lambda t: CASE WHEN regexp_matches(t, '^[一-鿿]') THEN list_concat({grams('t', 1)}, {grams('t', 2)}) ELSE [t] END))"


def query_tokens(column: str) -> str:
    """For texts without CJK runs, as in the driver's tables: distinct in first-seen order, at most 32."""
    runs = f"regexp_extract_all(lower({column}), '[A-Za-z0-9_]+|[一-鿿]+')"
    kept = f"list_filter({runs}, lambda t: NOT list_contains({listed(fixed.QUERY_STOP)}, t))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)[1:32]"


def squeeze(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def signature(column: str) -> str:
    return f"lower({squeeze(column)})"


# The engine's message tables over the driver's conversations.
SOURCES = """src AS (
  SELECT conv_id, turn, role, text, 'u' || CAST(conv_id % 10 AS VARCHAR) AS user_id, CAST(conv_id AS VARCHAR) AS session_id,
    CAST(conv_id AS VARCHAR) || '/' || CAST(turn // 2 AS VARCHAR) AS request_id,
    row_number() OVER (ORDER BY conv_id, turn) AS sequence
  FROM conversations WHERE role <> 'system')"""
