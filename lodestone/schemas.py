"""Explicit schemas of the engine's tables and protocols; none is inferred."""

from __future__ import annotations

MESSAGE = "role string, content string, timestamp bigint"
ADD_REQUEST = f"request_id string, user_id string, session_id string, messages array<struct<{MESSAGE.replace(' ', ':').replace(',:', ',')}>>"
SEARCH_REQUEST = "query string, options array<string>, user_id string, top_k int"
SEARCH_RESULT = "id string, content string, score double, created_at string"
SOURCE = "user_id string, session_id string, request_id string, ordinal int, sequence bigint, role string, text string, time bigint, instruction boolean, status string"
PASSAGE = (
    "user_id string, session_id string, request_id string, ref string, sequence bigint, role string, time bigint, start int, end int, "
    "source_length int, text string, terms array<string>, vector array<float>, status string"
)
RECEIPT = "user_id string, request_id string, digest string, accepted bigint"
TURN = "id string, speaker string, role string, timestamp bigint, content string"
SESSION = f"id string, source_id string, timestamp bigint, turns array<struct<{TURN.replace(', ', ',').replace(' ', ':')}>>"
TASK = "id string, kind string, text string, options array<string>, annotations map<string,string>"
MAX_TIME = 253_402_300_799_999
