"""Corpus adapters: nested raw records to flat sessions, turns and tasks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lodestone.functions import text as T
from lodestone.functions.temporal import session_time
from lodestone.sources.readers import soft_value


def with_caption(text: Column, caption: Column) -> Column:
    """The text with [Image: caption] on a line of its own, unless it has the caption already."""
    has = F.contains(F.lower(text), F.lower(caption)) | caption.isNull() | (F.trim(caption) == "")
    return F.when(has, text).otherwise(F.concat(text, F.lit("\n[Image: "), caption, F.lit("]")))


def dialog_ids(evidence: Column) -> Column:
    """D<session>:<turn> references found in a text, without leading zeros."""
    part = lambda x, k: F.regexp_extract(x, r"D:?(\d+):(\d+)", k).cast("int").cast("string")
    return F.transform(T.findall(evidence, r"D:?\d+:\d+"), lambda x: F.concat(F.lit("D"), part(x, 1), F.lit(":"), part(x, 2)))


def role_of(speaker: Column, participants: Column) -> Column:
    """The first participant is the user, others assistants; an unknown speaker is an error."""
    known = F.array_contains(participants, speaker)
    return F.when(F.element_at(participants, 1) == speaker, "user").when(known, "assistant").otherwise(F.raise_error(F.concat(F.lit("unknown speaker "), speaker)))


def numbered_sessions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, tasks) of dialogues whose sessions are keys session_<n> with session_<n>_date_time.

    records: sample_id, conversation (JSON object), qa (JSON array). Sessions come in numeric order; tasks whose
    evidence is not in the history are marked excluded.
    """
    turn = "array<struct<dia_id:string,speaker:string,text:string,blip_caption:string>>"
    entries = records.select("sample_id", F.from_json("conversation", "map<string,string>").alias("m"), "qa")
    people = F.array(F.element_at("m", "speaker_a"), F.element_at("m", "speaker_b"))
    s = entries.select("sample_id", people.alias("participants"), F.col("m"), F.explode(F.map_entries("m")).alias("e")).where(F.regexp_like("e.key", F.lit(r"^session_\d+$")))
    n = F.regexp_extract("e.key", r"(\d+)$", 1).cast("int")
    when = session_time(F.element_at("m", F.concat(F.col("e.key"), F.lit("_date_time"))))
    flat = s.select("sample_id", "participants", n.alias("session_no"), when.alias("timestamp"), F.posexplode(F.from_json("e.value", turn)).alias("turn_no", "t"))
    turns = flat.select("sample_id", "session_no", "turn_no", "timestamp", F.col("t.dia_id").alias("id"), F.col("t.speaker").alias("speaker"), role_of(F.col("t.speaker"), F.col("participants")).alias("role"), with_caption(F.col("t.text"), F.col("t.blip_caption")).alias("content"))
    qa = entries.select("sample_id", F.posexplode(F.from_json("qa", "array<struct<question:string,answer:string,category:int,evidence:array<string>>>")).alias("task_no", "q"))
    tasks = qa.select("sample_id", "task_no", F.col("q.question").alias("question"), F.col("q.answer").alias("answer"), F.col("q.category").alias("category"), F.flatten(F.transform(F.coalesce("q.evidence", F.array().cast("array<string>")), dialog_ids)).alias("evidence"))
    held = turns.groupBy("sample_id").agg(F.collect_set("id").alias("_ids"))
    tasks = tasks.join(held, "sample_id", "left").withColumn("excluded", F.size(F.array_except("evidence", F.coalesce("_ids", F.array().cast("array<string>")))) > 0).drop("_ids")
    return turns, tasks


def haystack(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, tasks) of long-history questions: session ids are made unique (#2, #3), a message without a time has
    its session's, evidence is the marked turns of answer sessions, equal texts once."""
    flat = records.select("question_id", "question", "answer", "answer_session_ids", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_sessions", "haystack_dates")).alias("session_no", "s"))
    again = F.row_number().over(Window.partitionBy("question_id", "s.haystack_session_ids").orderBy("session_no"))
    sid = F.col("s.haystack_session_ids")
    flat = flat.withColumn("session_id", F.when(again > 1, F.concat(sid, F.lit("#"), again.cast("string"))).otherwise(sid))
    turns = flat.select("question_id", "session_no", "session_id", sid.alias("source_id"), session_time(F.col("s.haystack_dates")).alias("timestamp"), "answer_session_ids", F.posexplode("s.haystack_sessions").alias("turn_no", "t"))
    turns = turns.select("question_id", "session_no", "session_id", "source_id", "timestamp", "turn_no", F.col("t.role").alias("role"), F.col("t.content").alias("content"), (F.coalesce(F.col("t.has_answer"), F.lit(False)) & F.array_contains("answer_session_ids", F.col("source_id"))).alias("gold"))
    first = F.row_number().over(Window.partitionBy("question_id", T.signature(F.col("content"))).orderBy("session_no", "turn_no"))
    gold = turns.where("gold").withColumn("_n", first).where("_n = 1").groupBy("question_id").agg(F.array_sort(F.collect_list(F.concat_ws("/", "session_id", F.col("turn_no").cast("string")))).alias("evidence"))
    tasks = records.select("question_id", "question", "answer", (~F.endswith("question_id", F.lit("_abs"))).alias("answerable")).join(gold, "question_id", "left")
    return turns, tasks


def context_tasks(records: DataFrame, mark: str = "<|TASK|>") -> DataFrame:
    """records (id, messages) with system, history and question: a single message is split once at the mark, else the
    last user message asks; what cannot be split is kept as the question."""
    said = F.filter("messages", lambda m: m["role"] != "system")
    one = F.size(said) == 1
    only = F.element_at(said, 1)["content"]
    parts = F.split(only, "\\Q" + mark + "\\E", 2)
    split = one & (F.size(parts) == 2)
    last_user = F.array_max(F.transform(F.filter(F.transform(said, lambda m, i: F.struct(i.alias("i"), m["role"].alias("r"))), lambda x: x["r"] == "user"), lambda x: x["i"]))
    question = F.when(split, F.element_at(parts, 2)).when(last_user.isNotNull(), F.get(said, last_user)["content"]).otherwise(only)
    history = F.when(split, F.array(F.element_at(parts, 1))).otherwise(F.transform(F.filter(said, lambda m, i: F.coalesce(i < last_user, F.lit(False))), lambda m: m["content"]))
    system = F.transform(F.filter("messages", lambda m: m["role"] == "system"), lambda m: m["content"])
    return records.select("id", system.alias("system"), history.alias("history"), question.alias("question"))


def persona_histories(rows: DataFrame, histories: DataFrame) -> DataFrame:
    """Persona rows joined to their history by link; a persona with several links is an error. System messages go."""
    links = rows.groupBy("persona_id").agg(F.countDistinct("link").alias("_n"))
    checked = rows.join(links, "persona_id").withColumn("link", F.when(F.col("_n") == 1, F.col("link")).otherwise(F.raise_error(F.concat(F.lit("several histories of persona "), F.col("persona_id").cast("string"))))).drop("_n")
    return checked.join(histories.where("role <> 'system'"), "link")


def scaled_chat(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of chat arrays of sessions and maps of probing questions by category."""
    s = records.select("conversation_id", F.posexplode("chat").alias("session_no", "s"))
    turns = s.select("conversation_id", "session_no", F.posexplode("s").alias("turn_no", "t")).select("conversation_id", "session_no", "turn_no", "t.*")
    q = records.select("conversation_id", F.explode("probing_questions").alias("category", "qs"))
    return turns, q.select("conversation_id", "category", F.posexplode("qs").alias("question_no", "q")).select("conversation_id", "category", "question_no", "q.*")


def flatten_chat(value: object) -> list[tuple[str, str]]:
    """(role, content) of the messages in an arbitrarily nested chat value, in order: objects whose role is user or
    assistant and whose content is text. What any other object holds is looked into."""
    out: list[tuple[str, str]] = []
    open_values = [value]
    while open_values:
        v = open_values.pop()
        if isinstance(v, dict) and v.get("role") in ("user", "assistant") and isinstance(v.get("content"), str):
            out.append((v["role"], v["content"]))
        elif isinstance(v, (dict, list)):
            open_values.extend(reversed(list(v.values()) if isinstance(v, dict) else v))
    return out


@F.pandas_udf(ArrayType(StructType().add("role", StringType()).add("content", StringType())))
def flatten_nested_chat(chat: pd.Series) -> pd.Series:
    return chat.map(lambda t: [{"role": r, "content": c} for r, c in flatten_chat(json.loads(t or "[]"))])


def opened(value: object) -> object:
    """A text that looks like a nested value, as that value (JSON, else a Python literal); anything else as it is."""
    if not isinstance(value, str) or value.lstrip()[:1] not in ("{", "["):
        return value
    found = soft_value(value)
    return found if isinstance(found, (dict, list)) else value


def readable(value: object, depth: int = 4, rows: int = 24, chars: int = 700, visits: int = 300) -> list[tuple[str, str]]:
    """At most ``rows`` (label, text) leaves of a nested value, no deeper than ``depth``, of at most ``visits`` + 1 values
    looked at. Texts that hold nested values are opened; a list of plain values is one leaf, numbered."""
    out: list[tuple[str, str]] = []
    todo: list[tuple[list[str], object]] = [([], value)]
    seen = 0
    while todo and len(out) < rows and seen <= visits:
        path, v = todo.pop()
        seen += 1
        v = opened(v)
        inner: list[tuple[str, object]] | None = None
        if len(path) < depth and isinstance(v, dict):
            inner = [(str(k), x) for k, x in v.items()]
        elif len(path) < depth and isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v):
            inner = [(str(i), x) for i, x in enumerate(v[:rows], 1)]
        if inner is not None:
            todo.extend(([*path, k], x) for k, x in reversed(inner))
            continue
        if isinstance(v, list) and v:
            text = "\n".join(f"{i}. {x}" for i, x in enumerate(v, 1))
        else:
            text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        out.append((".".join(path), text if len(text) <= chars else text[:chars] + "…"))
    return out


@F.pandas_udf(ArrayType(StructType().add("label", StringType()).add("text", StringType())))
def readable_rows(value: pd.Series) -> pd.Series:
    return value.map(lambda t: [{"label": a, "text": b} for a, b in readable(soft_value(t) if t is not None else None)])


def character_tasks(memories: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions joined to their character's memory ids, with the evidence that no memory has."""
    ids = memories.groupBy("name").agg(F.collect_set("memory_id").alias("_ids"))
    both = questions.join(ids, "name", "left")
    return both.withColumn("dangling", F.array_except("evidence", F.coalesce("_ids", F.array().cast("array<string>")))).drop("_ids")


def diagnostic_excerpts(turns: DataFrame, gold: DataFrame, radius: int = 0, dated: str | None = None) -> DataFrame:
    """The turns (record_id, session_id, position, ...) that evidence points to, and those within ``radius`` positions of them in
    their session. Gold decides which turns are kept and nothing else: no column of it is in the result. With ``dated``, a
    column of milliseconds, content begins with the conversation's date. A gold turn that is not there is an error.

    gold: record_id, session_id, position.
    """
    keys = ["record_id", "session_id", "position"]
    marked = gold.select(*keys).distinct().withColumn("_gold", F.lit(True))
    both = turns.join(marked, keys, "full_outer")
    missing = F.col("_gold") & F.col("content").isNull()
    both = both.withColumn("content", F.when(missing, F.raise_error(F.concat_ws("/", F.lit("no such turn:"), *[F.col(k).cast("string") for k in keys]))).otherwise(F.col("content")))
    near = Window.partitionBy("record_id", "session_id").orderBy("position").rangeBetween(-radius, radius)
    kept = both.withColumn("_near", F.max(F.coalesce("_gold", F.lit(False))).over(near)).where("_near").drop("_near", "_gold")
    if dated is None:
        return kept.select(*turns.columns)
    date = F.date_format(F.timestamp_millis(F.col(dated)), "yyyy-MM-dd")
    return kept.withColumn("content", F.when(F.col(dated).isNull(), F.col("content")).otherwise(F.concat(F.lit("[Conversation date: "), date, F.lit("]\n"), "content"))).select(*turns.columns)
