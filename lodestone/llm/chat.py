"""Chat formatting, relational: sorted turn structs, adjacent same-role turns merged, Spark expressions only.

Template. A conversation is a run of messages ``<s>role\\n`` body ``</s>``; the body of adjacent turns of one role
is one message whose turns are parted by ``<t>``; an assistant's body stands between ``[LOSS]`` and ``[/LOSS]``.
Control strings inside a role or text are escaped: backslashes are doubled, then a backslash goes behind the
bracket that opens a control string; a role's newlines are written \\n. Reading undoes this exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE_TRAINED = "assistant"
CONTROL = r"([<\[])(/?(?:s>|t>|INST\]|LOSS\]))"
ESCAPED = r"([<\[])\\(/?(?:s>|t>|INST\]|LOSS\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Between doubled backslashes, taken from the left, a backslash before n is a newline.
    parts = F.split(F.regexp_replace(role, ESCAPED, "$1$2"), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) of the rows (conv_id, turn, role, text).

    Rows are ordered by turn, null turns first, ties by role and text; repeated rows are turns of their own. Null
    texts and roles count as empty. Null conv_ids are one conversation. Other columns are not read; an empty table
    gives no rows. A conversation becomes one string, so one conversation is one group.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    one = F.struct("turn", role.alias("role"), text.alias("text"))
    # Role and text are escaped before they are collected, so the group holds strings that are ready to join.
    groups = turns.select(F.col("conv_id").cast("long"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    before = F.lit("")
    end = lambda r: F.when(r == ROLE_TRAINED, F.lit("[/LOSS]</s>")).otherwise(F.lit("</s>"))
    start = lambda r: F.concat(F.lit("<s>"), escape_role(r), F.lit("\n"), F.when(r == ROLE_TRAINED, F.lit("[LOSS]")).otherwise(F.lit("")))

    def piece(t: Column, i: Column) -> Column:
        earlier = F.get("ts", i - 1)["role"]
        later = F.get("ts", i + 1)["role"]
        opening = F.when((i > 0) & (earlier == t["role"]), F.lit("<t>")).otherwise(start(t["role"]))
        closing = F.when(later == t["role"], before).otherwise(end(t["role"]))
        return F.concat(opening, escape(t["text"]), closing)

    return groups.select("conv_id", F.array_join(F.transform("ts", piece), "").alias("formatted"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and masked (the texts under the loss mask) read back from ``formatted``."""
    messages = F.slice(F.split("formatted", "<s>"), 2, 1 << 30)

    def turns_of(m: Column) -> Column:
        at = F.instr(m, "\n")
        role = F.substr(m, F.lit(1), at - 1)
        body = F.regexp_replace(F.substr(m, at + 1), r"</s>$", "")
        trained = F.startswith(body, F.lit("[LOSS]"))
        body = F.when(trained, F.regexp_replace(F.regexp_replace(body, r"^\[LOSS\]", ""), r"\[/LOSS\]$", "")).otherwise(body)
        return F.transform(F.split(body, "<t>", -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text"), trained.alias("trained")))

    turns = F.flatten(F.transform(messages, turns_of))
    out = chats.withColumn("turns", turns)
    return out.withColumn("masked", F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]))


def digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted conversations."""
    out = read_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join("masked", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose two texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, ROLE_TRAINED, said)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


# The escapes below restate the template: DuckDB's regexp_replace takes \\1 for a group and 'g' for all matches.
_ESC = r"regexp_replace(replace({x}, '\', '\\'), '([<\[])(/?(?:s>|t>|INST\]|LOSS\]))', '\1\\\2', 'g')"
ORACLE = (
    r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER w AS earlier, lead(role) OVER w AS later, row_number() OVER w AS rn
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, length(CASE WHEN earlier = role AND rn > 1 THEN '<t>' ELSE '<s>' || replace("""
    + _ESC.format(x="role")
    + r""", chr(10), '\n') || chr(10) || CASE WHEN role = 'assistant' THEN '[LOSS]' ELSE '' END END)
    + length("""
    + _ESC.format(x="text")
    + r""")
    + length(CASE WHEN later = role THEN '' WHEN role = 'assistant' THEN '[/LOSS]</s>' ELSE '</s>' END) AS chars
  FROM o
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
)
