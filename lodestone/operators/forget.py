"""Forgetting a topic: candidates by shared words, then an independent check of each whole message, then the cascade.

A command and a message meet only on words of the command's topic, never as a product: of the topic's words those that most
of the user's passages hold are left out of the meeting as far as the threshold allows, so a broad word brings no
candidates of its own. What met is then counted exactly, and every candidate is verified once, on its whole text.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions import text as T

# Words of a command that say nothing of its topic.
COMMAND_WORDS = "forget delete erase remove clear please kindly my me your memory memories about anything everything all prior saved stored 请 你 忘 记 忘记 删 除 删除 清 清除 空 清空 关 于 关于".split()
EVERYTHING = r"\b(everything|all)\b|全部|所有"
CANDIDATE, VERIFIED = 0.5, 0.75


class Verifier(Protocol):
    def matches(self, topic: Column, command: Column, message: Column) -> Column: ...


class LexicalVerifier:
    """A message is about a topic if it holds at least this share of the topic's words. It stands for a model that is
    asked whether one message has the very subject of the command."""

    def __init__(self, share: float = VERIFIED):
        self.share = share

    def matches(self, topic: Column, command: Column, message: Column) -> Column:
        held = F.size(F.array_intersect(topic, T.tokens(message)))
        return (F.size(topic) > 0) & (held >= F.ceil(F.size(topic) * self.share))


def is_command(role: Column, text: Column) -> Column:
    return (role == "user") & T.matches(text, fixed.DIRECT_FORGET)


def topic_words(text: Column) -> Column:
    return F.array_distinct(F.filter(T.tokens(text), lambda t: ~F.array_contains(T.words_in(COMMAND_WORDS), t)))


def commands(sources: DataFrame) -> DataFrame:
    """(user_id, command, command_text, topic) of the direct commands with a topic; ``command`` is their sequence."""
    said = sources.where(is_command(F.col("role"), F.col("text")) & ~T.matches(F.col("text"), EVERYTHING))
    return said.select("user_id", F.col("sequence").alias("command"), F.col("text").alias("command_text"), topic_words(F.col("text")).alias("topic")).where(F.size("topic") > 0)


def candidates(asked: DataFrame, passages: DataFrame, share: float = CANDIDATE) -> DataFrame:
    """(user_id, command, sequence): earlier messages with a passage that holds this share of a command's topic.

    passages: user_id, sequence, start, words (distinct). A passage with k of n words holds one at least of the n - k + 1
    that fewest of the user's passages hold, so only these are joined.
    """
    flat = asked.select("user_id", "command", F.size("topic").alias("n"), F.explode("topic").alias("word"))
    wanted = flat.select("user_id", "word").distinct()
    postings = passages.select("user_id", "sequence", "start", F.explode("words").alias("word")).join(wanted, ["user_id", "word"], "left_semi")
    held = postings.groupBy("user_id", "word").agg(F.count("*").alias("passages"))
    rank = F.row_number().over(Window.partitionBy("user_id", "command").orderBy(F.coalesce("passages", F.lit(0)), "word"))
    rare = flat.join(held, ["user_id", "word"], "left").withColumn("_rank", rank).where(F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * share) + 1)
    met = rare.select("user_id", "word", "command").join(postings, ["user_id", "word"]).where("sequence < command")
    met = met.select("user_id", "command", "sequence", "start").distinct()
    met = met.join(asked.select("user_id", "command", "topic"), ["user_id", "command"]).join(passages, ["user_id", "sequence", "start"])
    enough = F.size(F.array_intersect("topic", "words")) >= F.ceil(F.size("topic") * share)
    return met.where(enough).select("user_id", "command", "sequence").distinct()


def verified(found: DataFrame, asked: DataFrame, sources: DataFrame, verifier: Verifier) -> DataFrame:
    """The candidates whose whole message the verifier holds to be about the command's topic."""
    both = found.join(asked, ["user_id", "command"]).join(sources.select("user_id", "sequence", F.col("text").alias("message")), ["user_id", "sequence"])
    return both.where(verifier.matches(F.col("topic"), F.col("command_text"), F.col("message"))).select("user_id", "command", "sequence")


def forget_topics(sources: DataFrame, passages: DataFrame | None = None, verifier: Verifier | None = None) -> DataFrame:
    """sources (user_id, sequence, role, text, ...) with ``state`` (instruction, blocked, active) and ``forgotten_by``, the
    sequence of the first command that blocks the row.

    Commands to forget everything are instructions too; the barrier that they set is ``ingest.forget_barrier``. A
    message that is itself a command is never blocked, and only messages before a command are. passages (user_id, sequence,
    start, words) are the pieces in which candidates are looked for; by default a message is one.
    """
    command = is_command(F.col("role"), F.col("text"))
    asked = commands(sources)
    plain = sources.where(~F.coalesce(command, F.lit(False))).select("user_id", "sequence", "text")
    pieces = passages if passages is not None else plain.select("user_id", "sequence", F.lit(0).alias("start"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    pieces = pieces.join(plain.select("user_id", "sequence"), ["user_id", "sequence"], "left_semi")
    sure = verified(candidates(asked, pieces), asked, plain, verifier or LexicalVerifier())
    gone = sure.groupBy("user_id", "sequence").agg(F.min("command").alias("forgotten_by"))
    state = F.when(command, "instruction").when(F.col("forgotten_by").isNotNull(), "blocked").otherwise("active")
    return sources.join(gone, ["user_id", "sequence"], "left").withColumn("state", state)
