"""Histories of conversations: messages (conv_id, turn, role, text) in order of turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions import topics as Q
from folioquery.scratch import free_names, last_before

# Messages that count as recent, and what ends a conversation.
RECENT = 4
EXIT_WORDS = ["exit", "quit"]

#: Turns from which a conversation is cut into ranges.
LONG_TURNS = 1 << 20


def append(messages: DataFrame, more: DataFrame) -> DataFrame:
    return messages.unionByName(more)


def cleared(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """messages without those of the conversations (conv_id) that were cleared."""
    return messages.join(conversations.select("conv_id"), "conv_id", "left_anti")


def by_document(messages: DataFrame, document_col: str) -> DataFrame:
    """messages with a conversation of its own for each document: a change of document begins
    without history and topics. A null id or document is one like others: it stands as U+0002."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x02"))
    return messages.withColumn("conv_id", F.concat(part("conv_id"), F.lit("\x01"), part(document_col)))


def until_exit(messages: DataFrame) -> DataFrame:
    """messages up to each conversation's first user turn that says exit or quit, without it."""
    leaves = (F.col("role") == "user") & F.lower(T.strip("text")).isin(EXIT_WORDS)
    (end,) = free_names(messages, "end_turn")
    ends = messages.filter(leaves).groupBy("conv_id").agg(F.min("turn").alias(end))
    return messages.join(ends, "conv_id", "left").filter(F.col(end).isNull() | (F.col("turn") < F.col(end))).select(*messages.columns)


def recent_history(messages: DataFrame, limit: int = RECENT) -> DataFrame:
    """The last messages of each conversation, in order of conversation and turn where sorted."""
    last = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= limit).drop("_n")


def topic_state(messages: DataFrame) -> DataFrame:
    """messages with explicit (topics that a user turn names, else null) and topics (those in force
    before the turn: the latest that an earlier user turn named). A conversation of very many turns is
    cut into ranges, so it is not one task's work. Equal turns of a conversation are in any order."""
    explicit = F.when(F.col("role") == "user", Q.explicit_topics("text"))
    return last_before(messages.withColumn("explicit", explicit), "conv_id", ["turn"], "explicit", "topics", LONG_TURNS)


def rewritten(messages: DataFrame) -> DataFrame:
    """User turns with the question that is searched for in place of the text (rewritten)."""
    state = topic_state(messages).filter(F.col("role") == "user")
    return state.withColumn("rewritten", Q.rewrite("text", "topics", "explicit"))
